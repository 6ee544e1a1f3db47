"""Near-duplicates, mixing, sharding, chat, pages and the pipeline."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabscout.llm import chat, html, mixing, neardup, queries, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingle_set(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(rows, n, percent):
    """Of each row: set size and the least id that links reach; rows are told apart by place."""
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = collections.defaultdict(list)
    for i, s in enumerate(sets):
        met = collections.Counter(j for g in s for j in post[g])
        for g in s:
            post[g].append(i)
        for j, shared in met.items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    smallest = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return [(d, len(s), smallest[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def family(rng, size, rate, n=150):
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    return [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < rate * rng.random() * 2 else w for w in base) for _ in range(size)]


def test_near_duplicates(spark, documents):
    rng = random.Random(2)
    made = family(rng, 150, 0.03) + family(rng, 60, 0.05, 40) + ["a b", "A  B", "a", "one two three", "one two three four", "", None, "\x0b \x0c"]
    made += [" ".join(f"v{j}" for j in range(7)), " ".join(f"v{j}" for j in range(8)), "long " * 20_000, "long " * 20_000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(made)] + [(None, "null id text of some words"), (None, "null id text of some words"), (5000, made[0]), (5000, made[0]), (None, made[1])]
    df = spark.createDataFrame([(d, t, 1, 2, "q") for d, t in rows], "doc_id long, text string, k long, n long, row string")
    for source, own in ((df, rows), (documents, [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])):
        for words, percent in ((3, 85), (5, 80)):
            got = neardup.near_duplicates(source, neardup.Params(words=words, percent=percent)).select("d", "n", "component").collect()
            assert sorted(map(tuple, got), key=repr) == sorted(brute_components(own, words, percent), key=repr)
    assert neardup.near_duplicates(documents.limit(0)).count() == 0


def test_links_that_no_hub_sees(spark):
    """A path of texts, each close to the next only: components need links between the outer ones."""
    words = [f"p{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 6 : i * 6 + 120])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, neardup.Params(words=3, percent=85)).select("d", "n", "component").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 3, 85))


@pytest.mark.parametrize("chunk", [1 << 20, 60])
def test_components(spark, chunk):
    """One part of links, and several that stars join: a long path, a star, a cycle, random links and repeated ones."""
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(-50, 40)] + [(500, 500 + i) for i in range(1, 60)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)]
    links += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(170)] + [(2000, 2001)] * 5
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links if a != b]
    root = {x: x for e in links for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            least = min(root[a], root[b])
            moved |= root[a] != root[b]
            root[a] = root[b] = least
    got = neardup.components(spark.createDataFrame(links, "a long, b long"), chunk).collect()
    assert sorted(map(tuple, got)) == sorted((c, r) for c, r in root.items() if c != r)
    assert neardup.components(spark.createDataFrame([], "a long, b long"), chunk).count() == 0


def test_jobs_of_near_duplicates(spark):
    """Nothing is run for links that cannot exist: texts that share no bucket end the search early."""
    def jobs(texts):
        group = f"near-{len(texts)}-{texts[0][:9]}"
        spark.sparkContext.setJobGroup(group, "jobs of near duplicates")
        try:
            neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    rng = random.Random(6)
    apart = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    few, many = jobs(apart), jobs(family(rng, 120, 0.04))
    assert 0 < few <= 40 and few < many <= 90, (few, many)


def test_estimate():
    p = neardup.Params(words=3, percent=85)
    rng = random.Random(8)
    for kept in (0.97, 0.9, 0.7, 0.3):
        a = [f"t{rng.randrange(10**9)}" for _ in range(3000)]
        b = a[: int(3000 * kept)] + [f"u{rng.randrange(10**9)}" for _ in range(3000 - int(3000 * kept))]
        texts = [" ".join(x).encode() for x in (a, b)]
        keys, of = neardup.shingles(texts, 3)
        regs = neardup.registers(keys, of, 2, p)
        sa, sb = (shingle_set(t.decode(), 3) for t in texts)
        assert neardup.estimate(regs[:1], regs[1:], p)[0] == pytest.approx(len(sa & sb) / len(sa | sb), abs=p.slack)


def water(sizes, weights=(5, 2, 1)):
    """Targets by plain resharing of what exceeds the limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix(spark, documents):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), rng.choice(["a", "b", "c", "Z", "é", None, "hot", "hot", "hot"])) for i in range(3000)]
    rows += [(1, None, "a"), (None, "x y", "b"), (7, "w w w", "a"), (7, "w w w", "a"), (7, "w w w", "a"), (9, "", "only empty")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, k long")
    for docs in (df, documents):
        want, taken, count = collections.Counter(), collections.Counter(), collections.Counter()
        for r in docs.select("source", "text").collect():
            want[r["source"]] += len((r["text"] or "").encode().split())
            count[r["source"]] += 1
        out = mixing.with_times(docs, mixing.mix(docs), [F.col("doc_id"), F.col("source"), F.col("text")]).collect()
        assert len(out) == docs.count()
        aims = water(want)
        times = collections.Counter()
        for r in out:
            said = r["__said"]
            n = len((r["text"] or "").encode().split())
            assert said["size"] == n and said["source_size"] == want[r["source"]] and said["target"] == pytest.approx(aims[r["source"]], rel=1e-9, abs=1e-9)
            assert 0 <= said["times"] <= 2
            taken[r["source"]] += n * said["times"]
            times[r["source"]] += said["times"]
        for s, aim in aims.items():
            assert abs(taken[s] - aim) <= max(0.02 * aim, 200), (s, taken[s], aim)
            if want[s] and count[s] > 50:
                assert abs(times[s] - count[s] * aim / want[s]) <= 6
        again = mixing.with_times(docs.repartition(5), mixing.mix(docs.repartition(5)), [F.col("doc_id"), F.col("source"), F.col("text")]).collect()
        assert collections.Counter((r["doc_id"], r["__said"]["times"]) for r in out) == collections.Counter((r["doc_id"], r["__said"]["times"]) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_flight_keeps_constraints():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1000, 500).astype(float)
    pi = np.full(500, 0.37)
    out = mixing.flight(pi, np.vstack([size, np.ones(500)]), rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(pi.sum()) and (out * size).sum() == pytest.approx((pi * size).sum())
    same = mixing.flight(np.full(50, 0.5), np.ones((2, 50)), rng)
    assert ((same > 1e-9) & (same < 1 - 1e-9)).sum() <= 2 and same.sum() == pytest.approx(25)
    # Each step of the flight is a fair game, so every row's mean stays; rounding the last two is not.
    chances = np.mean([mixing.flight(np.full(9, 0.4), np.vstack([np.arange(1.0, 10), np.ones(9)]), r) for r in map(np.random.default_rng, range(900))], 0)
    assert abs(chances - 0.4).max() < 0.06


def test_hypergeometric(spark):
    good, bad, draws, n = 13, 37, 20, 6000
    drawn = spark.range(n).select(sharding.hypergeometric(*[F.lit(x).cast("bigint") for x in (good, bad, draws)], sharding._uniform(F.lit(3), F.col("id"))).alias("x"))
    got = {r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()}
    for x in range(good + 1):
        p = math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws)
        assert abs(got.get(x, 0) - n * p) <= 5 * math.sqrt(n * p) + 2
    edge = spark.createDataFrame([(0, 5, 3), (5, 0, 3), (0, 0, 0), (4, 4, 8), (4, 4, 0), (1, 10**9, 5 * 10**8), (10**8, 10**9, 10**8)], "g long, b long, n long")
    rows = edge.select("g", "b", "n", sharding.hypergeometric(F.col("g"), F.col("b"), F.col("n"), F.lit(0.5)).alias("x")).collect()
    assert [r["x"] for r in rows[:5]] == [0, 3, 0, 4, 0] and abs(rows[6]["x"] - 10**16 / (11 * 10**8)) < 20000


def test_shards(spark, documents):
    rows = [(i, "x") for i in range(700)] + [(None, None)] * 3 + [(5, "x")] * 200
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, part long, shard long, j long")
    for docs, each in ((df, 100), (df, None), (documents, 50)):
        out = sharding.shard(docs, ["doc_id", "text"], 40, rows_each=each).select("doc_id", "text", "shard", "slot").collect()
        held = collections.defaultdict(list)
        for r in out:
            held[r["shard"]].append(r["slot"])
        n = docs.count()
        assert len(out) == n and set(map(len, held.values())) <= {n // 40, n // 40 + 1} and set(held) == set(range(40))
        assert all(sorted(v) == list(range(len(v))) for v in held.values())
        again = sharding.shard(docs.repartition(3), ["doc_id", "text"], 40, rows_each=each).select("doc_id", "text", "shard", "slot").collect()
        assert collections.Counter(map(tuple, out)) == collections.Counter(map(tuple, again))
    few = sharding.shard(df.where("doc_id < 3"), ["doc_id", "text"], 40).collect()
    assert len(few) == 3 and {r["slot"] for r in few} == {0}
    assert sharding.shard(df.limit(0), ["doc_id", "text"], 40).count() == 0
    plan = sharding.shard(df, ["doc_id", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ODD = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\<\\s>", "<<s>s>", "<s", "[INST", "a\nb", "[/INST]</s><s>assistant[INST]", "é🙂", "$1 \\1 %s"]


def test_chat_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "as<s>", "a\nb"][(c * 3 + t * t) % 6], ODD[(c + t) % len(ODD)]) for c in range(30) for t in range(c % 9 + 1)]
    rows += [(1, None, "user", "x"), (1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (99, 1, "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, id long, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        runs = sum(1 for i, (role, _) in enumerate(turns) if i == 0 or turns[i - 1][0] != role)
        assert got[c]["formatted"].count("<s>") == got[c]["formatted"].count("</s>") == runs
        assert got[c]["formatted"].count("[INST]") == len(turns)
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.format_chats(df, chat.Template(open="x"))


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(pages)
    out = html.main_text(pages, model).collect()
    for r in out:
        assert r["text"] == "\n\n".join(b.text for b in html.blocks(r["html"]) if "article" in b.path)
    rng = random.Random(77)
    sentences = [s + "." for r in out[200:] for s in r["text"].split(". ")]
    right = total = 0
    for _ in range(120):
        own = html.blocks(html.layout(rng, sentences))
        x, mask, _ = html.padded([(html.features(own), np.zeros(len(own)))])
        right += sum((s > 0) == bool(b.label) for b, s in zip(own, model.scores(x, mask)[0]))
        total += len(own)
    assert right / total > 0.985
    edge = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (None, "plain text", "u"), (3, "<article><p>a &amp; b<p>c&nbsp;&lt;d", "u"), (3, "<article><p>a &amp; b<p>c&nbsp;&lt;d", "u"),
                                  (4, "<" * 5000, "u"), (5, "<div>" * 3000 + "x", "u"), (6, "<article><p>" + "word " * 100_000 + "</p></article>", "u")], "page_id long, html string, row string")
    got = {r["page_id"]: r["text"] for r in html.main_text(edge, model).collect()}
    assert got[1] == got[2] == "" and got[6] == ("word " * 100_000).strip() and got[3] == "a & b\n\nc <d"
    assert html.main_text(edge.limit(0), model).count() == 0 and html.fit(edge.limit(0)) is not None


def test_blocks():
    page = "<nav><a href='x'>Go</a></nav><!-- <p>no</p> --><article><h1>T &amp;amp;</h1><p>one <b>two<br>three<p>four</p><script>var a='</p>';</script><ul><li>x<li>y</ul><p>last"
    assert [b.text for b in html.blocks(page)] == ["Go", "T &amp;", "one two three", "four", "x", "y", "last"]
    assert [b.path[-1] for b in html.blocks(page)] == ["nav", "h1", "p", "p", "li", "li", "p"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    """Each query next to its SQL where there is some; one row per document, page or conversation where the contract says so."""
    from checks.compare import compare, connect

    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE.get(name), SF) is None
    table = {"op5": None, "op3": None, "op10": None, "op9": "pages"}.get(name.split("_")[0], "documents")
    if table:
        assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def stage_by_stage(spark, docs):
    from tabscout.llm.common import stored

    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_pipeline(spark, documents):
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, "a b", None, None, 1), (9003, "w " * 90_000, "en", "s", 1)], documents.schema)
    copies = documents.limit(3)
    docs = documents.unionByName(extra).unionByName(copies).withColumn("quality", F.lit("own")).withColumn("k", F.lit(1)).withColumn("__row", F.lit(2))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "source mix", "sharding"]
    one, two, three, four, five = stage_by_stage(spark, docs)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for df in (one, two, three, four):
        assert df.columns == docs.columns
    first, second, third, fourth = map(rows, (one, two, three, four))
    want = {}
    for (d, t), (_, _, c) in zip(first, brute_components(first, 5, 80)):
        want[c] = min(want.get(c, d), d)
    assert sorted(d for d, _ in second) == sorted(want.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flat = lambda t: " ".join(t.lower().split())
    dirty = {d for d, t in second if any(flat(x) in flat(t) for x in items)}
    assert dirty and {d for d, _ in second} - {d for d, _ in third} == dirty
    assert set(fourth) <= set(third) and max(collections.Counter(fourth).values()) <= 2
    held = collections.Counter(r["shard"] for r in five.select("shard").collect())
    assert collections.Counter(rows(five)) == collections.Counter(fourth) and max(held.values()) - min(held.get(i, 0) for i in range(40)) <= 1
    assert collections.Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "shard", "slot").collect())) == collections.Counter(
        map(tuple, stage_by_stage(spark, documents)[-1].select("doc_id", "shard", "slot").collect()))


def test_pipeline_on_an_empty_table(spark, documents):
    assert stage_by_stage(spark, documents.limit(0))[-1].count() == 0
