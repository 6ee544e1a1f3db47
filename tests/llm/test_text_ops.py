"""Lines, spans, quality, tokens and decontamination against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.llm import arrays, decontam, lines, quality, spans, tokens

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
LONG = "this line is long enough to count as a shared line of text"
EDGES = [(1, LONG + "\nalpha"), (2, "  " + LONG.upper() + "\t\nbeta\n"), (3, LONG), (4, LONG + "\n" + LONG), (5, None), (6, ""), (7, LONG + "\nshort"), (7, LONG + "\nshort"),
         (None, LONG), (None, None), (8, "\n\n"), (9, ("word " * 30_000).strip()), (10, "é" * 45), (11, " " + LONG), (12, LONG + "\r")]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    """Null, empty, long, tied and repeated rows, and columns whose names an operator uses inside."""
    return spark.createDataFrame([(d, t, "x", 1, 2, "z") for d, t in EDGES], "doc_id long, text string, source string, k long, d long, row string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows):
    held = collections.defaultdict(set)
    key = lambda line: lower(line.strip(BLANK))
    low = lambda d: -1 if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(low(d))
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(held[key(x)]) < 5 or low(d) == max(held[key(x)])]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_lines(spark, documents, edges):
    for df in (edges, documents.select("doc_id", "text")):
        got = lines.apply_keep(df, lines.line_keep(df)).collect()
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert ordered(got) == ordered(brute_lines(rows))
    kept = lines.line_keep(edges).collect()
    for r in kept:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=r["n_lines"])
        assert r["n_dropped"] == r["n_lines"] - bits.sum()
    assert lines.apply_keep(edges.limit(0), lines.line_keep(edges.limit(0))).count() == 0


def test_hot_line_over_many_parts(spark):
    """One line in all documents and in most partitions, and keys that end where parts end."""
    rows = [(i, "\n".join([LONG] * (1 + i % 3) + [f"{LONG} {i % 40}"] + [f"{LONG} own {i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert ordered(lines.apply_keep(df, lines.line_keep(df)).collect()) == ordered(brute_lines(rows))


def test_line_batches():
    """A part's rows may come in batches of any size."""
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted(((rng.randrange(6), 0, rng.randrange(9), 0, p) for p in range(300)), key=lambda r: (r[0], r[1], -r[2], r[4]))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int32() if i == 4 else pa.int64()) for i in range(5)], names=["h1", "h2", "d", "k", "pos"])
    docs = {h: {r[2] for r in rows if r[0] == h} for h in range(6)}
    want = [r[2:] for r in rows if len(docs[r[0]]) >= 5 and r[2] != max(docs[r[0]])]
    for size in (1, 2, 7, 300):
        parts = [batch(rows[i : i + size]) for i in range(0, 300, size)]
        edge = list(lines._edges(iter(parts)))[0].to_pylist()
        assert {r["h1"]: (r["n"], r["top"]) for r in edge} == {h: (len(docs[h]), max(docs[h])) for h in (0, 5)}
        for known in ({}, {(h, 0): (len(docs[h]), max(docs[h])) for h in (0, 5)}):
            got = [tuple(r.values()) for b in lines._stream(known, 5)(iter(parts)) for r in b.to_pylist()]
            assert sorted(got) == sorted(want)


def brute_quality(text):
    text = text or ""
    words = [m.group() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def test_quality(documents, edges):
    extra = [(100, "a b c\n" * 40), (101, "a b c a b c"), (102, "x\n\nx\n \nx"), (103, "# <>|&$%*" * 9), (104, "a\x1cb\x85c d e")]
    more = edges.sparkSession.createDataFrame(extra, "doc_id long, text string")
    for df in (documents, edges, more):
        got = quality.quality(df).select("text", "quality.*").collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(r["text"])
    assert quality.quality(edges).columns == [*edges.columns, "quality"]
    assert quality.quality(documents.limit(0)).count() == 0


def test_quality_keeps_labelled_good_documents(spark):
    """The rules keep what is labelled good and is long enough, and drop most of what is labelled bad."""
    sf = "/root/testdata/sf0.01"
    judged = quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), into="found")
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select(F.col("quality").alias("good"), "found.*").collect()
    good = [r["kept"] for r in rows if r["good"] and not r["base_failed"]]
    bad = [r["kept"] for r in rows if not r["good"]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.4


def test_coverage_shares():
    text = b"one two three four five six seven one two three four five six seven end"
    found = quality.measure([text, b"same line here\nsame line here\nother", b""], (2, 3, 5, 8))
    chars = sum(map(len, text.split()))
    assert found["gram_5"][0] == pytest.approx((chars - 3) / chars) and found["gram_8"][0] == 0
    assert found["lines"][1] == pytest.approx(12 / 29) and found["lines"][2] == 0


def brute_spans(rows, n=spans.SENTENCES, least=spans.WORDS):
    """Covered byte ranges by plain loops; only the class of a word's hash comes from the arrays."""
    seen, out = {}, {}
    low = lambda d: -(2**63) if d is None else d
    for d, t in sorted(rows, key=lambda r: low(r[0])):
        raw = (t or "").encode()
        words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        hashed = arrays.Words.of([raw], lower=True).hashes.tolist()
        sentences, begin = [], 0
        for i, (a, b) in enumerate(words):
            gap = raw[b : words[i + 1][0]] if i + 1 < len(words) else b""
            if raw[b - 1 : b] in (b".", b"!", b"?", b",", b";", b":") or b"\n" in gap or hashed[i] % spans.EVERY == 0 or i == len(words) - 1:
                sentences.append((begin, i + 1))
                begin = i + 1
        for s in range(len(sentences)):
            e = next((e for e in range(s + n - 1, len(sentences)) if sentences[e][1] - sentences[s][0] >= least), None)
            if e is not None:
                span = words[sentences[s][0]][0], words[sentences[e][1] - 1][1]
                key = tuple(lower(raw[a:b].decode("latin1")) for a, b in words[sentences[s][0] : sentences[e][1]])
                if key in seen and seen[key] != (d, span[0]):
                    out.setdefault(d, set()).update(range(*span))
                seen.setdefault(key, (d, span[0]))
    return out


def test_spans(documents, edges):
    for df in (documents.select("doc_id", "text"), edges.where("doc_id IS NULL OR doc_id <> 7")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = brute_spans([r for r in rows if r[0] is not None or r[1] is not None])
        got = spans.repeated_spans(df).collect()
        covered = {None if r["d"] == -(2**63) else r["d"]: {i for s in r["spans"] for i in range(s["first"], s["first"] + s["size"])} for r in got}
        blank = {d: {i for i, b in enumerate((t or "").encode()) if b in b" \t\n\x0b\x0c\r"} for d, t in rows}
        assert {d: v - blank[d] for d, v in covered.items()} == {d: v - blank[d] for d, v in want.items()}
    cleaned = spans.without_spans(documents, spans.repeated_spans(documents))
    assert cleaned.count() == documents.count()
    assert spans.repeated_spans(documents.limit(0)).count() == 0


def test_span_passage_of_51_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", "", "", ".", ","])
    passage = " ".join(word() for _ in range(51))
    rows = [(i, " ".join([*(word() for _ in range(80)), passage if i < 3 else "", *(word() for _ in range(40))])) for i in range(12)]
    got = {r["d"]: r["spans"] for r in spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 2}
    texts = {r["d"]: r["text"] for r in spans.without_spans(spark.createDataFrame(rows, "doc_id long, text string"), spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert texts[0] == rows[0][1] and len(texts[1].split()) < 171 - 30


def machine():
    sentencepiece = pytest.importorskip("sentencepiece")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_tokens(documents, edges):
    path, library = machine()
    for df in (documents, edges):
        for r in tokens.token_counts(df, path).select("text", "tokens.*").collect():
            text = r["text"] or ""
            n = len(library.encode(text))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
    assert tokens.token_counts(edges.limit(0), path).count() == 0


def test_transducer_on_odd_texts(monkeypatch):
    path, library = machine()
    made = tokens.Transducer.of_sentencepiece(library)
    rng = random.Random(1)
    alphabet = "abcdehilnorstu  ▁▁éß.,'\n\t0123<s>[]{}=()/*-_\"zq中文한🙂  İ"
    texts = ["", " ", "   ", "▁", "a" * 5000, "<s>[INST]</s><0x41><unk>", " ".join(["▁▁a"] * 3000)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    want = [len(x) for x in library.encode(texts)]
    assert tokens.counts(library.normalize(texts), made).tolist() == want
    monkeypatch.setattr(tokens, "STATES", 50)  # states are forgotten again and again
    monkeypatch.setattr(tokens, "CHUNK", 5)
    assert tokens.counts(library.normalize(texts), tokens.Transducer.of_sentencepiece(library)).tolist() == want


def edit_distance_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 30)))) for i in range(8)] + [(50, None), (51, "short"), (52, "")]
    rows = [(900, None), (901, ""), (None, items[0][1]), (902, ("pad " * 50_000) + items[1][1].upper())]
    for n in range(60):
        i, text = items[n % 8]
        t = list(text)
        for _ in range(n // 4):
            p, how = rng.randrange(len(t)), rng.random()
            t[p : p + 1] = ["z"] if how < 0.34 else [] if how < 0.67 else [t[p], "q"]
        pad = " ".join(word() for _ in range(rng.randrange(30)))
        rows.append((n, f"{pad}  {''.join(t)}\n{pad}"))
    rows.append(rows[5])
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, row long, body string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rule in (decontam.Rule(), decontam.Rule(block_chars=200)):
        found = decontam.find_items(docs, bench, rule).select("doc_id", "text", "found").collect()
        assert len(found) == len(rows)
        index = decontam.Index([i for i, _ in items[:8]], [decontam.normal(t) for _, t in items[:8]], rule)
        for r in found:
            text = decontam.normal(r["text"] or "")
            want = {i: e for i, t, k in zip(index.ids, index.texts, index.budget) if (e := edit_distance_inside(t, text[-2000:])) <= k}
            assert {x["item_id"]: x["edits"] for x in r["found"]} == want, r["doc_id"]
    assert decontam.find_items(docs, bench.limit(0)).where(F.size("found") > 0).count() == 0
    assert decontam.find_items(docs.limit(0), bench).count() == 0


def test_sha_of_kept_text(spark, documents):
    """The digest is over UTF-8."""
    df = spark.createDataFrame([(1, "é\nü")], "doc_id long, text string")
    out = lines.apply_keep(df, lines.line_keep(df)).select(F.sha2("text", 256)).first()[0]
    assert out == hashlib.sha256("é\nü".encode()).hexdigest()
