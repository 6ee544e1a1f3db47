"""Each test holds a case that an operator once left out."""

import dataclasses
import random

import numpy as np
import pytest

from tabscout.llm import decontam, html, queries, quality, spans


def made_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def planted(rng, copies, length, total):
    """A text of ``total`` words that holds one run of ``length`` words ``copies`` times over, and so often other such runs, apart."""
    own, out = made_words(rng, length), []
    for _ in range(copies):
        out += [*own, *made_words(rng, 3)]
    return out + made_words(rng, total - len(out))


def phrases(rng, length, runs, total):
    """``runs`` runs of ``length`` words, each twice and never side by side, in ``total`` words."""
    own = [made_words(rng, length) for _ in range(runs)]
    out = [w for run in [*own, *own] for w in (*run, *made_words(rng, 1))]
    return " ".join(out + made_words(rng, total - len(out)))


def test_each_coverage_limit_rejects_alone():
    """A text that passes the base rule is rejected by one limit, and kept without it."""
    rng = random.Random(2)
    menu = "\n".join(x for w in made_words(rng, 40) for x in ("Navigation", w))
    cases = {2: phrases(rng, 2, 70, 420), 3: phrases(rng, 3, 30, 420), 5: phrases(rng, 5, 14, 420), 8: phrases(rng, 30, 2, 440), "lines": menu}
    rules = quality.Rules()
    for case, text in cases.items():
        found = quality.measure([text.encode()], tuple(n for n, _ in rules.grams))
        failed, kept = quality.judge(found, rules)
        assert not failed[0] and not kept[0], case
        without = dataclasses.replace(rules, grams=tuple(g for g in rules.grams if g[0] != case), most_line_chars=1.0 if case == "lines" else rules.most_line_chars)
        assert quality.judge(found, without)[1][0], case


@pytest.mark.parametrize("share", [30, 40, 49])
def test_a_paragraph_pasted_twice_is_rejected(share):
    rng = random.Random(share)
    clean = [" ".join(made_words(rng, 1000)).encode(), " ".join(planted(rng, 2, 40, 1000)).encode()]
    pasted = " ".join(planted(rng, 2, 5 * share, 1000)).encode()
    failed, kept = quality.judge(quality.measure([*clean, pasted], (2, 3, 5, 8)), quality.Rules())
    assert not failed.any() and kept.tolist() == [True, True, False]


def shared_cover(one, two, **how):
    """Of the second text, which bytes lie in a run of the first."""
    doc, h1, h2, first, size, _ = spans.runs([one.encode(), two.encode()], **how)
    known = set(zip(h1[doc == 0].tolist(), h2[doc == 0].tolist()))
    out = np.zeros(len(two.encode()), bool)
    for a, b, at, n in zip(h1[doc == 1].tolist(), h2[doc == 1].tolist(), first[doc == 1].tolist(), size[doc == 1].tolist()):
        if (a, b) in known:
            out[at : at + n] = True
    return out


def test_passage_of_51_words_without_punctuation():
    """Found for every seed, all but its outer words, and nothing else."""
    for seed in range(300):
        rng = random.Random(seed)
        passage = " ".join(made_words(rng, 51))
        one, two = (" ".join([*made_words(rng, 30), passage, *made_words(rng, 30)]) for _ in range(2))
        cover = shared_cover(one, two, close=True)
        at = two.index(passage)
        assert cover[at : at + len(passage)].sum() >= 38 * 7 and not cover[:at].any() and not cover[at + len(passage) :].any(), seed


def test_passage_in_a_script_without_blanks():
    for seed in range(50):
        rng = random.Random(seed)
        made = lambda n: "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(n))
        passage = made(120)
        one, two = made(50) + passage + made(50), made(50) + passage + made(50)
        assert shared_cover(one, two, close=True).sum() >= 3 * 100, seed


def test_no_repeated_sentence_stays_behind_the_last_run():
    for seed in range(100):
        rng = random.Random(seed)
        passage = " ".join(" ".join(made_words(rng, rng.randint(3, 9))) + rng.choice(".!?。؟") for _ in range(9))
        one, two = (" ".join(made_words(rng, 20)) + ".\n" + passage + "\n" + " ".join(made_words(rng, 20)) for _ in range(2))
        at = len(two[: two.index(passage)].encode())
        assert shared_cover(one, two, close=True)[at : at + len(passage.encode())].all(), seed


def test_query_finds_passage_without_punctuation(spark, tmp_path):
    """As registered: for every seed the later copy, and no other document."""
    rows = []
    for seed in range(60):
        rng = random.Random(seed)
        passage = " ".join(made_words(rng, 51))
        rows += [(2 * seed + i, " ".join([*made_words(rng, 30), passage, *made_words(rng, 30)])) for i in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_bytes"] for r in queries.op3_sentence_spans(spark, str(tmp_path)).collect()}
    assert set(found) == {2 * s + 1 for s in range(60)} and min(found.values()) >= 38 * 7 - 1


def test_hot_run_over_many_parts(spark):
    """One passage in every document and all parts: each copy but the first is found, once."""
    rng = random.Random(8)
    passage = " ".join(made_words(rng, 51))
    df = spark.createDataFrame([(i % 900, passage) if i < 900 else (i - 900, passage) for i in range(1000)], "doc_id long, text string")
    for close in (False, True):
        got = spans.repeated_spans(df, close=close).collect()
        assert sorted(r["d"] for r in got) == list(range(1, 900)) and all(len(r["spans"]) == 1 for r in got)


@pytest.mark.parametrize("part", [
    "<video-player src=x></video-player>", "<object-list>a</object-list>", "<select-menu>a</select-menu>", '<svg width="1"/>', '<svg viewBox="0 0 1 1" />',
    "<datalist><option>a<option>b</datalist>", '<div data-y="">a</div>', '<div data-y="1.5">a</div>', '<script data-x="a>b">var a;</script>'])
def test_blocks_behind_odd_parts_stay(part):
    assert html.blocks(f"<article><p>First.</p>{part}<p>Last words.</p></article>", labelled=False)[-1].text == "Last words."


@pytest.mark.parametrize("tag", ["math", "object", "canvas", "noscript"])
def test_text_of_embedded_parts_is_labelled(tag):
    assert "inner words" in [b.text for b in html.blocks(f"<article><p>First.</p><{tag}>inner words</{tag}><p>Last.</p></article>")]


def test_raw_text_is_no_block():
    page = "<p>a</p><svg><path d=x /></svg><script>b</script><style>c</style><select><option>d</select><p>e</p>"
    assert [b.text for b in html.blocks(page)] == ["a", "e"]


def test_short_half_and_edited_items_are_found(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(made_words(rng, n))
    long, forty = text(300), "".join(rng.choice("abcdefgh") for _ in range(40))
    near = forty[:8] + "z" + forty[9:19] + "z" + forty[20:30] + "z" + forty[31:]
    bench = spark.createDataFrame([(1, "What is 6 x 7?"), (2, long), (3, forty)], "item_id long, text string")
    docs = [(0, text(90)), (1, f"{text(20)} what is  6 X 7? {text(20)}"), (2, f"{text(20)}what is 6 x 7? {text(9)}"), (3, f"{text(30)} {long[500:1550]} {text(30)}"), (4, f"{text(5)} {near} {text(5)}")]
    found = decontam.find_items(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: [(x["item_id"], x["edits"]) for x in r["found"]] for r in found} == {0: [], 1: [(1, 0)], 2: [], 3: [(2, 0)], 4: [(3, 3)]}
