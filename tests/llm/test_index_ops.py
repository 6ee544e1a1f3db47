"""Licence scan, hard negatives and centroid clustering against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from tabscout.llm import clusters, licenses, negatives, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_license_index", "op12_tree_negatives", "op13_shallot_clusters"])
def test_registered(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE[name], SF) is None


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_licences(texts):
    sets = [words(t) for t in texts]
    rarity = {w: math.floor(1000 * math.log((1 + len(texts)) / (1 + sum(w in s for s in sets)))) + 1 for t in licenses.TEMPLATES for w in t.words}
    out = []
    for s in sets:
        places = []
        for t in licenses.TEMPLATES:
            rare = licenses.index_words(t, rarity)
            for start in range(-len(t.words), len(s)):
                here = [0 <= start + i < len(s) and s[start + i] == w for i, w in enumerate(t.words)]
                got, total = sum(rarity[w] for w, h in zip(t.words, here) if h), sum(rarity[w] for w in t.words)
                if sum(h for w, h in zip(t.words, here) if w in rare) >= 2 and all(h for h, k in zip(here, t.key) if k) and 2 * got >= total:
                    places.append((t, start, got / total))
        base = [p[1] for p in places if p[0].base]
        join = lambda ps: ",".join(sorted({p[0].label for p in ps}))
        out.append((len(s), len(base), min(base, default=None), max(base, default=None), join([p for p in places if p[0].base]), join(places), max((p[2] for p in places), default=0.0)))
    return out


def test_licences(spark):
    rng = random.Random(11)
    filler = "the of license mit under cc by nc version 2 apache software any gnu lorem ipsum K KK é l'été 中文".split()
    texts = [None, "", " \n\t", "Under the MIT license", "under the mit licence", "CC BY-NC 4.0, cc-by-nc; cc by\x00nc", "cc by ncé", "Apache License, Version 2.0 apache license version 2 apache license version 20",
             "under the mit license under the mit license", "w " * 30000 + "under the mit license", "under the miİt license"]
    for t in licenses.TEMPLATES:
        some = t.words
        texts += [" ".join(some), "x " + "-".join(some[len(some) // 2:]).upper() + " y", " ".join(some[:len(some) // 2])]
        texts += [" ".join(w if rng.random() < 0.9 else rng.choice(filler) for w in some) for _ in range(4)]
    texts += [" ".join(rng.choice(filler) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    rows = [(i if i % 7 else None, t, "kept", i) for i, t in enumerate(texts)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __words string, licence int")
    found = licenses.scan(docs.withColumn("at", F.monotonically_increasing_id())).orderBy("at").collect()
    want = brute_licences([r[1] for r in rows])
    got = [tuple(r["licence"][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in found]
    assert got == want and sum(w[1] for w in want) > 10 and {"gpl-3", "bsd", "mit"} <= {x for w in want for x in w[5].split(",")}
    assert all(r["__words"] == "kept" for r in found)
    assert licenses.scan(docs.limit(0)).collect() == []


def brute_negatives(rows, p, is_anchor):
    use = [(i, l, [math.floor(p.scale * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i)
    out = []
    for n, (i, l, v) in enumerate(use):
        if i is not None and is_anchor(i):
            met = [(sum(a * b for a, b in zip(v, w)), o, m) for k, (o, m, w) in enumerate(use) if k != n and len(w) == len(v)]
            order = lambda s: (-s[0], last(s[1]))
            for score, pos, _ in sorted((s for s in met if s[2] == l), key=order)[: p.positives]:
                fit = sorted((s for s in met if s[2] != l and p.low * score <= 100 * s[0] <= p.high * score), key=order)[: p.negatives]
                out += [(i, pos, r + 1, o, score, s) for r, (s, o, _) in enumerate(fit)]
    return out


def vectors(rng, n, d, spread=1.0):
    centre = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [[c + spread * rng.gauss(0, 1) for c in rng.choice(centre)] for _ in range(n)]


POINTS = "vec_id bigint, label int, embedding array<float>, row int"


@pytest.mark.parametrize("parts", [1, 5])
def test_negatives(spark, parts):
    rng = random.Random(12)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, i % 3 if i % 4 else 1, f32(v)) for i, v in enumerate(vectors(rng, 400, 6))]
    rows += [(500 + i, i % 2, f32(v)) for i, v in enumerate(vectors(rng, 40, 3))] + [(i, 0, []) for i in (600, 601)] + [(602, 1, [])]
    rows += [(7000 + i, rng.randrange(3), [0.5] * 6) for i in range(200)]  # one vector many times
    rows += [rows[10], rows[10], rows[20], (None, 1, rows[30][2]), (None, 2, rows[30][2]), (20, 2, rows[20][2])]
    rows += [(20, None, rows[5][2]), (40, 1, None), (60, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (80, 1, [math.nan] + [0.0] * 5), (80, 1, [math.inf] + [0.0] * 5), (20, 9, [0.0] * 6)]
    points = spark.createDataFrame([(*r, 1) for r in rows], POINTS).repartition(parts)
    p = negatives.Params(positives=3, negatives=4)
    found = negatives.hard_negatives(points, F.col("vec_id") % 10 == 0, p)
    got = sorted(map(repr, map(tuple, found.collect())))
    assert got == sorted(map(repr, brute_negatives(rows, p, lambda i: i % 10 == 0))) and len(got) > 200
    assert negatives.hard_negatives(points.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_tree_prunes():
    """Clustered vectors: a best-first search meets a small part of the rows, and finds what all rows would give."""
    rng = np.random.default_rng(5)
    centre = rng.normal(0, 300, (40, 8))
    codes = np.floor(centre[rng.integers(0, 40, 4096)] + rng.normal(0, 5, (4096, 8))).astype(np.int64)
    packed = negatives.tiles(codes, np.arange(4096))
    assert sorted(np.concatenate(packed).tolist()) == list(range(4096)) and max(map(len, packed)) <= negatives.LEAF
    at = np.concatenate(packed)
    row = {"ids": at.astype(np.int64).tobytes(), "labels": np.zeros(4096, np.int64).tobytes(), "asks": bytes(4096), "codes": codes[at].tobytes(), "dim": 8, "tree": 3,
           "leaves": np.cumsum([len(t) for t in packed]).astype(np.int64).tobytes()}
    tree = negatives.Tree(row)
    low = np.full(4, negatives.LOWEST)
    search = negatives.Search(codes[:4], np.zeros(4, np.int64), np.full(4, 10**12), np.arange(4), low, -low, 5, True)
    search.visit(tree)
    search.settle()
    for q in range(4):
        scores = codes @ codes[q]
        want = sorted(zip((-scores).tolist(), range(4096)))[:5]
        assert [(-s, i) for o, s, i in zip(*search.found) if o == q] == want
    assert search.scored < 4 * 4096 / 2


def brute_kmeans(rows, k, rounds, scale, dimension, seed):
    use = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(use, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in use]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(use, of) if o == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [nearest(v) for _, v in use]
    return [(i, n, d, sum(x[1] == n for x in last), sum(x[0] for x in last if x[1] == n), sum(x[0] for x in last), centroids[n]) for (i, _), (d, n) in zip(use, last)]


@pytest.mark.parametrize("k,rounds,spread", [(8, 6, 0.3), (5, 10, 2.0), (1, 2, 1.0), (12, 3, 0.1), (3, 0, 1.0)])
def test_kmeans(spark, k, rounds, spread):
    rng = random.Random(k)
    rows = [(i, v) for i, v in enumerate(vectors(rng, 300, 5, spread))]
    rows += [(i, [float(rng.randrange(3)) for _ in range(5)]) for i in range(400, 500)]  # ties
    rows += [(900 + i, [2.0] * 5) for i in range(100)] + [rows[3], rows[3], (None, rows[4][1]), (None, [1.0] * 5)]
    rows += [(1, None), (2, []), (3, [1.0] * 4), (4, [1.0] * 6), (5, [1.0, None, 1.0, 1.0, 1.0]), (6, [math.nan] * 5), (7, [-math.inf] * 5), (8, [math.inf] * 5)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    points = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, id int")
    got = [tuple(r) for r in clusters.kmeans(points, k, rounds, 16, 5, 3).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_kmeans(rows, k, rounds, 16, 5, 3)))
    assert clusters.kmeans(points.limit(0), k).collect() == [] and clusters.kmeans(points, 500, 1, 16, 4).count() == 1


def test_shallot_equals_scan():
    """Bounds and search give every vector its nearest centroid while centroids move, and skip most distances."""
    rng = np.random.default_rng(13)
    codes = rng.integers(-50, 50, (2000, 4)) + 400 * rng.integers(0, 4, (2000, 1))
    centroids, before, state = codes[:20].copy(), None, None
    for _ in range(8):
        state = clusters.Round(centroids, before).assign(codes, state)
        d = ((codes[:, None] - centroids[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        rest = np.where(np.arange(20)[None] == state[0][:, None], 2**60, d).min(1)
        assert (state[2] ** 2 >= d.min(1) * (1 - 1e-6)).all() and (state[3] ** 2 <= rest * (1 + 1e-6)).all()
        before, centroids = centroids, np.array([codes[state[0] == c].sum(0) // max((state[0] == c).sum(), 1) if (state[0] == c).any() else centroids[c] for c in range(20)])
