"""Exact top-k and hard negatives against brute force: ties, repeats, unusable vectors, several dimensions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import blocks, hard_negatives, segments

SCHEMA = "vec_id long, embedding array<float>, label int, v int, dim string, block int"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return tuple(math.floor(scale * float(np.float32(x))) for x in v)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def first(found, k):
    best = {}
    for s, i in found:
        best[i] = max(s, best.get(i, s))
    return sorted(((s, i) for i, s in best.items()), key=lambda t: (-t[0], t[1]))[:k]


def brute_top(rows, every, k):
    usable = [(i, v) for i, v, *_ in rows if i is not None and good(v)]
    out = set()
    for i in {i for i, _ in usable if i % every == 0}:
        q = whole(min(v for j, v in usable if j == i), 64)
        found = [(dot(q, whole(v, 64)), j) for j, v in usable if j != i and len(v) == len(q)]
        out |= {(i, r + 1, j, s) for r, (s, j) in enumerate(first(found, k))}
    return out


def brute_negatives(rows, every):
    usable = [(i, label, whole(v, 256), v) for i, v, label, *_ in rows if i is not None and label is not None and good(v)]
    out = set()
    for i in {r[0] for r in usable if r[0] % every == 0}:
        _, label, _, q = min((r for r in usable if r[0] == i), key=lambda r: (r[1], r[3]))
        q = whole(q, 256)
        scores = [(dot(q, w), j, lab) for j, lab, w, _ in usable if j != i and len(w) == len(q)]
        for ps, p in first([(s, j) for s, j, lab in scores if lab == label], 5):
            near = [(s, j) for s, j, lab in scores if lab != label and 30 * ps <= 100 * s <= 90 * ps]
            out |= {(i, p, r + 1, j, ps, s) for r, (s, j) in enumerate(first(near, 10))}
    return out


def vectors(n=900, d=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d)) * 2
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d))
    x[200:500] = x[199]
    rows = [(k, [float(np.float32(a)) for a in v], int(rng.integers(0, 4))) for k, v in enumerate(x)]
    rows += [(n, None, 1), (n + 1, [float("nan")] * d, 1), (n + 2, [float("inf")] * d, 1), (n + 3, [1.0, None], 1), (None, [1.0] * d, 1), (n + 4, [0.0] * d, None), (1000, [0.0] * d, 2)]
    rows += [(k, [float(k - 2000), 1.0], k % 2) for k in range(2000, 2030)] + [(2100, [], 1), (2101, [], 2)]
    rows += rows[:5] + [(7, rows[60][1], 3), (100, rows[61][1], 2), (100, rows[62][1], 1)] * 2
    random.Random(seed).shuffle(rows)
    return [(i, v, label, 1, "x", 2) for i, v, label in rows]


def top(spark, rows, every=20, k=20, sizes=(7, 64)):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {tuple(r) for r in segments.top_k(df, df.where(f"vec_id % {every} = 0"), k, blocks=sizes).collect()}


@pytest.mark.parametrize("sizes", [(7, 64), (512, 4096)])
def test_top_k_equals_brute_force(spark, sizes):
    rows = vectors()
    assert top(spark, rows, sizes=sizes) == brute_top(rows, 20, 20)


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for sizes in ((7, 64), (512, 4096)):
        got = {tuple(r) for r in hard_negatives.mine(df, lambda i: i % 20 == 0, F.col("label"), blocks=sizes).collect()}
        want = brute_negatives(rows, 20)
        assert got == want and len({r[0] for r in want}) > 30


def test_scores_beyond_double_precision(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(a)) for a in rng.normal(size=3) * 3e6], k % 2, 1, "x", 2) for k in range(60)]
    assert top(spark, rows, k=5) == brute_top(rows, 20, 5)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert segments.top_k(df, df).count() == 0
    assert hard_negatives.mine(df, lambda i: i % 100 == 0, F.col("label")).count() == 0
    assert top(spark, [(0, [1.0], 1, 1, "x", 1)]) == set()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.normal(size=(8, 32)), 40, axis=0) + 0.05 * rng.normal(size=(320, 32)))).astype(np.int64)
    q = x[::8]
    stats, own = segments.statistics(x), segments.statistics(q)
    exact, at = (q @ x.T).astype(float), 0
    for count in segments.RESOLUTIONS:
        part = slice(at, at := at + 2 * count)
        assert (own[:, part] @ stats[:, part].T >= exact - 1e-3).all()
    pivots = {32: hard_negatives.far_apart(x.astype(float), 12)}
    low, high = hard_negatives.brackets(pivots, q.astype(float), hard_negatives.table(pivots, x))
    assert (low <= exact).all() and (exact <= high).all()
    tenth = np.sort(exact, axis=1)[:, -10, None]
    assert (high >= tenth).mean() < 0.5
    block = lambda a, s: blocks.Block(np.arange(len(a)), np.zeros((len(a), 0), np.int64), a, s)
    alive, _ = segments.surviving(block(q, own), block(x, stats), tenth[:, 0], np.ones(exact.shape, bool))
    assert alive.mean() < 0.5 and alive[exact >= tenth].all()
