"""Repeated ids, clashing names, empty tables and recall over several blocks of queries."""

import numpy as np

from strandmill.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    own, out = {}, set()
    for i, v in rows:
        own.setdefault(i, []).append(np.array(v, np.float32).astype(np.float64))
    for i in queries:
        q = min(own[i], key=tuple)
        near = sorted((min(np.sqrt(((x - q) ** 2).sum()) for x in xs), j) for j, xs in own.items() if j != i)[:k]
        out |= {(i, r + 1, j, round(float(d), 9)) for r, (d, j) in enumerate(near)}
    return out


def found(spark, rows, queries, k=10):
    table = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], SCHEMA)
    got = ann.nearest(table, table.where(table.vec_id.isin(queries)), k)
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect()}


def test_twelve_equal_rows_of_one_id(spark):
    rng = np.random.default_rng(1)
    rows = [(0, rng.normal(size=6))] + [(1, rng.normal(size=6))] * 12 + [(k, rng.normal(size=6)) for k in range(2, 15)]
    assert found(spark, rows, [0, 1]) == brute(rows, [0, 1], 10)


def test_two_vectors_of_one_id(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 20, rng.normal(size=5)) for k in range(40)]
    assert found(spark, rows, [0, 7, 19]) == brute(rows, [0, 7, 19], 10)


def test_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=24) * rng.gamma(2)) for k in range(3000)]
    queries = list(range(0, 3000, 60))
    want = brute(rows, queries, 10)
    assert len(found(spark, rows, queries) & want) >= 0.9 * len(want)


def test_packed_codes():
    codes = np.array([[1, 15, 7], [0, 3, 9]], np.uint8)
    tables = np.random.default_rng(4).normal(size=(3, 16, 5)).astype(np.float32)
    want = sum(tables[s][codes[:, s]] for s in range(3))
    assert ann.packed(codes).shape == (2, 2) and np.allclose(ann.scan(ann.packed(codes), tables), want)


def test_no_rows_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 3, 4), (2, [0.0, 1.0], 3, 4), (None, [1.0, 1.0], 3, 4), (3, None, 3, 4), (4, [0.0, 0.0], 3, 4)]
    table = spark.createDataFrame(rows, SCHEMA + ", v int, codes int")
    assert ann.nearest(table.limit(0), table).count() == 0
    assert ann.nearest(table, table.limit(0)).count() == 0
    assert {(r.query_id, r.vec_id) for r in ann.nearest(table, table).collect()} == {(1, 2), (2, 1)}
