"""Substring dedup: rows of one id, slices over batches, empty tables and clashing names."""

from strandmill.llm import substring_dedup as sd

RUN = " ".join(f"w{k}" for k in range(20))


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, RUN, 5), (2, "a " + RUN, 5), (2, RUN + " b", 5), (2, "c d", 5), (None, RUN, 5), (None, None, 5), (3, RUN, 5), (3, RUN, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag int")
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in sd.dedup(docs).collect())
    assert got == [(1, 20, 0), (2, 2, 0), (2, 21, 20), (2, 21, 20), (3, 20, 20), (3, 20, 20), (99, 0, 0), (99, 20, 20)]
    assert sd.dedup(docs.limit(0)).count() == 0


def test_slices_of_any_size(spark, monkeypatch):
    rows = [(k, f"x{k} {RUN} y{k}") for k in range(40)] + [(100, " ".join(f"z{k}" for k in range(50_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in sd.dedup(docs).collect()}
    assert sum(r[2] for r in want) == 39 * 20
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(sd, "SLICE_BYTES", size)
        assert {tuple(r) for r in sd.dedup(docs.repartition(3)).collect()} == want
