"""The queries over sequences against brute force on texts longer than any SQL form of them reads."""

import random
import re
from collections import Counter

import pytest

from strandmill.functions import kernels as k
from strandmill.plans import registry


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(12)
    lengths = (0, 1, 9, 10, 62, 63, 64, 119, 200, 201, 1500)
    rows = [(i, "".join(rng.choice("abcdefgXYZ .,\n4") for _ in range(n))) for i, n in enumerate(lengths)]
    rows += [(50, "a" * 300 + "ggt"), (51, None)]
    d = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGT" * 6 + "AC")
    return str(d), {i: re.sub("[^A-Za-z]", "", t).upper().translate(table) for i, t in rows if t is not None}


def test_whole_texts_are_read(spark, texts):
    d, seqs = texts
    q = registry.queries()
    kmers = Counter(s[i : i + 10] for s in seqs.values() for i in range(len(s) - 9))
    assert {r.kmer: r.n for r in q["mdl_11"](spark, d).collect()} == kmers
    assert {r.doc_id for r in q["flt_06"](spark, d).collect()} == {i for i, s in seqs.items() if "GGT" not in s}
    back = str.maketrans("ACGT", "TGCA")
    assert {r.doc_id: r.rc for r in q["scl_05"](spark, d).collect() if r.doc_id != 51} == {i: s[::-1].translate(back) for i, s in seqs.items()}
    assert {r.doc_id: (r.up, r.parts) for r in q["scl_24"](spark, d).collect() if r.doc_id != 51} == {i: (s, len(s.split("GG"))) for i, s in seqs.items()}
    assert {r.doc_id: r.n for r in q["src_10"](spark, d).collect() if r.doc_id != 51} == {i: len(s) for i, s in seqs.items()}


def test_every_base_is_aligned(spark, texts):
    d, seqs = texts
    want = {}
    for i, s in seqs.items():
        for p in range(0, len(s), 63):
            x = s[p : p + 63]
            want[i, p] = k.align(x[:30] + x[33:], s[max(0, p - 10) : p + 80])
    got = {(r.doc_id, r.pos): (r.score, r.cigar) for r in registry.queries()["scl_11"](spark, d).collect()}
    assert got == want
