import itertools

from pyspark.sql import functions as F

from strandmill.functions import cigars as cg
from strandmill.operators import columns


def test_homopolymers_are_found_without_a_shuffle_and_leave_in_pieces(spark):
    seqs = [(1, "AAACGGT"), (2, ""), (3, None), (4, "TNNTTA"), (5, "C" * 70 + "A")]
    out = columns.homopolymers(spark.createDataFrame(seqs, "doc_id long, seq string").coalesce(1), most=3)
    want = []
    for doc, seq in seqs:
        at = 0
        for k, (base, run) in enumerate(((b, len(list(r))) for b, r in itertools.groupby(seq or "") if b in "ACGT"), 1):
            want.append((doc, k, base, run, at))
            at += run
    assert sorted(map(tuple, out.collect())) == want
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_and_moved_indels_are_made_by_batch(spark):
    row = spark.range(1).select(
        cg.left_aligned(F.lit("5M2D3M"), F.lit("ACACAGTT"), F.lit(10), F.lit("ACACACAGTT"), F.lit(10)).alias("cigar"),
        cg.left_aligned(F.lit(None).cast("string"), F.lit("A"), F.lit(1), F.lit("A"), F.lit(1)).alias("none"),
        columns.html_row(F.lit("A- "), F.lit("AC")).alias("html"),
        columns.html_row(F.lit(""), F.lit("")).alias("empty"),
    )
    assert "ArrowEvalPython" in row._jdf.queryExecution().executedPlan().toString()
    got = row.first()
    assert (got.cigar, got.none) == ("1M2D7M", None)
    assert (got.html, got.empty) == ("<tr><td>A</td><td><b>-</b></td><td></td></tr>", "<tr><td></td></tr>")
