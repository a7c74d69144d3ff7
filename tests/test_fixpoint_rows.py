"""A round shuffles scores of sequences, not a row for each pair of alleles, and scores only what is new."""

from pyspark.sql import functions as F

from strandmill.operators import fixpoint


def test_pairs_are_not_shuffled_and_scores_are_kept(spark):
    seqs = spark.createDataFrame([(1, "AC"), (1, "ACAC"), (2, "A")], "locus long, seq string")
    periods = spark.createDataFrame([(1, 2), (2, 1)], "locus long, period int")
    first = spark.createDataFrame([(1, 0, "AC"), (2, 0, "A")], "locus long, allele long, aseq string")
    later = spark.createDataFrame([(1, 1, "ACAC")], "locus long, allele long, aseq string")
    score = lambda seq, allele, period: -F.abs(F.length(seq) - F.length(allele)).cast("double")
    one = fixpoint._scored(seqs, first, periods, score)
    two = fixpoint._scored(one, later, periods, score)
    assert {(r.locus, r.seq, r.allele, r.lp) for r in fixpoint._spread(two).collect()} == {(1, "AC", 0, 0.0), (1, "AC", 1, -2.0), (1, "ACAC", 0, -2.0), (1, "ACAC", 1, 0.0)}
    assert {(r.seq, r.allele) for r in fixpoint._new_only(two, later).collect()} == {("AC", 1), ("ACAC", 1)}
    pooled = spark.createDataFrame([(1, "s", "AC", 3), (1, "s", "ACAC", 3)], "locus long, sample string, seq string, n long")
    best, given = fixpoint._genotyped(pooled, two)
    assert [tuple(r)[:4] for r in best.collect()] == [(1, "s", 0, 1)] and {(r.seq, r.allele) for r in given.collect()} == {("AC", 0), ("ACAC", 1)}
    assert "hashpartitioning(locus, sample, gt_a" not in given._jdf.queryExecution().executedPlan().toString()
