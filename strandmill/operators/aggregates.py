"""Grouped operators over reads and calls. Everything combines before the shuffle where the function allows it."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import genetics as g


def remove_duplicates(reads: DataFrame, keys: list[str], best: list[Column]) -> DataFrame:
    """One read for each key: the first in the order of best."""
    return reads.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where("_k = 1").drop("_k")


def pool_reads(reads: DataFrame, keys: list[str], quality: str) -> DataFrame:
    """Reads of equal keys as one, with the upper median of the qualities and their number."""
    ordered = F.array_sort(F.collect_list(quality))
    return reads.groupBy(*keys).agg(F.count("*").alias("n_reads"), F.element_at(ordered, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("median_quality"))


def allele_support(reads: DataFrame, allele: str, number: str | None = None) -> DataFrame:
    """For each locus and allele: reads, the sum of the samples' fractions, samples in which it is strong (two reads
    and a fifth of the sample's), and whether it is a candidate. number: how many reads a row stands for."""
    per_sample = reads.groupBy("locus", "sample", allele).agg((F.sum(number) if number else F.count("*")).alias("n"))
    total = F.sum("n").over(Window.partitionBy("locus", "sample"))
    per_sample = per_sample.withColumn("share", F.col("n") / total)
    out = per_sample.groupBy("locus", allele).agg(
        F.sum("n").alias("n_reads"), F.round(F.sum("share"), 9).alias("share_sum"), F.count_if((F.col("n") >= 2) & (F.col("share") >= 0.2)).alias("n_strong")
    )
    sizes = per_sample.groupBy("locus").agg(F.countDistinct("sample").alias("samples"), F.sum("n").alias("reads"))
    joined = out.join(sizes, "locus")
    wide = (F.col("share_sum") > 0.05 * F.col("samples")) | (F.col("n_reads") > 0.05 * F.col("reads"))
    return joined.withColumn("candidate", wide | (F.col("n_strong") >= 1)).drop("samples", "reads")


def stutter_candidates(reads: DataFrame, allele: str, least: int = 2, share: float = 0.15) -> DataFrame:
    n = reads.groupBy("locus", "sample", allele).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("locus", "sample"))
    return n.withColumn("_t", total).where((F.col("n") >= least) & (F.col("n") / F.col("_t") >= share)).drop("_t")


def grouped_log_sum_exp(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """ln of the sum of exponentials in two combining aggregations: the largest value first, then the sum."""
    top = rows.groupBy(*keys).agg(F.max(value).alias("_top"))
    return rows.join(top, keys).groupBy(*keys).agg((F.first("_top") + F.log(F.sum(F.exp(F.col(value) - F.col("_top"))))).alias("lse"))


def genotype_posteriors(reads: DataFrame, alleles: int, likelihood) -> DataFrame:
    """(locus, sample, gt_a, gt_b, lp) from reads; likelihood(allele) gives a read's ln likelihood of an allele.

    A group is one row with a sum for each pair of alleles until its genotypes are normalised, and is spread last, so
    what is shuffled is reads or one row for a group; rows stay with their locus and sample.
    """
    each = reads.select("locus", "sample", *(likelihood(F.lit(k)).alias(f"_{k}") for k in range(alleles)))

    def of_both(a: Column, b: Column) -> Column:
        plain = F.log(0.5 * F.exp(a) + 0.5 * F.exp(b))
        return F.when(F.greatest(a, b) > -700, plain).otherwise(g.log_sum_exp_2(a, b) + g.LN_HALF)

    sums = each.groupBy("locus", "sample").agg(*(F.sum(of_both(F.col(f"_{a}"), F.col(f"_{b}"))).alias(f"_{a}_{b}") for a in range(alleles) for b in range(a, alleles)))
    prior = math.log(alleles), math.log(alleles + 1)
    # Sums stay apart from what is made of them: one expression for all would be worked out again for each genotype.
    joint = sums.select("locus", "sample", *((F.col(c) + F.lit(math.log(2) if c.split("_")[1] == c.split("_")[2] else 0.0) - prior[0] - prior[1]).alias(c) for c in sums.columns[2:]))
    every = [F.col(f"_{min(a, b)}_{max(a, b)}") for a in range(alleles) for b in range(alleles)]
    topped = joint.withColumn("_top", F.greatest(*every) if alleles > 1 else every[0])
    total = topped.withColumn("_total", F.log(functools.reduce(lambda x, y: x + y, (F.exp(c - F.col("_top")) for c in every))))
    rows = [F.struct(F.lit(a).alias("gt_a"), F.lit(b).alias("gt_b"), (every[a * alleles + b] - F.col("_top") - F.col("_total")).alias("lp")) for a in range(alleles) for b in range(alleles)]
    return total.select("locus", "sample", F.inline(F.array(*rows)))


def best_genotype(posteriors: DataFrame) -> DataFrame:
    """The likeliest genotype of each sample; of equals the first in row-major order."""
    index = F.struct(F.round("lp", 9), -F.col("gt_a"), -F.col("gt_b"))
    return posteriors.groupBy("locus", "sample").agg(F.max_by(F.struct("gt_a", "gt_b"), index).alias("_gt"), F.round(F.exp(F.max("lp")), 6).alias("q")).select("locus", "sample", "_gt.gt_a", "_gt.gt_b", "q")


def allele_counts(calls: DataFrame) -> DataFrame:
    """(locus, an, refac, ac): called alleles, reference ones, and `allele|count` for the others."""
    each = calls.select("locus", F.explode(F.array("gt_a", "gt_b")).alias("allele")).where("allele >= 0")
    n = each.groupBy("locus", "allele").agg(F.count("*").alias("n"))
    others = F.collect_list(F.when(F.col("allele") > 0, F.struct(F.col("allele").alias("key"), F.col("n").alias("count"))))
    return n.groupBy("locus").agg(F.sum("n").alias("an"), F.coalesce(F.sum(F.when(F.col("allele") == 0, F.col("n"))), F.lit(0)).alias("refac"), g.histogram_string(others).alias("ac"))


def info_totals(calls: DataFrame, reason: str = "filter") -> DataFrame:
    """INFO sums over the calls that pass, and how many don't."""
    ok = F.col(reason).isNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    return calls.groupBy("locus").agg(total("dp"), total("dstutter"), total("dflankindel"), F.count_if(~ok).alias("nfilt"), F.count_if(ok).alias("ncalls"))


def count_histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("count"))
    return n.groupBy(*keys).agg(g.histogram_string(F.collect_list(F.struct(F.col(value).alias("key"), "count"))).alias("histogram"))


def founder_frequencies(calls: DataFrame, alleles: int) -> DataFrame:
    """log10 frequencies of each allele with one pseudocount each."""
    each = calls.select("locus", F.explode(F.array("gt_a", "gt_b")).alias("allele"))
    loci = calls.select("locus").distinct().withColumn("allele", F.explode(F.array(*[F.lit(k) for k in range(alleles)])))
    n = each.groupBy("locus", "allele").agg(F.count("*").alias("n"))
    all_n = loci.join(n, ["locus", "allele"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return all_n.withColumn("log_freq", F.log10(F.col("n") / F.sum("n").over(Window.partitionBy("locus")))).select("locus", "allele", "log_freq")


def modal_frame(calls: DataFrame) -> DataFrame:
    """The commonest reading frame of each locus, of equals the smallest."""
    n = calls.groupBy("locus", F.pmod("gb", "period").alias("frame")).agg(F.count("*").alias("n"))
    return n.groupBy("locus").agg(F.max_by("frame", F.struct("n", -F.col("frame"))).alias("frame"))


def haplotype_distances(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Four Hamming distances of two bit-packed haplotype pairs, summed over the words of a pair."""
    d = lambda a, b, n: F.sum(F.bit_count(F.col(a).bitwiseXOR(F.col(b)))).alias(n)
    return rows.groupBy(*keys).agg(d("a1", "b1", "d11"), d("a1", "b2", "d12"), d("a2", "b1", "d21"), d("a2", "b2", "d22"))


def two_smallest(values: list[Column]) -> Column:
    """struct<best, best_index, second>; of equals the lowest index is best."""
    order = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(k).alias("k")) for k, v in enumerate(values)]))
    return F.struct(order[0]["v"].alias("best"), order[0]["k"].alias("best_index"), order[1]["v"].alias("second"))


def max_insertions(reads: DataFrame) -> DataFrame:
    """(locus, pos, size): the longest insertion before each reference position; reads: locus, pos, cigar."""
    e = reads.select("locus", "pos", F.posexplode(g.cigar_elements(F.col("cigar"))).alias("k", "e"), "cigar", "rid")
    step = F.when(F.col("e.op").isin("M", "D", "N", "=", "X"), F.col("e.len")).otherwise(0)
    before = F.coalesce(F.sum(step).over(Window.partitionBy("locus", "rid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return e.withColumn("at", F.col("pos") + before).where("e.op = 'I'").groupBy("locus", F.col("at").alias("pos")).agg(F.max("e.len").alias("size"))
