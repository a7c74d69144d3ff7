"""Joins of loci, reads, mates and variants.

Interval joins go by bins: both sides are spread over the bins they touch, meet by equi-join on (chromosome, bin) and
are kept only in the first bin that both touch, so each pair comes out once without a distinct. A narrow side
touches few bins; the bin width should be about its usual length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(start: Column, stop: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor((stop - 1) / width), F.floor(start / width))))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = 256, pad: int = 0) -> DataFrame:
    """Pairs of half-open spans that overlap once the left one is widened by pad. Column names must differ but for `on`."""
    ls, le = F.col(left_span[0]) - pad, F.col(left_span[1]) + pad
    rs, re = F.col(right_span[0]), F.col(right_span[1])
    a = left.withColumn("_bin", _bins(ls, le, width))
    b = right.withColumn("_bin", _bins(rs, re, width))
    meet = F.col("_bin") == F.greatest(F.floor(ls / width), F.floor(rs / width))
    return a.join(b, [*on, "_bin"]).where((ls < re) & (rs < le) & meet).drop("_bin")


def mate_pairs(reads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each read of mate 1 with the read of mate 2 of equal rank in its fragment."""
    from pyspark.sql import Window

    ranked = reads.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "mate").orderBy(*order)))
    one = ranked.where("mate = 1").select(*keys, "_k", F.struct(*[c for c in reads.columns if c not in keys]).alias("first"))
    two = ranked.where("mate = 2").select(*keys, "_k", F.struct(*[c for c in reads.columns if c not in keys]).alias("second"))
    return one.join(two, [*keys, "_k"]).drop("_k")


def valid_pairings(first: DataFrame, second: DataFrame, keys: list[str], distance: int = 1000) -> DataFrame:
    """Mappings (chrom, pos) of both mates that lie on one chromosome closer than distance, and how many a pair has."""
    a = first.select(*keys, "chrom", F.col("pos").alias("pos_1"))
    b = second.select(*keys, "chrom", F.col("pos").alias("pos_2"))
    near = a.join(b, [*keys, "chrom"]).where(F.abs(F.col("pos_1") - F.col("pos_2")) < distance)
    return near.groupBy(*keys).agg(F.count("*").alias("n_valid"), F.min("chrom").alias("chrom"), F.min("pos_1").alias("pos_1"), F.min("pos_2").alias("pos_2"))


def snps_in_reads(reads: DataFrame, snps: DataFrame, width: int = 128) -> DataFrame:
    """Reads with the SNPs of their sample between pos and end_pos, both inclusive."""
    points = snps.select("sample", "chrom", F.col("pos").alias("snp_pos"), (F.col("pos") + 1).alias("snp_end"))
    spans = reads.withColumn("_last", F.col("end_pos") + 1)
    return overlap_join(spans, points, ["sample", "chrom"], ("pos", "_last"), ("snp_pos", "snp_end"), width).drop("_last", "snp_end")


def snps_of_reads(reads: DataFrame, snps: DataFrame, width: int = 1024) -> DataFrame:
    """Every read once, with the places of the SNPs of its sample between pos and end_pos, both inclusive, as an array
    (snps; empty or null without any), and the bin in which it begins (_bin).

    SNPs are gathered by (sample, chrom, bin), and lie in all bins from which the longest read reaches them; a read is
    in one bin only and has all of its SNPs in one row, so nothing is summed over bins, nor needs the read's bases.
    """
    longest = F.broadcast(reads.agg(F.coalesce(F.max(F.col("end_pos") - F.col("pos")), F.lit(0)).alias("_most")))
    near = snps.select("sample", "chrom", "pos").crossJoin(longest)
    bins = F.explode(F.sequence(F.floor((F.col("pos") - F.greatest("_most", F.lit(0))) / width), F.floor(F.col("pos") / width)))
    held = near.select("sample", "chrom", "pos", bins.alias("_bin")).groupBy("sample", "chrom", "_bin").agg(F.collect_list("pos").alias("_places"))
    met = reads.withColumn("_bin", F.floor(F.col("pos") / width)).join(held, ["sample", "chrom", "_bin"], "left")
    return met.withColumn("snps", F.filter("_places", lambda p: p.between(F.col("pos"), F.col("end_pos")))).drop("_places")


def outside_regions(snps: DataFrame, regions: DataFrame, pad: int = 15, width: int = 256) -> DataFrame:
    """SNPs that lie in no region widened by pad on both sides (ends included)."""
    points = snps.select(*snps.columns, F.floor(F.col("pos") / width).alias("_bin"))
    spans = regions.select(F.col("chrom"), (F.col("start") - pad).alias("_s"), (F.col("stop") + pad).alias("_e"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    return points.join(spans, ["chrom", "_bin"], "left_anti") if pad < 0 else points.alias("p").join(
        spans.alias("r"), (F.col("p.chrom") == F.col("r.chrom")) & (F.col("p._bin") == F.col("r._bin")) & F.col("p.pos").between(F.col("r._s"), F.col("r._e")), "left_anti"
    ).drop("_bin")


def window_of_snps(loci: DataFrame, snps: DataFrame, reach: int = 500_000) -> DataFrame:
    """SNPs within reach of a locus' start, by bins of the reach."""
    near = snps.select("sample", "chrom", F.col("pos").alias("snp_pos"), (F.col("pos") + 1).alias("snp_end"))
    spans = loci.withColumn("_a", F.col("start") - reach).withColumn("_b", F.col("start") + reach + 1)
    return overlap_join(spans, near, ["chrom"], ("_a", "_b"), ("snp_pos", "snp_end"), max(1, reach)).drop("_a", "_b", "snp_end")


def merge_variants(left: DataFrame, right: DataFrame, keys: list[str], same: list[str]) -> DataFrame:
    """Inner join of two call sets on position; fails where what must agree does not."""
    renamed = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in same], *[c for c in right.columns if c not in keys + same])
    joined = left.join(renamed, keys)
    for c in same:
        checked = F.when(F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"variants differ in {c} at "), F.concat_ws(":", *keys))).cast(left.schema[c].dataType))
        joined = joined.withColumn(c, checked).drop(f"_{c}")
    return joined


def trios(ped: DataFrame, calls: DataFrame, person: str, values: list[str]) -> DataFrame:
    """A row for each locus and child with the parents' and the child's values, prefixed f_, m_ and c_."""
    out = ped
    for who, prefix in (("father", "f_"), ("mother", "m_"), ("child", "c_")):
        part = calls.select("locus", F.col(person).alias(who), *[F.col(v).alias(prefix + v) for v in values])
        out = out.join(part, [who] if who == "father" else ["locus", who])
    return out


def haplotype_product(blocks: DataFrame, limit: int = 1000) -> DataFrame:
    """(locus, block, option, seq) -> (locus, hap_index, seq): all choices of one option a block, the last block
    changing fastest; loci of more than limit haplotypes are left out."""
    count = blocks.groupBy("locus", "block").agg(F.array_sort(F.collect_list(F.struct("option", "seq"))).alias("options"))
    per = count.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("block", "options"))).alias("blocks"), F.product(F.size("options")).alias("n")).where(F.col("n") <= limit)
    texts = F.transform("blocks", lambda b: F.transform(b["options"], lambda o: o["seq"]))
    grown = F.aggregate(texts, F.array(F.lit("")), lambda acc, options: F.flatten(F.transform(acc, lambda head: F.transform(options, lambda o: F.concat(head, o)))))
    return per.select("locus", F.posexplode(grown).alias("hap_index", "seq"))
