"""Filters of reads, loci and calls as columns; a cascade names the first rule that fails."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the genotyping filters.
MAX_MATE_DISTANCE, MIN_FLANK, MAX_STR_LENGTH, MIN_LN_QUALITY, MIN_READS, MAX_READS, CONTIG_PAD = 1000, 5, 100, -10.0, 100, 1_000_000, 50


def first_failing(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that holds, else null; a rule that is null does not hold."""
    out = None
    for name, broken in rules.items():
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def diploid_call_filter(c, min_depth=0, min_quality=0.0, min_hap_quality=0.0, min_allele_depth=0.0, min_ratio=0.0, max_flank=1.0, max_stutter=1.0, min_bias=-100.0, min_strand=-100.0, min_span=0) -> Column:
    """c: column getter by name: dp, q, hq, d1, d2, dflankindel, dstutter, ab, fs, span. A part of zero depth always fails."""
    low = F.least(c("d1"), c("d2"))
    rules = {"DEPTH": c("dp") < min_depth, "QUALITY": c("q") < min_quality}
    if min_hap_quality > 0:
        rules["HAPLOTYPE_QUALITY"] = c("hq") < min_hap_quality
    rules["ALLELE_DEPTH"] = (low == 0) | (low < min_allele_depth)
    rules["ALLELE_RATIO"] = F.try_divide(low, F.greatest(c("d1"), c("d2"))) < min_ratio
    if max_flank < 1:
        rules["FLANK_INDELS"] = F.try_divide(c("dflankindel"), c("dp")) > max_flank
    if max_stutter < 1:
        rules["STUTTER_FRACTION"] = F.try_divide(c("dstutter"), c("dp")) > max_stutter
    if min_bias > -100:
        rules["ALLELE_BIAS"] = c("ab") < min_bias
    if min_strand > -100:
        rules["STRAND_BIAS"] = c("fs") < min_strand
    if min_span > 0:
        rules["SPANNING_DEPTH"] = c("span").isNull() | (c("span") < min_span)
    return first_failing(rules)


def haploid_call_filter(c, min_depth: int, min_quality: float, max_flank: float, max_stutter: float, frame: Column | None = None, spanning: Column | None = None) -> Column:
    """Codes 1 to 6, 0 for a call that passes; frame: the locus' modal frame, spanning: whether any read spans."""
    rules = {}
    if spanning is not None:
        rules["1"] = ~spanning
    rules |= {"2": c("dp") < min_depth, "3": c("q") < min_quality, "4": F.try_divide(c("dflankindel"), c("dp")) > max_flank, "5": F.try_divide(c("dstutter"), c("dp")) > max_stutter}
    if frame is not None:
        rules["6"] = frame != F.pmod(c("gb"), c("period"))
    return F.coalesce(first_failing(rules), F.lit("0")).cast("int")


def locus_filter(dp: Column, flank: Column, stutter: Column, low=0, high=1_000_000_000, max_flank=1.0, max_stutter=1.0) -> Column:
    """True where the locus stays."""
    keep = dp.between(low, high)
    if max_flank < 1:
        keep &= F.coalesce(F.try_divide(flank, dp) <= max_flank, F.lit(False))
    if max_stutter < 1:
        keep &= F.coalesce(F.try_divide(stutter, dp) <= max_stutter, F.lit(False))
    return keep


def is_paired_as_neither(flag: Column) -> Column:
    return (flag.bitwiseAND(1) != 0) & (flag.bitwiseAND(0xC0) == 0)


def out_of_range(pos: Column, end: Column, mate_pos: Column, length: Column, paired: Column, start: Column, stop: Column) -> Column:
    """A read off the locus whose mate can't reach it either."""
    off = (pos >= stop) | (end <= start)
    return off & (~paired | (mate_pos == pos) | (mate_pos >= stop) | (mate_pos + length + 100 < start))


def is_placed(flag: Column, pos: Column, cigar: Column, length: Column) -> Column:
    return (flag.bitwiseAND(4) == 0) & (pos != 0) & (F.length(cigar) > 0) & (length > 0)


def has_hard_clip(cigar: Column) -> Column:
    return cigar.rlike(r"^\d+H") | cigar.endswith("H")


def trimmed_too_much(before: Column, after: Column) -> Column:
    return 2 * after < before


def has_n_bases(bases: Column) -> Column:
    return bases.contains("N")


def has_low_quality(ln_quality: Column, least: float = MIN_LN_QUALITY) -> Column:
    return ln_quality < least


def spans_with_flank(pos: Column, end: Column, start: Column, stop: Column, flank: int = MIN_FLANK) -> Column:
    return (pos <= start - flank) & (end >= stop + flank)


def locus_is_scannable(start: Column, stop: Column, contig_length: Column, longest: int = MAX_STR_LENGTH, pad: int = CONTIG_PAD) -> Column:
    return (stop - start <= longest) & (start >= pad) & (stop + pad <= contig_length)


def is_biallelic_snp(alleles: Column) -> Column:
    return (F.size(alleles) == 2) & F.forall(alleles, lambda a: F.length(a) == 1)


def is_diploid(gt: Column) -> Column:
    return F.regexp_count(gt, F.lit(r"[|/]")) == 1


def region_flags(pos: Column, end: Column, passes: Column, regions: Column) -> Column:
    """A flag for each region of array<struct<start, stop>>: all false where a read filter failed, else whether the
    read spans that region with its flank."""
    return F.transform(regions, lambda r: passes & spans_with_flank(pos, end, r["start"], r["stop"]))


def informative_reads(reads: DataFrame, most: int = 10_000) -> DataFrame:
    """Reads for stutter learning: deletions no longer than the locus; samples in order until most reads are reached
    (the sample that reaches it is kept whole)."""
    from pyspark.sql import Window

    kept = reads.where(F.col("bp_diff") >= -(F.col("length") + 1))
    sizes = kept.groupBy("locus", "sample").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("locus").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1))
    used = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most).select("locus", "sample")
    return kept.join(used, ["locus", "sample"], "left_semi")
