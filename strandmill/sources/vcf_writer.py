"""VCF output: a header by the driver, rows sorted by range partitions, so files in order make one sorted VCF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Descriptions of the fields that are written.
INFO = {
    "START": ("1", "Integer", "Start of the repeat"),
    "END": ("1", "Integer", "End of the repeat"),
    "PERIOD": ("1", "Integer", "Length of the repeat unit"),
    "DP": ("1", "Integer", "Reads of the called samples"),
    "AN": ("1", "Integer", "Called alleles"),
    "REFAC": ("1", "Integer", "Reference alleles"),
    "AC": ("A", "Integer", "Alternate alleles"),
}
FORMAT = {"GT": ("1", "String", "Genotype"), "GB": ("1", "String", "Base pairs beyond the reference"), "Q": ("1", "Float", "Posterior of the genotype"), "DP": ("1", "Integer", "Reads")}


def header(command: str, contigs: list[tuple[str, int]], samples: list[str]) -> list[str]:
    out = ["##fileformat=VCFv4.2", f"##command={command}"]
    out += [f"##contig=<ID={n},length={k}>" for n, k in contigs]
    for kind, fields in (("INFO", INFO), ("FORMAT", FORMAT)):
        out += [f'##{kind}=<ID={k},Number={n},Type={t},Description="{d}">' for k, (n, t, d) in fields.items()]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def fixed(x: Column, places: int = 2) -> Column:
    """Decimals rounded half to even on the binary value."""
    return F.bround(x, places).cast(f"decimal(38,{places})").cast("string")


def lines(variants: DataFrame, calls: DataFrame, samples: list[str], keys: list[str], call: str) -> DataFrame:
    """variants: chrom, pos, id, ref, alts, info (text); calls: keys, sample and a column of formatted calls.

    One combining aggregation turns a variant's calls to a map; samples without one get a dot.
    """
    own = calls.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("sample", call))).alias("_calls"))
    cells = [F.coalesce(F.col("_calls")[s], F.lit(".")) for s in samples]
    alts = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(F.lit("."))
    text = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", alts, F.lit("."), F.lit("."), "info", F.lit(":".join(FORMAT)), *cells)
    return variants.join(own, keys, "left").select("chrom", "pos", text.alias("value"))


def write(rows: DataFrame, path: str, head: list[str], gzip: bool = True) -> None:
    """Files part-00000... under path in order of (chrom, pos), after a header file that sorts before them."""
    spark = rows.sparkSession
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/header")
    option = {"compression": "gzip"} if gzip else {}
    rows.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.options(**option).text(f"{path}/rows")
