"""Readers of genomics text formats as DataFrames: lines are parsed by built-in functions, filters reach the lines.

Malformed rows raise an error when they are read, as a wrong locus or genotype must not pass unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genetics as g


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def _must(ok: Column, value: Column, kind: str, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(what + ": "), F.col("value"))).cast(kind))


def read_regions(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    """BED of loci (chrom, start from 1, stop, period 1 to 9, copies, optional name) -> half-open 0-based regions."""
    p = F.split(F.trim("value"), r"\s+")
    item = lambda k: F.try_element_at(p, F.lit(k + 1))
    start, stop, period = (item(k).try_cast("int") for k in (1, 2, 3))
    ok = (start >= 1) & (stop > start) & period.between(1, 9) & item(4).try_cast("double").isNotNull()
    rows = _lines(spark, path)
    if chrom is not None:
        rows = rows.where(item(0) == chrom)
    return rows.select(item(0).alias("chrom"), _must(F.coalesce(ok, F.lit(False)), start - 1, "int", "bad region").alias("start"), stop.alias("stop"), period.alias("period"), item(5).alias("name"))


def read_stutter_models(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated models keyed by (chrom, 0-based start, stop); of repeated keys the first in the file stays."""
    schema = "chrom string, start int, stop int, in_geom double, in_down double, in_up double, out_geom double, out_down double, out_up double, period int"
    rows = spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    keys, rest = rows.columns[:3], rows.columns[3:]
    return rows.withColumn("place", place).groupBy(*keys).agg(F.min_by(F.struct(*rest), "place").alias("model")).select(*keys, "model.*")


def write_stutter_models(models: DataFrame, path: str) -> None:
    cols = ["chrom", "start", "stop", "in_geom", "in_down", "in_up", "out_geom", "out_down", "out_up", "period"]
    models.select(*cols).write.csv(path, sep="\t")


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """family, child, father, mother; 0 is unknown and becomes null; further columns are ignored."""
    p = F.split(F.trim("value"), r"\s+")
    name = lambda k: F.nullif(p.getItem(k), F.lit("0"))
    return _lines(spark, path).where(~F.col("value").startswith("#")).select(
        _must(F.size(p) >= 4, p.getItem(0), "string", "bad pedigree row").alias("family"), p.getItem(1).alias("child"), name(2).alias("father"), name(3).alias("mother")
    )


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One value a line, blank lines skipped."""
    return _lines(spark, path).select(F.trim("value").alias("value"))


def read_snp_skips(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), ":")
    return _lines(spark, path).select(p.getItem(0).alias("chrom"), _must(F.size(p) == 2, p.getItem(1).try_cast("int"), "int", "bad position").alias("pos"))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of SAM text: 0-based pos, exclusive end, CIGAR as an array, tags as a map, the file's name."""
    p = F.split("value", "\t")
    tags = F.map_from_entries(F.transform(F.filter(p, lambda x, k: k >= 11), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1_000_000))))
    rows = _lines(spark, path).withColumn("file", F.input_file_name()).where(~F.col("value").startswith("@"))
    cigar = g.cigar_elements(F.when(p.getItem(5) != "*", p.getItem(5)).otherwise(""))
    pos = p.getItem(3).cast("int") - 1
    return rows.select(
        "file",
        p.getItem(0).alias("name"),
        _must(F.size(p) >= 11, p.getItem(1).cast("int"), "int", "bad alignment").alias("flag"),
        p.getItem(2).alias("chrom"),
        pos.alias("pos"),
        (pos + g.cigar_sum(cigar, "MDN=X")).alias("end_pos"),
        p.getItem(4).cast("int").alias("mapq"),
        cigar.alias("cigar"),
        F.when(p.getItem(6) == "=", p.getItem(2)).otherwise(p.getItem(6)).alias("mate_chrom"),
        (p.getItem(7).cast("int") - 1).alias("mate_pos"),
        p.getItem(9).alias("bases"),
        p.getItem(10).alias("quals"),
        tags.alias("tags"),
    )


def read_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): the header lines of SAM files, in order."""
    return _lines(spark, path).where(F.col("value").startswith("@")).select(F.input_file_name().alias("file"), "value")


def header_groups(lines: DataFrame, library_tag: str = "LB") -> DataFrame:
    """@RG lines: file, rg_id, sample, library; an id given twice with another sample in one file is an error."""
    fields = F.filter(F.split("value", "\t"), lambda x, k: k > 0)
    entries = F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1_000_000)))
    rows = lines.where(F.col("value").startswith("@RG\t")).select("file", F.map_from_entries(entries).alias("t"))
    named = rows.select("file", F.col("t")["ID"].alias("rg_id"), F.col("t")["SM"].alias("sample"), F.col("t")[library_tag].alias("library")).distinct()
    same = F.when(F.countDistinct("sample") == 1, F.first("sample")).otherwise(F.raise_error(F.concat(F.lit("read group with two samples: "), F.col("rg_id"))).cast("string"))
    return named.groupBy("file", "rg_id").agg(same.alias("sample"), F.min("library").alias("library"))


def read_groups(spark: SparkSession, path: str | list[str], library_tag: str = "LB") -> DataFrame:
    return header_groups(read_header(spark, path), library_tag)


def with_samples(reads: DataFrame, groups: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds sample and library to reads: by (file, RG tag), or for files in `files` (file, sample, library) by the file
    alone. A read that neither names is an error when it is read."""
    named = reads.withColumn("rg_id", F.col("tags")["RG"]).join(groups.withColumnsRenamed({"sample": "_sample", "library": "_library"}), ["file", "rg_id"], "left")
    if files is not None:
        named = named.join(files.select("file", F.col("sample").alias("_own"), F.col("library").alias("_own_library")), "file", "left")
        named = named.withColumn("_sample", F.coalesce("_own", "_sample")).withColumn("_library", F.when(F.col("_own").isNotNull(), F.col("_own_library")).otherwise(F.col("_library")))
    known = F.when(F.col("_sample").isNotNull(), F.col("_sample")).otherwise(F.raise_error(F.concat(F.lit("read without a sample: "), F.col("name"))).cast("string"))
    return named.select(reads["*"], known.alias("sample"), F.col("_library").alias("library"))


def header_contigs(lines: DataFrame) -> DataFrame:
    """@SQ lines: file, name, length and ord, the place among the file's contigs."""
    v = F.col("value")
    rows = lines.where(v.startswith("@SQ\t")).withColumn("_at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file").orderBy("_at")) - 1
    return rows.select("file", F.regexp_extract(v, r"\tSN:([^\t]*)", 1).alias("name"), F.regexp_extract(v, r"\tLN:(\d+)", 1).cast("long").alias("length"), place.alias("ord"))


def read_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return header_contigs(read_header(spark, path))


def differing_contigs(contigs: DataFrame) -> DataFrame:
    """Contigs that not all files have with one length at one place; empty where the headers agree."""
    files = contigs.select("file").distinct().count()
    own = contigs.groupBy("name").agg(F.countDistinct("file").alias("files"), F.countDistinct("length").alias("lengths"), F.countDistinct("ord").alias("places"))
    return own.where((F.col("files") < files) | (F.col("lengths") > 1) | (F.col("places") > 1))


def read_fasta(spark: SparkSession, path: str | list[str], piece: int = 1 << 16) -> DataFrame:
    """(chrom, start, seq): whole records cut into pieces of `piece` bases, so that a window needs one or two rows.

    Records are split by their > mark while reading; a chromosome is one value only inside that one task.
    """
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    cut = rows.select(name.alias("chrom"), seq.alias("s"))
    return cut.select("chrom", "s", F.explode(F.sequence(F.lit(0), F.greatest(F.length("s") - 1, F.lit(0)), F.lit(piece))).alias("start")).select("chrom", "start", F.substring(F.col("s"), F.col("start") + 1, F.lit(piece)).alias("seq"))


def windows(pieces: DataFrame, loci: DataFrame, flank: int, piece: int = 1 << 16) -> DataFrame:
    """Adds ref, the sequence from start - flank to stop + flank (cut at the contig's ends), to each locus."""
    first = F.greatest(F.lit(0), F.col("start") - flank)
    spread = loci.withColumn("_a", first).withColumn("_b", F.col("stop") + flank).withColumn("_p", F.explode(F.sequence(F.floor(F.col("_a") / piece), F.floor((F.col("_b") - 1) / piece))))
    p = pieces.select("chrom", F.floor(F.col("start") / piece).alias("_p"), F.col("start").alias("_s"), F.col("seq").alias("_seq"))
    hit = spread.join(p, ["chrom", "_p"])
    part = F.substring(F.col("_seq"), F.greatest(F.lit(0), F.col("_a") - F.col("_s")).cast("int") + 1, (F.least(F.col("_b"), F.col("_s") + piece) - F.greatest("_a", "_s")).cast("int"))
    rows = hit.groupBy(*loci.columns).agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("p"), part.alias("t")))).alias("_r"))
    return rows.withColumn("ref", F.array_join(F.transform("_r", lambda r: r["t"]), "")).drop("_r")


def variants_of(lines: DataFrame) -> DataFrame:
    """VCF rows: chrom, pos (from 1), id, ref, alts, info map, format keys, sample fields by position."""
    p = F.split("value", "\t")
    return lines.select(
        p.getItem(0).alias("chrom"),
        _must(F.size(p) >= 8, p.getItem(1).cast("int"), "int", "bad variant").alias("pos"),
        p.getItem(2).alias("id"),
        p.getItem(3).alias("ref"),
        F.when(p.getItem(4) == ".", F.array().cast("array<string>")).otherwise(F.split(p.getItem(4), ",")).alias("alts"),
        p.getItem(6).alias("filter"),
        g.info_map(p.getItem(7)).alias("info"),
        F.split(F.coalesce(F.try_element_at(p, F.lit(9)), F.lit("")), ":").alias("format"),
        F.filter(p, lambda x, k: k >= 9).alias("fields"),
    )


def read_variants(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """VCF text, gzip included (one task a file); `vcf_index.read_vcf` reads blocked and indexed files."""
    return variants_of(_lines(spark, path).where(~F.col("value").startswith("#")))


def read_samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return head[0].split("\t")[9:] if head else []


def calls_of(variants: DataFrame, samples: list[str]) -> DataFrame:
    """A row for each variant and sample: FORMAT values as a map and the genotype (a, b, phased, missing)."""
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    rows = variants.select("chrom", "pos", "format", F.posexplode("fields").alias("k", "field"))
    values = F.split("field", ":")
    padded = F.transform("format", lambda x, k: F.coalesce(F.try_element_at(values, k + 1), F.lit(".")))
    keyed = F.map_from_arrays("format", padded)
    out = rows.select("chrom", "pos", F.try_element_at(names, F.col("k") + 1).alias("sample"), keyed.alias("values"))
    return out.withColumn("gt", g.genotype(F.coalesce(F.col("values")["GT"], F.lit("."))))
