"""Queries that write whole projections as BAM and VCF files to the shared folder and read them by their indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genetics as g
from ..sources import bam, vcf_index, vcf_writer
from ..sources import projection as pj
from ..sources.shared import fresh, written
from .relational import query

CONTIGS = [(f"chr{k}", 1 << 28) for k in range(1, 5)]
#: Half-open regions that the queries ask for.
REGIONS = [("chr1", 1_000, 9_000), ("chr1", 8_000, 20_000), ("chr3", 0, 4_000), ("chr4", 50_000, 60_000)]
_READ = "rid, chrom, pos, case when cigar = '' then pos else end_pos end as end_pos, cigar, bases, quals, cast(hp as varchar) as hp"
_NEAR = " or ".join(f"(chrom = '{c}' and pos < {b} and end_pos > {a})" for c, a, b in REGIONS)


def _named(r):
    """Reads with their name and flag, by which those of a place are ordered."""
    return r.withColumn("name", F.col("rid")).withColumn("flag", F.when(pj.unaligned(), 4).otherwise(0))


def _records_of(r):
    """Reads in the columns of a BAM file, with sample and library as a read group."""
    r = pj.alignments_of(r, "name", "flag")
    tags = F.map_filter(F.create_map(F.lit("RG"), F.concat_ws(".", "sample", "library"), F.lit("HP"), F.col("hp").cast("string")), lambda k, v: v.isNotNull())
    return r.select(
        "name", "flag", "chrom", F.col("pos").cast("int").alias("pos"), F.lit(60).alias("mapq"), g.cigar_elements(F.col("cigar")).alias("cigar"),
        F.lit("*").alias("mate_chrom"), F.lit(-1).alias("mate_pos"), "bases", "quals", tags.alias("tags"), "library",
    )


def _reads(s, d):
    """All reads in the columns of a BAM file, named by their id, as a table."""
    return written(_records_of(_named(pj.reads(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions"))))), "alignments")


def _reads_file(s, d):
    """All reads in one sorted BAM file; they are put in order before they have bases."""
    path = fresh(s, "reads") + ".bam"
    bam.write_bam(_named(pj.reads(s, d)), path, CONTIGS, made=_records_of)
    return path


def _back(rows):
    return rows.select(F.col("name").alias("rid"), "chrom", "pos", "end_pos", g.cigar_string(F.col("cigar")).alias("cigar"), "bases", "quals", F.col("tags")["HP"].alias("hp"))


@query("src_01", f"select {_READ} from (select * replace (case when cigar = '' then pos + 1 else end_pos end as end_pos) from alns) where {_NEAR}")
def src_01(s, d):
    """Reads that overlap regions, from one sorted BAM file and its index."""
    return _back(bam.read_bam(s, _reads_file(s, d), REGIONS))


@query("src_03", f"select {_READ} from alns where chrom = 'chr3'")
def src_03(s, d):
    """Reads of a whole chromosome: the filter reaches the index."""
    return _back(bam.read_bam(s, _reads_file(s, d)).where("chrom = 'chr3'"))


@query("src_04", "select rid, pos, library, row_number() over (partition by chrom order by pos, library, rid) as ord from reads")
def src_04(s, d):
    """One BAM file for each library, read as one table in order of places, on a tie in order of the files."""
    from ..operators import ranges

    rows, folder = _reads(s, d), fresh(s, "libraries")
    libraries = [r.library for r in rows.select("library").distinct().orderBy("library").collect()]
    files = {lib: f"{folder}/{k}.bam" for k, lib in enumerate(libraries)}
    for lib, path in files.items():
        bam.write_bam(rows.where(F.col("library") == lib), path, CONTIGS)
    named = F.element_at(F.split(F.col("tags")["RG"], r"\."), 2).alias("library")
    merged = bam.read_bam(s, list(files.values())).select(F.col("name").alias("rid"), "chrom", "pos", named)
    return ranges.rank_by_position(merged, ["chrom"], "pos", ["library", "rid"]).select("rid", "pos", "library", F.col("ord").cast("long").alias("ord"))


def _records(s, d):
    """A VCF line for every locus: its repeat, totals and the calls of the samples."""
    calls = pj.calls(s, d).withColumn("call", F.concat_ws(":", F.concat_ws("/", "gt_a", "gt_b"), F.col("dp").cast("string")))
    samples = [r.sample for r in calls.select("sample").distinct().orderBy("sample").collect()]
    total = calls.groupBy("locus").agg(F.sum("dp").alias("dp"))
    info = F.concat(F.lit("START="), F.col("start") + 1, F.lit(";END="), F.col("stop"), F.lit(";PERIOD="), "period", F.lit(";DP="), F.coalesce("dp", F.lit(0)))
    loci = pj.regions(s, d).join(total, "locus", "left").withColumn("ref", F.rpad(F.lit("A"), (F.col("stop") - F.col("start")).cast("int"), F.lit("C")))
    rows = loci.select("locus", "chrom", (F.col("start") + 1).alias("pos"), F.concat(F.lit("STR"), "locus").alias("id"), "ref", F.array().cast("array<string>").alias("alts"), info.alias("info"))
    own = calls.groupBy("locus").agg(F.map_from_entries(F.collect_list(F.struct("sample", "call"))).alias("calls"))
    cells = [F.coalesce(F.col("calls")[x], F.lit(".")) for x in samples]
    text = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", F.lit("."), F.lit("."), F.lit("."), "info", F.lit("GT:DP"), *cells)
    return rows.join(own, "locus", "left").select("chrom", "pos", text.alias("value")), vcf_writer.header("records", CONTIGS, samples)


@query("src_11", f"select chrom, start + 1 as pos, 'STR' || locus as id, stop, period, cast(coalesce(sum(dp), 0) as bigint) as dp, count(gt_a) as n_calls from (select * from (select *, start as pos, stop as end_pos from regions) where {_NEAR}) left join calls using (locus) group by all")
def src_11(s, d):
    """Records that overlap regions, from a sorted VCF file in blocked gzip and its tabix index."""
    from ..sources import text

    path = fresh(s, "records") + ".vcf.gz"
    rows, head = _records(s, d)
    vcf_index.write_vcf(rows, path, head, [c for c, _ in CONTIGS])
    samples = vcf_index.header_of(path)[-1].split("\t")[9:]
    found = vcf_index.read_vcf(s, path, REGIONS)
    called = text.calls_of(found, samples).groupBy("chrom", "pos").agg(F.count_if(F.col("values")["GT"] != ".").alias("n_calls"))
    at = lambda k, kind: F.col("info")[k].cast(kind)
    return found.join(called, ["chrom", "pos"]).select("chrom", F.col("pos").cast("long").alias("pos"), "id", at("END", "long").alias("stop"), at("PERIOD", "long").alias("period"), at("DP", "long").alias("dp"), F.col("n_calls").cast("long").alias("n_calls"))


@query("snk_10", "select chrom, count(*) as n, cast(sum(start + 1) as bigint) as places, count(*) as ordered from regions group by chrom")
def snk_10(s, d):
    """A VCF left as a folder of sorted parts, read as text again: rows of each contig, and how many of them follow, in
    their file, a row of their contig that does not lie behind them (the first of a contig in a file counts)."""
    from pyspark.sql import Window

    path = fresh(s, "records")
    rows, head = _records(s, d)
    vcf_index.write_vcf(rows, path, head, [c for c, _ in CONTIGS], join=False)
    lines = s.read.text(path, pathGlobFilter="*.vcf.gz").select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).where(~F.col("value").startswith("#"))
    p = F.split("value", "\t")
    placed = lines.select("file", "at", p[0].alias("chrom"), p[1].cast("long").alias("pos"))
    before = F.lag("pos").over(Window.partitionBy("file", "chrom").orderBy("at"))
    seen = placed.withColumn("ok", F.coalesce(before <= F.col("pos"), F.lit(True)))
    return seen.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.count_if("ok").alias("ordered"))
