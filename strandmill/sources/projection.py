"""The genomics data model projected from the star-schema test tables (regions, reads, SNPs, calls, pedigree).

Each projection is a narrow select (calls: one aggregation), so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chrom(key) -> F.Column:
    return F.concat(F.lit("chr"), (key % 4 + 1).cast("string"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("locus"), _chrom(k).alias("chrom"), (k * 40).alias("start"), (k * 40 + 10 + F.col("p_size")).alias("stop"), (1 + k % 6).alias("period"), F.col("p_name").alias("name"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem")
    part, line, qty = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int")
    pos = part * 40 - 30 + line * 7
    rid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return r.select(
        rid.alias("rid"),
        F.col("l_orderkey").alias("rname"),
        (line % 2 + 1).alias("mate"),
        part.alias("locus"),
        _chrom(part).alias("chrom"),
        pos.alias("pos"),
        (pos + 60 + qty).alias("end_pos"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sample"),
        F.col("l_returnflag").alias("library"),
        F.col("l_linestatus").alias("strand"),
        (qty % 13 - 6).alias("bp_diff"),
        qty.alias("qual"),
        F.col("l_extendedprice").alias("score"),
    )


def het_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNPs over the whole range of the loci, which have 40 places for each part."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    span = table(spark, sf_dir, "part").agg(F.greatest(F.max("p_partkey") + 1, F.lit(1)).cast("long").alias("n")).select((F.col("n") * 40).alias("span"))
    return o.crossJoin(F.broadcast(span)).select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string")).alias("sample"), _chrom(F.col("o_orderkey")).alias("chrom"), (F.col("o_orderkey").cast("long") * 7 % F.col("span")).alias("pos")
    ).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem")
    qty = F.col("l_quantity").cast("int")
    sample = F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("sample")
    return r.groupBy(F.col("l_partkey").alias("locus"), sample).agg(
        (F.min("l_linenumber") % 3).alias("gt_a"),
        F.max(qty % 3).alias("gt_b"),
        F.sum(qty).alias("dp"),
        F.count_if(F.col("l_returnflag") == "R").alias("dstutter"),
        F.count_if(qty % 7 == 0).alias("dflankindel"),
        F.count_if(F.col("l_linestatus") == "O").alias("d1"),
        F.count_if(F.col("l_linestatus") == "F").alias("d2"),
        F.count("*").alias("n"),
    )


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, child, father, mother); ids are one more than the customer's, 0 being unknown."""
    c = F.col("c_custkey")
    family = c - c % 4
    child = table(spark, sf_dir, "customer").where(c % 4 >= 2)
    return child.select(family.alias("family"), (c + 1).alias("child"), (family + 1).alias("father"), (family + 2).alias("mother"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGT" * 6 + "AC").alias("seq"))


#: The reference at position p, from -64 on; {0} is integer division.
_BASE = "substr('ACGT', cast(1 + (((p + 64) * (p + 64)) {0} 7 + ((p + 64) {0} 3) * 5) % 11 % 4 as int), 1)"


#: The formula repeats every 231 positions: its first term modulo 11 every 77, its second every 33.
_PERIOD = 231
_ONE_PERIOD = "".join("ACGT"[(q * q // 7 + q // 3 * 5) % 11 % 4] for q in range(_PERIOD))


def reference(low: str, n: str) -> F.Column:
    """n bases of the reference from position low on, cut out of its repeated period."""
    first = f"cast(pmod({low} + 64, {_PERIOD}) as int) + 1"
    short, long = f"'{_ONE_PERIOD * 2}'", f"repeat('{_ONE_PERIOD}', cast({n} as int) div {_PERIOD} + 2)"
    return F.expr(f"case when {n} > {_PERIOD} then substring({long}, {first}, cast({n} as int)) when {n} > 0 then substring({short}, {first}, cast({n} as int)) else '' end")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with cigar, bases, qualities and the reference from 15 bases before to 15 behind them.

    A read matches 10 to 39 bases, has the insertion or deletion of bp_diff, matches 40 more; some have a base that
    differs, a clip at an end, low qualities at the ends, no cigar, or a haplotype tag.
    """
    return alignments_of(reads(spark, sf_dir)).drop("library")


def alignments_on_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with start and stop of their locus; loci are joined before there are bases, so these are not shuffled."""
    loci = regions(spark, sf_dir).select("locus", "start", "stop")
    return alignments_of(reads(spark, sf_dir).join(loci, "locus"), "start", "stop").drop("library")


def unaligned() -> F.Column:
    """Whether a row of `reads` has no CIGAR."""
    return F.col("qual") % 23 == 0


def aligned_end() -> F.Column:
    """Where the alignment of a row of `reads` ends."""
    return F.col("pos") + 10 + F.col("qual") % 30 + F.greatest(-F.col("bp_diff"), F.lit(0)) + 40


def alignments_of(rows: DataFrame, *more: str) -> DataFrame:
    r = rows.select("rid", "rname", "mate", "locus", "sample", "chrom", "pos", "bp_diff", "qual", "library", *more)
    r = r.withColumn("m1", 10 + F.col("qual") % 30).withColumn("ins", F.greatest("bp_diff", F.lit(0))).withColumn("del", F.greatest(-F.col("bp_diff"), F.lit(0)))
    clip = F.when(F.col("mate") == 2, 3).otherwise(0)
    indel = F.when(F.col("bp_diff") > 0, F.concat("ins", F.lit("I"))).when(F.col("bp_diff") < 0, F.concat("del", F.lit("D"))).otherwise("")
    cigar = F.concat(F.when(F.col("qual") % 17 == 0, "4H").otherwise(""), F.col("m1").cast("string"), F.lit("M"), indel, F.lit("40M"), F.when(F.col("mate") == 2, "3S").otherwise(""))
    plain = F.concat(reference("pos", "m1"), F.expr("repeat('A', ins)"), reference("pos + m1 + del", "40"), F.expr("repeat('T', clip)"))
    k = F.col("qual") % 20
    changed = F.when(F.col("qual") % 5 == 0, F.concat(F.substring("plain", F.lit(1), k), F.translate(F.substring("plain", k + 1, F.lit(1)), "ACGT", "TGCA"), F.substring("plain", k + 2, F.lit(999)))).otherwise(F.col("plain"))
    quals = F.expr("concat(repeat('!', qual % 4), repeat('I', cast(length(bases) - qual % 4 - ((pos + 64) % 3) * 16 as int)), repeat('#', cast(((pos + 64) % 3) * 16 as int)))")
    r = r.withColumn("clip", clip).withColumn("cigar", F.when(unaligned(), "").otherwise(cigar)).withColumn("plain", plain).withColumn("bases", changed).withColumn("quals", quals)
    r = r.withColumn("end_pos", aligned_end()).withColumn("ref_start", F.col("pos") - 15).withColumn("ref", reference("pos - 15", "m1 + del + 70"))
    hp = F.when(F.col("qual") % 3 > 0, F.col("qual") % 3)
    return r.select("rid", "rname", "mate", "locus", "sample", "chrom", "pos", "end_pos", "cigar", "bases", "quals", "ref_start", "ref", "bp_diff", hp.alias("hp"), "library", *more)


def _reference_sql(low: str, n: str) -> str:
    return f"array_to_string([{_BASE.format('//')} for p in range({low}, {low} + {n})], '')"


#: The same projections for the check in another engine.
SQL = {
    "regions": "select p_partkey as locus, 'chr' || (p_partkey % 4 + 1) as chrom, p_partkey * 40 as start, p_partkey * 40 + 10 + p_size as stop, 1 + p_partkey % 6 as period, p_name as name from part",
    "reads": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), cast(round(l_extendedprice * 100) as bigint)) as rid,
        l_orderkey as rname, l_linenumber % 2 + 1 as mate, l_partkey as locus, 'chr' || (l_partkey % 4 + 1) as chrom,
        l_partkey * 40 - 30 + l_linenumber * 7 as pos, l_partkey * 40 + 30 + l_linenumber * 7 + cast(l_quantity as int) as end_pos,
        's' || (l_suppkey % 5) as sample, l_returnflag as library, l_linestatus as strand, cast(l_quantity as int) % 13 - 6 as bp_diff,
        cast(l_quantity as int) as qual, l_extendedprice as score from lineitem""",
    "alns": f"""select rid, rname, mate, locus, sample, chrom, pos, pos + m1 + del + 40 as end_pos, cigar, bases, repeat('!', qual % 4) || repeat('I', cast(length(bases) - qual % 4 - ((pos + 64) % 3) * 16 as int)) || repeat('#', cast(((pos + 64) % 3) * 16 as int)) as quals,
        pos - 15 as ref_start, {_reference_sql('pos - 15', 'm1 + del + 70')} as ref, bp_diff, case when qual % 3 > 0 then qual % 3 end as hp
        from (select *, case when qual % 5 = 0 then substr(plain, 1, qual % 20) || translate(substr(plain, qual % 20 + 1, 1), 'ACGT', 'TGCA') || substr(plain, qual % 20 + 2) else plain end as bases
        from (select *, case when qual % 23 = 0 then '' else case when qual % 17 = 0 then '4H' else '' end || m1 || 'M' || case when bp_diff > 0 then ins || 'I' when bp_diff < 0 then del || 'D' else '' end || '40M' || case when mate = 2 then '3S' else '' end end as cigar,
        {_reference_sql('pos', 'm1')} || repeat('A', cast(ins as int)) || {_reference_sql('pos + m1 + del', '40')} || case when mate = 2 then 'TTT' else '' end as plain
        from (select *, 10 + qual % 30 as m1, greatest(bp_diff, 0) as ins, greatest(-bp_diff, 0) as del from reads)))""",
    "het_snps": "select distinct 's' || (o_custkey % 5) as sample, 'chr' || (o_orderkey % 4 + 1) as chrom, o_orderkey * 7 % (select greatest(max(p_partkey) + 1, 1) * 40 from part) as pos from orders",
    "calls": """select l_partkey as locus, 's' || (l_suppkey % 5) as sample, min(l_linenumber) % 3 as gt_a, max(cast(l_quantity as int) % 3) as gt_b,
        cast(sum(cast(l_quantity as int)) as bigint) as dp, count(*) filter (l_returnflag = 'R') as dstutter, count(*) filter (cast(l_quantity as int) % 7 = 0) as dflankindel,
        count(*) filter (l_linestatus = 'O') as d1, count(*) filter (l_linestatus = 'F') as d2, count(*) as n from lineitem group by 1, 2""",
    "ped": "select c_custkey - c_custkey % 4 as family, c_custkey + 1 as child, c_custkey - c_custkey % 4 + 1 as father, c_custkey - c_custkey % 4 + 2 as mother from customer where c_custkey % 4 >= 2",
    "seqs": f"select doc_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{'ACGT' * 6}AC') as seq from documents",
}


def with_views(sql: str) -> str:
    """The SQL with the projections it names before it."""
    import re

    text = sql + " " + (SQL["alns"] if re.search(r"\balns\b", sql) else "")
    used = [f"{name} as ({body})" for name, body in SQL.items() if re.search(rf"\b{name}\b", text)]
    rest = sql.strip()
    for head in ("with recursive ", "with "):
        if rest[: len(head)].lower() == head:
            return head + ", ".join([*used, rest[len(head) :]])
    return ("with " + ", ".join(used) + " " if used else "") + rest
