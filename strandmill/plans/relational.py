"""Queries of the relational operators on projected tables, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genetics as g
from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import joins
from ..sources import projection as pj

QUERIES: dict = {}
SQL: dict[str, str] = {}

MODEL = {"in_geom": 0.95, "in_up": 0.05, "in_down": 0.05, "out_geom": 0.95, "out_up": 0.01, "out_down": 0.01}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = pj.with_views(sql)
        return f

    return keep


_FILTER_SQL = """case when dp < 40 then 'DEPTH' when least(d1, d2) = 0 or least(d1, d2) < 1 then 'ALLELE_DEPTH'
  when least(d1, d2) / greatest(d1, d2) < 0.3 then 'ALLELE_RATIO' when dflankindel / dp > 0.05 then 'FLANK_INDELS'
  when dstutter / dp > 0.05 then 'STUTTER_FRACTION' end"""


def _filtered(s, d):
    c = pj.calls(s, d).withColumn("q", F.lit(1.0))
    return c.withColumn("filter", flt.diploid_call_filter(F.col, min_depth=40, min_allele_depth=1, min_ratio=0.3, max_flank=0.05, max_stutter=0.05))


@query("flt_21", f"select locus, sample, {_FILTER_SQL} as filter from calls")
def flt_21(s, d):
    return _filtered(s, d).select("locus", "sample", "filter")


@query("flt_22", "select locus, cast(sum(dp) as bigint) as dp from calls group by locus having sum(dp) between 300 and 800 and sum(dflankindel) / sum(dp) <= 0.01 and sum(dstutter) / sum(dp) <= 0.02")
def flt_22(s, d):
    t = pj.calls(s, d).groupBy("locus").agg(F.sum("dp").alias("dp"), F.sum("dflankindel").alias("fl"), F.sum("dstutter").alias("st"))
    return t.where(flt.locus_filter(F.col("dp"), F.col("fl"), F.col("st"), 300, 800, 0.01, 0.02)).select("locus", "dp")


_HAPLOID_SQL = """haploid as (select c.locus, c.sample, c.gt_b - 2 * c.gt_a as gb, r.period, c.dp, c.dstutter, c.dflankindel from calls c join regions r using (locus)),
frames as (select locus, ((gb % period) + period) % period as frame, count(*) as n from haploid group by 1, 2),
modal as (select locus, frame from (select *, row_number() over (partition by locus order by n desc, frame) as k from frames) where k = 1)"""


def _haploid(s, d):
    r = pj.regions(s, d).select("locus", "period")
    return pj.calls(s, d).join(r, "locus").withColumn("gb", F.col("gt_b") - 2 * F.col("gt_a")).withColumn("q", F.lit(1.0))


@query(
    "flt_23",
    f"""with {_HAPLOID_SQL} select locus, sample, case when dp < 30 then 2 when dflankindel / dp > 0.05 then 4 when dstutter / dp > 0.05 then 5
    when frame <> ((gb % period) + period) % period then 6 else 0 end as code from haploid join modal using (locus)""",
)
def flt_23(s, d):
    h = _haploid(s, d)
    c = h.join(agg.modal_frame(h), "locus")
    return c.select("locus", "sample", flt.haploid_call_filter(F.col, 30, 0.0, 0.05, 0.05, frame=F.col("frame")).alias("code"))


@query("agg_26", f"with {_HAPLOID_SQL} select locus, frame from modal")
def agg_26(s, d):
    return agg.modal_frame(_haploid(s, d))


@query("flt_24", f"with {_HAPLOID_SQL} select locus, count(*) as n from haploid group by locus having sum(dp) between 200 and 900 and count(*) filter (sample in ('s0', 's1')) >= 1 and count(*) filter (sample in ('s2', 's3', 's4')) between 1 and 3")
def flt_24(s, d):
    males, females = F.count_if(F.col("sample").isin("s0", "s1")), F.count_if(~F.col("sample").isin("s0", "s1"))
    t = _haploid(s, d).groupBy("locus").agg(F.count("*").alias("n"), F.sum("dp").alias("dp"), males.alias("m"), females.alias("f"))
    return t.where(F.col("dp").between(200, 900) & (F.col("m") >= 1) & F.col("f").between(1, 3)).select("locus", "n")


@query("agg_25", f"select coalesce({_FILTER_SQL}, 'PASS') as reason, count(*) as n from calls group by 1")
def agg_25(s, d):
    return _filtered(s, d).groupBy(F.coalesce("filter", F.lit("PASS")).alias("reason")).agg(F.count("*").alias("n"))


@query("snk_11", f"select sample, coalesce({_FILTER_SQL}, 'PASS') as reason, count(*) as n from calls group by 1, 2")
def snk_11(s, d):
    return _filtered(s, d).groupBy("sample", F.coalesce("filter", F.lit("PASS")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "prj_11",
    f"""with f as (select *, {_FILTER_SQL} as filter from calls),
    totals as (select locus, cast(coalesce(sum(dp) filter (filter is null), 0) as bigint) as dp, cast(coalesce(sum(dstutter) filter (filter is null), 0) as bigint) as dstutter,
      cast(coalesce(sum(dflankindel) filter (filter is null), 0) as bigint) as dflankindel, count(*) filter (filter is not null) as nfilt, count(*) filter (filter is null) as ncalls from f group by locus),
    alleles as (select locus, allele, count(*) as n from (select locus, gt_a as allele from f where filter is null union all select locus, gt_b from f where filter is null) group by 1, 2),
    counts as (select locus, cast(sum(n) as bigint) as an, cast(coalesce(sum(n) filter (allele = 0), 0) as bigint) as refac, coalesce(string_agg(allele || '|' || n, ';' order by allele) filter (allele > 0), '.') as ac from alleles group by locus)
    select * from totals left join counts using (locus) where ncalls >= 1""",
)
def prj_11(s, d):
    f = _filtered(s, d)
    kept = agg.allele_counts(f.where("filter is null"))
    return agg.info_totals(f).where("ncalls >= 1").join(kept, "locus", "left")


@query("agg_13", "select locus, count(*) as an, count(*) filter (allele = 0) as refac from (select locus, gt_a as allele from calls union all select locus, gt_b from calls) group by locus")
def agg_13(s, d):
    return agg.allele_counts(pj.calls(s, d)).select("locus", "an", "refac")


@query("agg_14", "select locus, cast(sum(dp) as bigint) as dp, cast(sum(dstutter) as bigint) as dstutter, cast(sum(dflankindel) as bigint) as dflankindel, cast(0 as bigint) as nfilt, count(*) as ncalls from calls group by locus")
def agg_14(s, d):
    return agg.info_totals(pj.calls(s, d).withColumn("filter", F.lit(None).cast("string")))


@query("join_01", "select r.locus, x.rid from regions r join (select * exclude (locus) from reads) x on x.chrom = r.chrom and x.pos < r.stop and r.start < x.end_pos")
def join_01(s, d):
    r = pj.regions(s, d).select("locus", "chrom", "start", "stop")
    return joins.overlap_join(r, pj.reads(s, d).select("rid", "chrom", "pos", "end_pos"), ["chrom"], ("start", "stop"), ("pos", "end_pos")).select("locus", "rid")


_PAIRS = """ranked as (select *, row_number() over (partition by rname, mate order by pos, rid) as k from reads),
pairs as (select a.rname, a.rid as rid_1, b.rid as rid_2, a.pos as pos_1, b.pos as pos_2, a.chrom as chrom_1, b.chrom as chrom_2 from ranked a join ranked b on a.rname = b.rname and a.k = b.k and a.mate = 1 and b.mate = 2)"""


def _pairs(s, d):
    r = pj.reads(s, d).select("rname", "mate", "rid", "pos", "chrom", "end_pos")
    p = joins.mate_pairs(r, ["rname"], ["pos", "rid"])
    return p.select("rname", *[F.col(f"{w}.{c}").alias(f"{c}_{k}") for k, w in ((1, "first"), (2, "second")) for c in ("rid", "pos", "chrom")])


@query("join_02", f"with {_PAIRS} select rname, rid_1, rid_2 from pairs")
def join_02(s, d):
    return _pairs(s, d).select("rname", "rid_1", "rid_2")


_VALID = """valid as (select a.rname, count(*) as n_valid, min(a.pos) as pos_1, min(b.pos) as pos_2 from reads a join reads b on a.rname = b.rname and a.chrom = b.chrom and a.mate = 1 and b.mate = 2 and abs(a.pos - b.pos) < 5000 group by 1)"""


def _valid(s, d):
    r = pj.reads(s, d).select("rname", "mate", "chrom", "pos")
    return joins.valid_pairings(r.where("mate = 1"), r.where("mate = 2"), ["rname"], 5000)


@query("join_03", f"with {_VALID} select rname, n_valid, pos_1, pos_2 from valid")
def join_03(s, d):
    return _valid(s, d).select("rname", "n_valid", "pos_1", "pos_2")


@query("flt_12", f"with {_VALID} select rname, pos_1, pos_2 from valid where n_valid = 1")
def flt_12(s, d):
    return _valid(s, d).where("n_valid = 1").select("rname", "pos_1", "pos_2")


@query("flt_13", "select rid from reads a where not exists (select 1 from reads b where b.rname = a.rname and b.mate <> a.mate)")
def flt_13(s, d):
    r = pj.reads(s, d).select("rid", "rname", "mate")
    both = r.groupBy("rname").agg(F.countDistinct("mate").alias("m")).where("m = 2")
    return r.join(both, "rname", "left_anti").select("rid")


@query("flt_14", "select rid from reads where sample in ('s1', 's3')")
def flt_14(s, d):
    return pj.reads(s, d).where(F.col("sample").isin("s1", "s3")).select("rid")


@query("join_05", "select distinct rname, case when length(n) > 2 then regexp_replace(n, '/.$', '') else n end as trimmed from (select rname, rname || '/' || mate as n from reads)")
def join_05(s, d):
    n = F.concat(F.col("rname").cast("string"), F.lit("/"), F.col("mate").cast("string"))
    return pj.reads(s, d).select("rname", F.when(F.length(n) > 2, F.regexp_replace(n, "/.$", "")).otherwise(n).alias("trimmed")).distinct()


@query("join_06", "select r.rid, s.pos as snp_pos from reads r join het_snps s on s.sample = r.sample and s.chrom = r.chrom and s.pos between r.pos and r.end_pos")
def join_06(s, d):
    return joins.snps_in_reads(pj.reads(s, d).select("rid", "sample", "chrom", "pos", "end_pos"), pj.het_snps(s, d)).select("rid", "snp_pos")


@query("join_07", "select r.locus, s.sample, s.pos as snp_pos from regions r join het_snps s on s.chrom = r.chrom and s.pos > r.start - 101 and s.pos < r.stop + 100")
def join_07(s, d):
    snps = pj.het_snps(s, d).withColumnRenamed("pos", "snp_pos").withColumn("snp_end", F.col("snp_pos") + 1)
    return joins.overlap_join(pj.regions(s, d).select("locus", "chrom", "start", "stop"), snps, ["chrom"], ("start", "stop"), ("snp_pos", "snp_end"), 256, 100).select("locus", "sample", "snp_pos")


@query("join_08", "select r.locus, m.s_acctbal is null as skipped from regions r left join (select s_suppkey, s_acctbal from supplier) m on m.s_suppkey = r.locus")
def join_08(s, d):
    models = pj.table(s, d, "supplier").select(F.col("s_suppkey").alias("locus"), "s_acctbal")
    return pj.regions(s, d).join(models, "locus", "left").select("locus", F.col("s_acctbal").isNull().alias("skipped"))


@query("join_09", "select r.locus, a.sample from regions r left join (select locus, sample from calls where gt_b > 1 and d1 > 1) a using (locus)")
def join_09(s, d):
    panel = pj.calls(s, d).where("gt_b > 1 and d1 > 1").select("locus", "sample")
    return pj.regions(s, d).select("locus").join(panel, "locus", "left")


@query("src_15", "select r.locus, c.sample from regions r join (select locus, sample, locus * 40 + 1 as vcf_start from calls) c on c.vcf_start = r.start + 1")
def src_15(s, d):
    panel = pj.calls(s, d).select("sample", (F.col("locus") * 40 + 1).alias("vcf_start"))
    return pj.regions(s, d).withColumn("vcf_start", F.col("start") + 1).join(panel, "vcf_start").select("locus", "sample")


@query("join_11", "select distinct sample from reads intersect select distinct sample from het_snps")
def join_11(s, d):
    return pj.reads(s, d).select("sample").intersect(pj.het_snps(s, d).select("sample"))


QUERIES["set_01"], SQL["set_01"] = QUERIES["join_11"], SQL["join_11"]


@query("set_02", "select distinct sample from reads where qual > 10 except select sample from reads where qual > 49 and library = 'R' and locus % 7 = 0 and sample = 's2'")
def set_02(s, d):
    r = pj.reads(s, d)
    gone = r.where("qual > 49 and library = 'R' and locus % 7 = 0 and sample = 's2'").select("sample")
    return r.where("qual > 10").select("sample").distinct().exceptAll(gone.distinct())


@query("set_03", "select sample, 'r' as src from reads group by 1 union all select sample, 's' from het_snps group by 1")
def set_03(s, d):
    return pj.reads(s, d).select("sample").distinct().withColumn("src", F.lit("r")).unionByName(pj.het_snps(s, d).select("sample").distinct().withColumn("src", F.lit("s")))


_PEOPLE = """people as (select c.locus, 1 + (k.locus_shift * 5 + cast(substr(c.sample, 2) as int)) as person, gt_a, gt_b from calls c, (select 0 as locus_shift) k),
kin as (select 0 as family, 3 as child, 1 as father, 2 as mother union all select 0, 4, 1, 2),
trio as (select f.locus, kin.child, f.gt_a as f_gt_a, f.gt_b as f_gt_b, m.gt_a as m_gt_a, m.gt_b as m_gt_b, c.gt_a as c_gt_a, c.gt_b as c_gt_b
 from kin join people f on f.person = kin.father join people m on m.person = kin.mother and m.locus = f.locus join people c on c.person = kin.child and c.locus = f.locus)"""


def _trio(s, d):
    people = pj.calls(s, d).withColumn("person", F.substring("sample", 2, 9).cast("int") + 1)
    kin = s.sql("select * from values (0, 3, 1, 2), (0, 4, 1, 2) as t(family, child, father, mother)")
    return joins.trios(kin, people, "person", ["gt_a", "gt_b"])


@query("join_12", f"with {_PEOPLE} select locus, child, f_gt_a, f_gt_b, m_gt_a, m_gt_b, c_gt_a, c_gt_b from trio")
def join_12(s, d):
    return _trio(s, d).select("locus", "child", "f_gt_a", "f_gt_b", "m_gt_a", "m_gt_b", "c_gt_a", "c_gt_b")


_MENDEL = "((c_gt_a in (m_gt_a, m_gt_b) and c_gt_b in (f_gt_a, f_gt_b)) or (c_gt_b in (m_gt_a, m_gt_b) and c_gt_a in (f_gt_a, f_gt_b)))"


@query("flt_26", f"with {_PEOPLE} select locus, bool_and({_MENDEL}) as mendelian from trio group by locus")
def flt_26(s, d):
    c = F.col
    ok = g.is_mendelian((c("c_gt_a"), c("c_gt_b")), (c("m_gt_a"), c("m_gt_b")), (c("f_gt_a"), c("f_gt_b")))
    return _trio(s, d).groupBy("locus").agg(F.bool_and(ok).alias("mendelian"))


@query("flt_27", "select locus, bool_or(n < 2) as any_missing, count(*) < 5 as lacks_sample from calls group by locus")
def flt_27(s, d):
    return pj.calls(s, d).groupBy("locus").agg(F.bool_or(F.col("n") < 2).alias("any_missing"), (F.count("*") < 5).alias("lacks_sample"))


@query("flt_30", "select p.family from ped p left join (select distinct o_custkey + 1 as person from orders) o on o.person = p.child group by 1 having bool_and(o.person is not null)")
def flt_30(s, d):
    known = pj.table(s, d, "orders").select((F.col("o_custkey") + 1).alias("child"), F.lit(True).alias("seen")).distinct()
    return pj.pedigree(s, d).join(known, "child", "left").groupBy("family").agg(F.bool_and(F.col("seen").isNotNull()).alias("ok")).where("ok").select("family")


@query("join_13", "select a.locus, a.sample, a.dp, b.n from calls a join (select locus, sample, n from calls where n > 1) b using (locus, sample)")
def join_13(s, d):
    left = pj.calls(s, d).select("locus", "sample", "gt_a", "dp")
    right = pj.calls(s, d).where("n > 1").select("locus", "sample", "gt_a", "n")
    return joins.merge_variants(left, right, ["locus", "sample"], ["gt_a"]).select("locus", "sample", "dp", "n")


@query("join_14", "select locus, sample from calls where sample not in (select 's' || n_nationkey from nation where n_regionkey = 0)")
def join_14(s, d):
    gone = pj.table(s, d, "nation").where("n_regionkey = 0").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("sample"))
    return pj.calls(s, d).select("locus", "sample").join(gone, "sample", "left_anti")


@query(
    "join_15",
    "with b as (select locus, 0 as block, gt_a as option, repeat('A', cast(gt_a as int) + 1) as seq from calls group by all), c as (select locus, 1 as block, gt_b as option, repeat('C', cast(gt_b as int) + 1) as seq from calls group by all) select b.locus, row_number() over (partition by b.locus order by b.option, c.option) - 1 as hap_index, b.seq || c.seq as seq from b join c using (locus)",
)
def join_15(s, d):
    c = pj.calls(s, d)
    one = c.select("locus", F.lit(0).alias("block"), F.col("gt_a").alias("option"), F.repeat(F.lit("A"), F.col("gt_a") + 1).alias("seq")).distinct()
    two = c.select("locus", F.lit(1).alias("block"), F.col("gt_b").alias("option"), F.repeat(F.lit("C"), F.col("gt_b") + 1).alias("seq")).distinct()
    return joins.haplotype_product(one.union(two)).select("locus", F.col("hap_index").cast("long").alias("hap_index"), "seq")


@query("flt_02", "select x.rid from (select *, locus * 40 as s, locus * 40 + 30 as e, lead(pos) over (partition by rname order by pos, rid) as mate_pos from reads) x where not ((pos >= e or end_pos <= s) and (mate_pos is null or mate_pos = pos or mate_pos >= e or mate_pos + 60 + 100 < s))")
def flt_02(s, d):
    mate = F.lead("pos").over(Window.partitionBy("rname").orderBy("pos", "rid"))
    r = pj.reads(s, d).withColumn("mate_pos", mate)
    paired = F.col("mate_pos").isNotNull()
    drop = flt.out_of_range(F.col("pos"), F.col("end_pos"), F.coalesce("mate_pos", F.lit(-1)), F.lit(60), paired, F.col("locus") * 40, F.col("locus") * 40 + 30)
    return r.where(~drop).select("rid")


@query("flt_01", "select rid from (select rid, (cast(rname as bigint) * 37 + mate * 64) % 256 as flag from reads) where not (flag & 1 <> 0 and flag & 192 = 0)")
def flt_01(s, d):
    flag = ((F.col("rname") * 37 + F.col("mate") * 64) % 256).cast("int")
    return pj.reads(s, d).where(~flt.is_paired_as_neither(flag)).select("rid")


@query("flt_06", "select doc_id from seqs where seq not like '%GGT%'")
def flt_06(s, d):
    return pj.sequences(s, d).where(~flt.has_n_bases(F.replace("seq", F.lit("GGT"), F.lit("N")))).select("doc_id")


@query("flt_07", "select rid from reads where (end_pos - pos) * ln(1 - pow(10, -(least(41, greatest(1, qual))) / 10.0)) >= -10")
def flt_07(s, d):
    ln = (F.col("end_pos") - F.col("pos")) * g.ln_correct(F.col("qual"))
    return pj.reads(s, d).where(~flt.has_low_quality(ln)).select("rid")


@query("flt_08", "select rid, pos <= locus * 40 - 5 and end_pos >= locus * 40 + 35 as spans from reads")
def flt_08(s, d):
    at = F.col("locus") * 40
    return pj.reads(s, d).select("rid", flt.spans_with_flank(F.col("pos"), F.col("end_pos"), at, at + 30).alias("spans"))


@query("flt_15", "select locus from regions where stop - start <= 40 and start >= 50 and stop + 50 <= (select max(stop) from regions)")
def flt_15(s, d):
    r = pj.regions(s, d)
    longest = r.agg(F.max("stop").alias("contig"))
    return r.join(F.broadcast(longest)).where(flt.locus_is_scannable(F.col("start"), F.col("stop"), F.col("contig"), 40)).select("locus")


@query("flt_16", "select locus, count(*) as n from reads group by 1 having count(*) between 20 and 35")
def flt_16(s, d):
    return pj.reads(s, d).groupBy("locus").agg(F.count("*").alias("n")).where(F.col("n").between(20, 35))


@query("flt_17", "with n as (select locus, sample, count(*) as n from reads where bp_diff >= -5 group by 1, 2), u as (select *, coalesce(sum(n) over (partition by locus order by sample rows between unbounded preceding and 1 preceding), 0) as b from n) select r.rid from reads r join u on u.locus = r.locus and u.sample = r.sample and u.b < 12 where r.bp_diff >= -5")
def flt_17(s, d):
    return flt.informative_reads(pj.reads(s, d).withColumn("length", F.lit(4)), 12).select("rid")


@query("flt_18", "select sample, chrom, pos from het_snps s where not exists (select 1 from regions r where r.chrom = s.chrom and s.pos between r.start - 15 and r.stop + 15)")
def flt_18(s, d):
    return joins.outside_regions(pj.het_snps(s, d), pj.regions(s, d)).select("sample", "chrom", "pos")


@query("flt_19", "select sample, chrom, pos from het_snps where pos not in (select l_partkey * 7 from lineitem where l_quantity > 45)")
def flt_19(s, d):
    bad = pj.table(s, d, "lineitem").where("l_quantity > 45").select((F.col("l_partkey") * 7).alias("pos")).distinct()
    return pj.het_snps(s, d).join(bad, "pos", "left_anti").select("sample", "chrom", "pos")


@query("flt_20", "select locus, sample, case when n < 2 then 'NO_READS' when dflankindel / n > 0.15 then 'FLANK_INDEL_FRAC' end as filter from calls")
def flt_20(s, d):
    rules = {"NO_READS": F.col("n") < 2, "FLANK_INDEL_FRAC": F.col("dflankindel") / F.col("n") > 0.15}
    return pj.calls(s, d).select("locus", "sample", flt.first_failing(rules).alias("filter"))


@query("flt_25", "select locus from calls group by locus having max(greatest(gt_a, gt_b)) > 1 and count(*) >= 4")
def flt_25(s, d):
    t = pj.calls(s, d).groupBy("locus").agg(F.max(F.greatest("gt_a", "gt_b")).alias("top"), F.count("*").alias("n"))
    return t.where("top > 1 and n >= 4").select("locus")


@query("flt_28", "select locus, sample from calls where gt_a <> 2")
def flt_28(s, d):
    gt = F.concat(F.col("gt_a").cast("string"), F.when(F.col("gt_a") == 2, F.lit("")).otherwise(F.lit("|")), F.col("gt_b").cast("string"))
    return pj.calls(s, d).where(flt.is_diploid(gt)).select("locus", "sample")


@query("flt_29", "select rid, case when qual > 5 and pos <= locus * 40 - 5 and end_pos >= locus * 40 + 35 then '1' else '0' end || case when qual > 5 and pos <= locus * 40 + 15 and end_pos >= locus * 40 + 65 then '1' else '0' end as pf from reads")
def flt_29(s, d):
    at = F.col("locus") * 40
    spans = F.array(F.struct(at.alias("start"), (at + 30).alias("stop")), F.struct((at + 20).alias("start"), (at + 60).alias("stop")))
    flags = flt.region_flags(F.col("pos"), F.col("end_pos"), F.col("qual") > 5, spans)
    return pj.reads(s, d).select("rid", F.array_join(F.transform(flags, lambda f: f.cast("int").cast("string")), "").alias("pf"))


@query("agg_01", "select locus, sample, count(*) as n, min(rid) as first_rid from reads group by 1, 2")
def agg_01(s, d):
    return pj.reads(s, d).groupBy("locus", "sample").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"))


@query("agg_02", "select rid from (select rid, row_number() over (partition by sample, library, locus, pos, end_pos order by score desc, rid) as k from reads) where k = 1")
def agg_02(s, d):
    r = pj.reads(s, d).select("rid", "sample", "library", "locus", "pos", "end_pos", "score")
    return agg.remove_duplicates(r, ["sample", "library", "locus", "pos", "end_pos"], [F.desc("score"), F.col("rid")]).select("rid")


QUERIES["win_01"], SQL["win_01"] = QUERIES["agg_02"], SQL["agg_02"]


@query("agg_03", "select locus, bp_diff, count(*) as n_reads, list_sort(list(qual))[count(*) // 2 + 1] as median_quality from reads group by 1, 2")
def agg_03(s, d):
    return agg.pool_reads(pj.reads(s, d).select("locus", "bp_diff", "qual"), ["locus", "bp_diff"], "qual")


@query(
    "agg_04",
    """with n as (select locus, sample, bp_diff, count(*) as n from reads group by all), s as (select *, n / sum(n) over (partition by locus, sample) as share from n),
    t as (select locus, bp_diff, cast(sum(n) as bigint) as n_reads, round(sum(share), 9) as share_sum, count(*) filter (n >= 2 and share >= 0.2) as n_strong from s group by all),
    z as (select locus, count(distinct sample) as samples, sum(n) as reads from n group by 1)
    select locus, bp_diff, n_reads, share_sum, n_strong, share_sum > 0.05 * samples or n_reads > 0.05 * z.reads or n_strong >= 1 as candidate from t join z using (locus)""".replace("z.reads", "z.total").replace("sum(n) as reads", "sum(n) as total"),
)
def agg_04(s, d):
    return agg.allele_support(pj.reads(s, d).select("locus", "sample", "bp_diff"), "bp_diff")


@query("agg_21", "select locus, sample, bp_diff, n from (select locus, sample, bp_diff, count(*) as n, sum(count(*)) over (partition by locus, sample) as t from reads group by 1, 2, 3) where n >= 2 and n / t >= 0.15")
def agg_21(s, d):
    return agg.stutter_candidates(pj.reads(s, d).select("locus", "sample", "bp_diff"), "bp_diff")


@query("agg_05", "select locus, sample, round(ln(sum(exp(bp_diff / 3.0))), 6) as lse from reads group by 1, 2")
def agg_05(s, d):
    r = pj.reads(s, d).select("locus", "sample", (F.col("bp_diff") / 3.0).alias("x"))
    return agg.grouped_log_sum_exp(r, ["locus", "sample"], "x").select("locus", "sample", F.round("lse", 6).alias("lse"))


@query("agg_08", "select locus, round(sum(score), 2) as total, count(*) filter (strand = 'O') as n_forward from reads group by 1")
def agg_08(s, d):
    return pj.reads(s, d).groupBy("locus").agg(F.round(F.sum("score"), 2).alias("total"), F.count_if(F.col("strand") == "O").alias("n_forward"))


def _ln(x: float) -> str:
    return f"ln({x!r})"


_STUTTER_SQL = f"""case when dd % period <> 0 then case when dd > 0 then {_ln(0.01)} else {_ln(0.01)} end + {_ln(0.95)} + (abs(dd - trunc(dd / period)) - 1) * {_ln(1 - 0.95)}
 when dd = 0 then {_ln(1 - 0.05 - 0.05 - 0.01 - 0.01)} else case when dd > 0 then {_ln(0.05)} else {_ln(0.05)} end + {_ln(0.95)} + (abs(trunc(dd / period)) - 1) * {_ln(1 - 0.95)} end"""
_POST_SQL = f"""typed as (select x.rid, x.locus, x.sample, x.bp_diff, r.period from reads x join regions r using (locus)),
ls as (select rid, locus, sample, a.k as allele, {_STUTTER_SQL} as l from (select t.*, k.k, bp_diff - 2 * k.k as dd from typed t, (select unnest([0, 1, 2]) as k) k) a),
joint as (select a.locus, a.sample, a.allele as gt_a, b.allele as gt_b, sum(ln(0.5 * exp(a.l) + 0.5 * exp(b.l))) + case when a.allele = b.allele then ln(2) else 0 end - ln(3) - ln(4) as lp from ls a join ls b using (rid) group by a.locus, a.sample, a.allele, b.allele),
post as (select locus, sample, gt_a, gt_b, lp - m - ln(sum(exp(lp - m)) over (partition by locus, sample)) as lp from (select *, max(lp) over (partition by locus, sample) as m from joint))"""


def _posteriors(s, d):
    r = pj.reads(s, d).select("locus", "sample", "bp_diff").join(pj.regions(s, d).select("locus", "period"), "locus")
    return agg.genotype_posteriors(r, 3, lambda k: g.log_stutter(F.col("bp_diff") - 2 * k, F.col("period"), MODEL))


@query("agg_09", f"with {_POST_SQL} select locus, sample, gt_a, gt_b, round(lp, 4) as lp from post")
def agg_09(s, d):
    return _posteriors(s, d).select("locus", "sample", "gt_a", "gt_b", F.round("lp", 4).alias("lp"))


@query("agg_10", f"with {_POST_SQL} select locus, sample, gt_a, gt_b from (select *, row_number() over (partition by locus, sample order by round(lp, 9) desc, gt_a, gt_b) as k from post) where k = 1")
def agg_10(s, d):
    return agg.best_genotype(_posteriors(s, d)).select("locus", "sample", "gt_a", "gt_b")


@query("agg_11", f"with {_POST_SQL} select locus, sample, least(gt_a, gt_b) as a, greatest(gt_a, gt_b) as b, round(sum(exp(lp)), 5) as p from post group by 1, 2, 3, 4")
def agg_11(s, d):
    p = _posteriors(s, d).select("locus", "sample", F.least("gt_a", "gt_b").alias("a"), F.greatest("gt_a", "gt_b").alias("b"), "lp")
    return p.groupBy("locus", "sample", "a", "b").agg(F.round(F.sum(F.exp("lp")), 5).alias("p"))


@query(
    "agg_12",
    f"with {_POST_SQL}, gl as (select locus, sample, gt_a, gt_b, round(lp / ln(10), 6) as gl from post where gt_a >= gt_b) select locus, sample, string_agg(cast(least(999, trunc(round(-10 * (gl - top), 4))) as int)::varchar, ',' order by gt_a, gt_b) as pl from (select *, max(gl) over (partition by locus, sample) as top from gl) group by 1, 2",
)
def agg_12(s, d):
    p = _posteriors(s, d).where("gt_a >= gt_b").withColumn("gl", F.round(F.col("lp") / 2.302585092994046, 6))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("gt_a", "gt_b", "gl"))), lambda r: r["gl"])
    best = F.array_max("gls")
    # Four decimals of the product, as SQL rounds: 18.99995 lies below its half as a double, and is no 19.
    phred = lambda x: F.round(-10 * (x - best) * 10000) / 10000
    pl = F.transform("gls", lambda x: F.least(F.lit(999), phred(x).cast("int")).cast("string"))
    return p.groupBy("locus", "sample").agg(rows.alias("gls")).select("locus", "sample", F.array_join(pl, ",").alias("pl"))


@query("agg_15", "select locus, sample, string_agg(bp_diff || '|' || n, ';' order by bp_diff) as histogram from (select locus, sample, bp_diff, count(*) as n from reads group by all) group by 1, 2")
def agg_15(s, d):
    return agg.count_histogram(pj.reads(s, d), ["locus", "sample"], "bp_diff")


for _n in ("prj_05",):
    QUERIES[_n], SQL[_n] = QUERIES["agg_15"], SQL["agg_15"]


@query("agg_16", "select locus, sample, count(*) filter (strand = 'O') as n_forward, count(*) filter (bp_diff <> 0) as n_stutter, count(*) filter (library = 'R') as n_r from reads group by 1, 2")
def agg_16(s, d):
    return pj.reads(s, d).groupBy("locus", "sample").agg(F.count_if(F.col("strand") == "O").alias("n_forward"), F.count_if(F.col("bp_diff") != 0).alias("n_stutter"), F.count_if(F.col("library") == "R").alias("n_r"))


@query("agg_17", "with e as (select locus, gt_a as allele from calls where sample in ('s0', 's1') union all select locus, gt_b from calls where sample in ('s0', 's1')), l as (select distinct locus, k as allele from e, (select unnest([0, 1, 2]) as k)), n as (select l.locus, l.allele, count(e.locus) + 1 as n from l left join e using (locus, allele) group by 1, 2) select locus, allele, round(log10(n / sum(n) over (partition by locus)), 6) as log_freq from n")
def agg_17(s, d):
    founders = pj.calls(s, d).where(F.col("sample").isin("s0", "s1"))
    return agg.founder_frequencies(founders, 3).withColumn("log_freq", F.round("log_freq", 6))


@query("agg_22", "select distinct r.locus, r.bp_diff from reads r where not exists (select 1 from calls c where c.locus = r.locus and (c.gt_a = r.bp_diff or c.gt_b = r.bp_diff))")
def agg_22(s, d):
    used = pj.calls(s, d).select("locus", F.explode(F.array("gt_a", "gt_b")).alias("bp_diff")).distinct()
    return pj.reads(s, d).select("locus", "bp_diff").distinct().join(used, ["locus", "bp_diff"], "left_anti")


_WORDS = "select o_custkey % 50 as pair, o_orderkey * 2654435761 % 4294967296 as a1, o_orderkey * 40503 % 65536 as a2, o_orderkey * 97 % 65536 as b1, o_orderkey * 31 % 65536 as b2 from orders"
_DIST = "cast(sum(bit_count(xor({0}, {1}))) as bigint)"


def _distances(s, d):
    o, k = pj.table(s, d, "orders"), F.col("o_orderkey")
    w = o.select((F.col("o_custkey") % 50).alias("pair"), (k * 2654435761 % 4294967296).alias("a1"), (k * 40503 % 65536).alias("a2"), (k * 97 % 65536).alias("b1"), (k * 31 % 65536).alias("b2"))
    return agg.haplotype_distances(w, ["pair"])


_DISTS = f"dist as (select pair, {_DIST.format('a1', 'b1')} as d11, {_DIST.format('a1', 'b2')} as d12, {_DIST.format('a2', 'b1')} as d21, {_DIST.format('a2', 'b2')} as d22 from ({_WORDS}) group by pair)"


@query("agg_23", f"with {_DISTS} select * from dist")
def agg_23(s, d):
    return _distances(s, d)


@query("agg_24", f"with {_DISTS}, l as (select pair, unnest([d11, d12, d21, d22]) as v, unnest([0, 1, 2, 3]) as k from dist), r as (select *, row_number() over (partition by pair order by v, k) as o from l) select pair, max(v) filter (o = 1) as best, cast(max(k) filter (o = 1) as int) as best_index, max(v) filter (o = 2) as second from r group by pair")
def agg_24(s, d):
    t = _distances(s, d)
    return t.select("pair", agg.two_smallest([F.col(c) for c in ("d11", "d12", "d21", "d22")]).alias("m")).select("pair", "m.best", "m.best_index", "m.second")


@query("agg_30", "select locus, min(pos) as first_pos, max(end_pos) as last_pos from reads group by 1")
def agg_30(s, d):
    return pj.reads(s, d).groupBy("locus").agg(F.min("pos").alias("first_pos"), F.max("end_pos").alias("last_pos"))


@query("win_02", "select rid, coalesce(lag(rname) over (partition by locus order by rname, rid) = rname, false) as second_mate from reads")
def win_02(s, d):
    before = F.lag("rname").over(Window.partitionBy("locus").orderBy("rname", "rid"))
    return pj.reads(s, d).select("rid", F.coalesce(before == F.col("rname"), F.lit(False)).alias("second_mate"))


@query("win_03", "select rid, cast(sum(bp_diff) over (partition by locus, rname) as bigint) as folded from reads")
def win_03(s, d):
    return pj.reads(s, d).select("rid", F.sum("bp_diff").over(Window.partitionBy("locus", "rname")).alias("folded"))


@query("win_06", "select rid from (select rid, row_number() over (partition by locus order by rid) as k from reads) where k % 3 = 0")
def win_06(s, d):
    k = F.row_number().over(Window.partitionBy("locus").orderBy("rid"))
    return pj.reads(s, d).select("rid", k.alias("k")).where("k % 3 = 0").select("rid")


@query("ord_02", "select locus, string_agg(a, ',' order by length(a), a) as alleles from (select distinct locus, repeat('AC', cast(gt_b as int) + 1) || case when gt_a = 1 then 'G' else '' end as a from calls) group by 1")
def ord_02(s, d):
    a = F.concat(F.repeat(F.lit("AC"), F.col("gt_b") + 1), F.when(F.col("gt_a") == 1, "G").otherwise(""))
    rows = F.array_sort(F.collect_set(F.struct(F.length("a").alias("n"), "a")))
    return pj.calls(s, d).select("locus", a.alias("a")).groupBy("locus").agg(F.array_join(F.transform(rows, lambda r: r["a"]), ",").alias("alleles"))


@query("ord_03", "select rid, row_number() over (partition by locus order by pos, end_pos, rid) as ord from reads")
def ord_03(s, d):
    return pj.reads(s, d).select("rid", F.row_number().over(Window.partitionBy("locus").orderBy("pos", "end_pos", "rid")).cast("long").alias("ord"))


@query("ord_05", "select locus, count(*) as n_haplotypes from (select distinct locus, gt_a, gt_b from calls) group by 1 having count(*) <= 4")
def ord_05(s, d):
    t = pj.calls(s, d).select("locus", "gt_a", "gt_b").distinct().groupBy("locus").agg(F.count("*").alias("n_haplotypes"))
    return t.where("n_haplotypes <= 4")


@query("scl_05", "select doc_id, translate(reverse(seq), 'ACGT', 'TGCA') as rc from seqs")
def scl_05(s, d):
    return pj.sequences(s, d).select("doc_id", g.reverse_complement(F.col("seq")).alias("rc"))


_CIGAR = "qual || 'M' || case when bp_diff > 0 then bp_diff || 'I' when bp_diff < 0 then (-bp_diff) || 'D' else '' end || '20M3S'"


def _cigar(s, d):
    b, q = F.col("bp_diff"), F.col("qual")
    return pj.reads(s, d).withColumn("cigar", F.concat(q.cast("string"), F.lit("M"), F.when(b > 0, F.concat(b.cast("string"), F.lit("I"))).when(b < 0, F.concat((-b).cast("string"), F.lit("D"))).otherwise(""), F.lit("20M3S")))


@query("scl_07", f"select rid, {_CIGAR} as cigar from reads")
def scl_07(s, d):
    return _cigar(s, d).select("rid", g.cigar_string(g.cigar_elements(F.col("cigar"))).alias("cigar"))


@query("scl_26", "select rid, case when bp_diff <> 0 then 1 else 0 end as indels, qual + 20 as matched, qual + 23 + greatest(bp_diff, 0) as read_length from reads")
def scl_26(s, d):
    e = g.cigar_elements(F.col("cigar"))
    return _cigar(s, d).select("rid", g.cigar_count(e, "ID").alias("indels"), g.cigar_sum(e, "M=X").alias("matched"), g.cigar_sum(e, "MIS=X").alias("read_length"))


@query("agg_29", "select locus, pos + qual as pos, max(bp_diff) as size from reads where bp_diff > 0 group by 1, 2")
def agg_29(s, d):
    return agg.max_insertions(_cigar(s, d))


@query("scl_24", "select doc_id, upper(seq) as up, starts_with(seq, 'AC') as starts, ends_with(seq, 'GT') as ends, len(string_split(seq, 'GG')) as parts from seqs")
def scl_24(s, d):
    q = F.col("seq")
    return pj.sequences(s, d).select("doc_id", F.upper(q).alias("up"), q.startswith("AC").alias("starts"), q.endswith("GT").alias("ends"), F.size(F.split(q, "GG", -1)).cast("long").alias("parts"))


@query("mdl_11", "select k.kmer, count(*) as n from (select substr(seq, i, 10) as kmer from (select seq, unnest(range(1, greatest(length(seq) - 8, 1))) as i from seqs)) k group by 1")
def mdl_11(s, d):
    # One pass over a sequence of any length; a substring at each place would count from the start every time.
    kmers = pj.sequences(s, d).select(F.explode(F.regexp_extract_all("seq", F.lit("(?=(.{10}))"), 1)).alias("kmer"))
    return kmers.groupBy("kmer").agg(F.count("*").alias("n"))


_Q = "least(41, greatest(1, qual))"


@query("mth_01", f"select rid, round(ln(1 - pow(10, -{_Q} / 10.0)), 9) as correct, round(ln(pow(10, -least(41, greatest(0, qual)) / 10.0) / 3), 9) as wrong from reads")
def mth_01(s, d):
    q = F.col("qual")
    return pj.reads(s, d).select("rid", F.round(g.ln_correct(q), 9).alias("correct"), F.round(g.ln_error(q), 9).alias("wrong"))


@query("mth_03", f"select rid, round({_STUTTER_SQL}, 6) as ln_p from (select x.rid, x.bp_diff as dd, r.period from reads x join regions r using (locus))")
def mth_03(s, d):
    r = pj.reads(s, d).select("rid", "locus", "bp_diff").join(pj.regions(s, d).select("locus", "period"), "locus")
    return r.select("rid", F.round(g.log_stutter(F.col("bp_diff"), F.col("period"), MODEL), 6).alias("ln_p"))


@query("mth_05", f"select rid, round(case when abs(dd) > 2 * period then -1e7 else {_STUTTER_SQL} end, 6) as ln_p from (select x.rid, x.bp_diff as dd, r.period from reads x join regions r using (locus))")
def mth_05(s, d):
    r = pj.reads(s, d).select("rid", "locus", "bp_diff").join(pj.regions(s, d).select("locus", "period"), "locus")
    return r.select("rid", F.round(g.log_pcr_artifact(F.col("bp_diff"), F.col("period"), MODEL, 2), 6).alias("ln_p"))


@query("mth_06", "select distinct qual, round(case when qual = 0 then -1000 else ln(qual) end, 9) as ln from reads")
def mth_06(s, d):
    q = F.col("qual")
    return pj.reads(s, d).select("qual", F.round(F.when(q == 0, F.lit(-1000.0)).otherwise(F.log(q)), 9).alias("ln")).distinct()


@query("mth_07", "select locus, sample, round(case when gt_a = gt_b then ln(2) else 0 end - ln(3) - ln(4), 9) as prior from calls")
def mth_07(s, d):
    return pj.calls(s, d).select("locus", "sample", F.round(g.genotype_prior(F.col("gt_a"), F.col("gt_b"), F.lit(3)), 9).alias("prior"))


@query("mth_08", f"select r.rid, round(sum(case when s.pos % 2 = 0 then ln(1 - pow(10, -{_Q} / 10.0)) else ln(pow(10, -{_Q} / 10.0) / 3) end), 6) as p1, round(sum(case when s.pos % 2 = 0 then ln(pow(10, -{_Q} / 10.0) / 3) else ln(1 - pow(10, -{_Q} / 10.0)) end), 6) as p2 from reads r join het_snps s on s.sample = r.sample and s.chrom = r.chrom and s.pos between r.pos and r.end_pos group by 1")
def mth_08(s, d):
    r = pj.reads(s, d).select("rid", "sample", "chrom", "pos", "end_pos", "qual")
    q = F.greatest(F.lit(1), F.least(F.lit(41), F.col("qual")))
    first = F.col("snp_pos") % 2 == 0
    right, wrong = g.ln_correct(q), g.ln_error(q)
    hit = joins.snps_in_reads(r, pj.het_snps(s, d))
    return hit.groupBy("rid").agg(F.round(F.sum(F.when(first, right).otherwise(wrong)), 6).alias("p1"), F.round(F.sum(F.when(first, wrong).otherwise(right)), 6).alias("p2"))


@query("mdl_19", "select r.rid, count(s.pos) as n_snps from reads r left join het_snps s on s.sample = r.sample and s.chrom = r.chrom and s.pos between r.pos and r.end_pos group by 1")
def mdl_19(s, d):
    r = pj.reads(s, d).select("rid", "sample", "chrom", "pos", "end_pos")
    hit = joins.snps_in_reads(r, pj.het_snps(s, d)).groupBy("rid").agg(F.count("*").alias("n"))
    return r.select("rid").join(hit, "rid", "left").select("rid", F.coalesce("n", F.lit(0)).alias("n_snps"))


@query("mth_13", "select locus, sample, round(log10(0.3) + log10(0.7) + case when gt_a = gt_b then 0 else log10(2) end, 9) as unphased, round(log10(0.3) + log10(0.7), 9) as phased from calls")
def mth_13(s, d):
    p, q, same = F.log10(F.lit(0.3)), F.log10(F.lit(0.7)), F.col("gt_a") == F.col("gt_b")
    return pj.calls(s, d).select("locus", "sample", F.round(g.hardy_weinberg(p, q, same, False), 9).alias("unphased"), F.round(g.hardy_weinberg(p, q, same, True), 9).alias("phased"))


@query("mth_14", "select locus, round(-log10(2) - log10(stop - start - 1), 9) as prior from regions")
def mth_14(s, d):
    return pj.regions(s, d).select("locus", F.round(g.mutation_prior(F.col("stop") - F.col("start")), 9).alias("prior"))


_CHOOSE = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))"


@query("mth_11", f"select locus, sample, round(log10(least(1, 2 * list_sum(list_transform(range(0, least(d1, d2) + 1), lambda i: exp({_CHOOSE.format('n', 'i')} - n * ln(2)))))), 6) + 0.0 as ab from calls")
def mth_11(s, d):
    return pj.calls(s, d).select("locus", "sample", (F.round(g.binomial_two_sided(F.col("d1"), F.col("n")), 6) + 0.0).alias("ab"))


_LNP = f"({_CHOOSE.format('(d1 + d2)', 'x')} + {_CHOOSE.format('(d2 + gt_a + gt_b + 3 - d2)', '(d1 + gt_a + 1 - x)')} - {_CHOOSE.format('(d1 + d2 + gt_a + gt_b + 3)', '(d1 + gt_a + 1)')})"


@query(
    "mth_12",
    f"""with x as (select locus, sample, d1, d2, gt_a, gt_b, unnest(range(greatest(0, d1 + gt_a + 1 - (gt_a + gt_b + 3)), least(d1 + d2, d1 + gt_a + 1) + 1)) as x from calls),
    p as (select *, {_LNP} as lp from x), o as (select locus, sample, lp as seen from p where x = d1)
    select locus, sample, round(log10(least(1, sum(exp(lp)) filter (lp <= seen + 1e-8))), 6) + 0.0 as fs from p join o using (locus, sample) group by 1, 2""",
)
def mth_12(s, d):
    c = pj.calls(s, d)
    return c.select("locus", "sample", (F.round(g.fisher_two_sided(F.col("d1"), F.col("d2"), F.col("gt_a") + 1, F.col("gt_b") + 2), 6) + 0.0).alias("fs"))


@query("prj_01", "select locus, sample, list_value(0, 2, 1)[cast(gt_a as int) + 1] || '|' || list_value(0, 2, 1)[cast(gt_b as int) + 1] as gt from calls")
def prj_01(s, d):
    to = F.array(F.lit(0), F.lit(2), F.lit(1))
    new = lambda c: F.element_at(to, F.col(c).cast("int") + 1).cast("string")
    return pj.calls(s, d).select("locus", "sample", F.concat(new("gt_a"), F.lit("|"), new("gt_b")).alias("gt"))


@query("prj_02", f"with {_POST_SQL} select locus, sample, round(max(exp(lp)), 5) as q from post group by 1, 2")
def prj_02(s, d):
    return _posteriors(s, d).groupBy("locus", "sample").agg(F.round(F.exp(F.max("lp")), 5).alias("q"))


@query("prj_08", "select r.locus, s.sample, coalesce(c.gt_a || '|' || c.gt_b, '.') as gt from regions r cross join (select distinct sample from reads) s left join calls c on c.locus = r.locus and c.sample = s.sample")
def prj_08(s, d):
    samples = F.array(*[F.lit(f"s{k}") for k in range(5)])
    grid = pj.regions(s, d).select("locus", F.explode(samples).alias("sample"))
    c = pj.calls(s, d).select("locus", "sample", F.concat_ws("|", "gt_a", "gt_b").alias("gt"))
    return grid.join(c, ["locus", "sample"], "left").select("locus", "sample", F.coalesce("gt", F.lit(".")).alias("gt"))


@query("prj_12", f"with {_HAPLOID_SQL} select locus, string_agg(gb || ':' || dp, ';' order by sample) as calls_text, cast(sum(dp) as bigint) as dp from haploid where dp >= 30 group by 1")
def prj_12(s, d):
    h = _haploid(s, d).where("dp >= 30")
    rows = F.array_sort(F.collect_list(F.struct("sample", F.concat_ws(":", "gb", "dp").alias("t"))))
    return h.groupBy("locus").agg(F.array_join(F.transform(rows, lambda r: r["t"]), ";").alias("calls_text"), F.sum("dp").alias("dp"))


@query("mdl_20", f"with {_DISTS} select pair, case when least(d11, d12, d21, d22) <= 2500 then 'PASS' else 'FAIL' end || ':' || d11 || ',' || d12 || ',' || d21 || ',' || d22 as cell from dist")
def mdl_20(s, d):
    t = _distances(s, d)
    ok = F.when(F.least("d11", "d12", "d21", "d22") <= 2500, "PASS").otherwise("FAIL")
    return t.select("pair", F.concat(ok, F.lit(":"), F.concat_ws(",", "d11", "d12", "d21", "d22")).alias("cell"))
