"""Queries of field extraction, output fields and priors, each with its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import genetics as g
from ..operators import filters as flt
from ..operators import pedigree
from ..sources import projection as pj
from .relational import _POST_SQL, _posteriors, query

_GT = "case when gt_a = 2 then gt_b || '' when gt_b = 2 then gt_a || '/' || '.' else gt_a || '|' || gt_b end"


def _with_gt(s, d):
    a, b = F.col("gt_a").cast("string"), F.col("gt_b").cast("string")
    return pj.calls(s, d).withColumn("gt", F.when(F.col("gt_a") == 2, b).when(F.col("gt_b") == 2, F.concat(a, F.lit("/."))).otherwise(F.concat(a, F.lit("|"), b)))


@query("src_12", f"select locus, sample, case when gt like '%|%' then split_part(gt, '|', 1)::int else -1 end as a, case when gt like '%|%' then split_part(gt, '|', 2)::int else -1 end as b, gt like '%|%' as phased, gt not like '%|%' as missing from (select locus, sample, {_GT} as gt from calls)")
def src_12(s, d):
    return _with_gt(s, d).select("locus", "sample", g.genotype(F.col("gt")).alias("x")).select("locus", "sample", "x.*")


@query("src_13", "select locus, sample, dp::int as dp, gt_b::int as last from calls")
def src_13(s, d):
    info = F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";AC="), F.col("gt_a").cast("string"), F.lit(","), F.col("gt_b").cast("string"))
    m = pj.calls(s, d).select("locus", "sample", g.info_map(info).alias("m"))
    return m.select("locus", "sample", F.col("m")["DP"].cast("int").alias("dp"), g.int_list(F.col("m")["AC"])[1].alias("last"))


@query("src_14", "select locus, sample, gt_a = 0 and gt_b = 1 as snp from calls")
def src_14(s, d):
    alleles = F.array(F.repeat(F.lit("A"), F.col("gt_a") + 1), F.repeat(F.lit("C"), F.abs(F.col("gt_b") - 1) + 1))
    return pj.calls(s, d).select("locus", "sample", flt.is_biallelic_snp(alleles).alias("snp"))


@query("src_16", f"with {_POST_SQL} select locus, sample, allele, round(max(lp), 4) as best from (select locus, sample, gt_a as allele, lp from post union all select locus, sample, gt_b, lp from post) group by 1, 2, 3")
def src_16(s, d):
    each = _posteriors(s, d).select("locus", "sample", F.explode(F.array("gt_a", "gt_b")).alias("allele"), "lp")
    return each.groupBy("locus", "sample", "allele").agg(F.round(F.max("lp"), 4).alias("best"))


@query("src_20", "select distinct chrom from het_snps where chrom not in (select chrom from regions where chrom <> 'chr2')")
def src_20(s, d):
    known = pj.regions(s, d).where("chrom <> 'chr2'").select("chrom").distinct()
    return pj.het_snps(s, d).select("chrom").distinct().join(known, "chrom", "left_anti")


@query("src_10", "select doc_id, substr(seq, 11, 25) as piece, length(seq) as n from seqs")
def src_10(s, d):
    return pj.sequences(s, d).select("doc_id", F.substring("seq", 11, 25).alias("piece"), F.length("seq").cast("long").alias("n"))


@query("prj_03", f"with {_POST_SQL} select locus, sample, round(sum(exp(lp)) filter (gt_a > gt_b), 4) as one, round(sum(exp(lp)) filter (gt_a < gt_b), 4) as two from post group by 1, 2")
def prj_03(s, d):
    p = F.exp("lp")
    a, b = F.sum(F.when(F.col("gt_a") > F.col("gt_b"), p)), F.sum(F.when(F.col("gt_a") < F.col("gt_b"), p))
    return _posteriors(s, d).groupBy("locus", "sample").agg(F.round(a, 4).alias("one"), F.round(b, 4).alias("two"))


@query("prj_06", f"with {_POST_SQL}, m as (select locus, sample, [0, 2, 1][gt_a + 1] as a, [0, 2, 1][gt_b + 1] as b, round(lp, 3) as lp from post where gt_a >= gt_b) select locus, sample, string_agg(greatest(a, b) || ':' || least(a, b), ',' order by greatest(a, b), least(a, b)) as ord, round(max(lp), 3) as best from m group by 1, 2")
def prj_06(s, d):
    new = F.array(F.lit(0), F.lit(2), F.lit(1))
    a, b = F.element_at(new, F.col("gt_a") + 1), F.element_at(new, F.col("gt_b") + 1)
    rows = _posteriors(s, d).where("gt_a >= gt_b").select("locus", "sample", F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.round("lp", 3).alias("lp"))
    order = F.array_sort(F.collect_list(F.struct("hi", "lo")))
    text = F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["hi"], x["lo"])), ",")
    return rows.groupBy("locus", "sample").agg(text.alias("ord"), F.round(F.max("lp"), 3).alias("best"))


@query("prj_14", "select locus, sample, 'GT:DP:NOMUT' as format, gt_a || '|' || gt_b || ':' || dp || ':' || n as cell from calls")
def prj_14(s, d):
    keys = F.split(F.lit("GT:GL:PL:DP:PHASEDGL"), ":")
    values = F.array(F.concat_ws("|", "gt_a", "gt_b"), F.lit("-1,0,-1"), F.lit("0,0,0"), F.col("dp").cast("string"), F.lit("0"))
    gone = F.array(F.lit("GL"), F.lit("PL"), F.lit("PHASEDGL"))
    kept = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: ~F.array_contains(gone, x["k"]))
    t = pj.calls(s, d).select("locus", "sample", "n", kept.alias("x"))
    return t.select("locus", "sample", F.concat(F.array_join(F.transform("x", lambda x: x["k"]), ":"), F.lit(":NOMUT")).alias("format"), F.concat_ws(":", F.array_join(F.transform("x", lambda x: x["v"]), ":"), "n").alias("cell"))


@query("agg_18", "select distinct locus, k as allele, round(-log10(3), 9) as log_freq from calls, (select unnest([0, 1, 2]) as k)")
def agg_18(s, d):
    return pj.calls(s, d).select("locus").distinct().select("locus", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("allele"), F.round(-F.log10(F.lit(3.0)), 9).alias("log_freq"))


@query("agg_19", "with n as (select *, 1.0::double / count(*) over (partition by locus, sample) as w from reads), a as (select locus, bp_diff, 1 + sum(w) as w from n group by 1, 2) select locus, bp_diff, round(ln(w / sum(w) over (partition by locus)), 6) as log_prior from a")
def agg_19(s, d):
    sizes = pj.reads(s, d).groupBy("locus", "sample", "bp_diff").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("locus", "sample"))
    w = sizes.withColumn("share", share).groupBy("locus", "bp_diff").agg((1 + F.sum("share")).alias("w"))
    return w.select("locus", "bp_diff", F.round(F.log(F.col("w") / F.sum("w").over(Window.partitionBy("locus"))), 6).alias("log_prior"))


@query("ctl_05", "select locus, sample, cast(case sample when 's0' then 1 when 's2' then 2 when 's4' then 3 else 0 end as bigint) as idx from calls")
def ctl_05(s, d):
    return pj.calls(s, d).select("locus", "sample", F.array_position(F.array(F.lit("s0"), F.lit("s2"), F.lit("s4")), F.col("sample")).alias("idx"))


#: Families in threes, the first children of one being fathers in the next: up to four generations.
_DEEP = "deep as (select family - family % 12 as family, child, father, mother from ped union all select distinct family - family % 12, family + 1, family - 1, null from ped where family % 12 in (4, 8))"
_LINKS = "links as (select distinct child, father as parent from deep union select distinct child, mother from deep where mother is not null), everyone as (select child as person from deep union select father from deep union select mother from deep where mother is not null), seen as (select person from everyone where person in (select o_custkey + 1 from orders))"


@query(
    "mdl_17",
    f"""with recursive {_DEEP}, {_LINKS},
    depth as (select person, 0 as k from everyone where person not in (select child from links) union select l.child, k + 1 from depth join links l on l.parent = depth.person),
    below as (select person from seen union select l.child from below join links l on l.parent = below.person),
    above as (select person from seen union select l.parent from above join links l on l.child = above.person),
    kept as (select person from below intersect select person from above),
    own as (select l.* from links l where child in (select person from kept) and parent in (select person from kept)),
    couples as (select d.* from deep d where child in (select person from kept) and father in (select person from kept) and mother in (select person from kept)),
    broods as (select parent, count(*) as n from own group by 1),
    groups as (select father, mother, count(*) as n, bool_and(child not in (select parent from own)) as last from couples group by 1, 2),
    families as (select g.father, g.mother from groups g join broods f on f.parent = g.father and f.n = g.n join broods m on m.parent = g.mother and m.n = g.n
      where last and father not in (select child from own) and mother not in (select child from own)),
    members as (select father as person from families union select mother from families union select child from couples join families using (father, mother))
    select person, max(k) as layer, person in (select person from kept) as kept, person in (select person from members) as nuclear from depth group by person""",
)
def mdl_17(s, d):
    """Everyone's generation, whether they belong to a sequenced lineage, and whether to a nuclear family of it."""
    ped = pj.pedigree(s, d)
    block = F.col("family") - F.col("family") % 12
    deeper = ped.where((F.col("family") % 12).isin(4, 8)).select(block.alias("family"), (F.col("family") + 1).alias("child"), (F.col("family") - 1).alias("father"), F.lit(None).cast("long").alias("mother"))
    rows = pedigree.checked(ped.withColumn("family", block).unionByName(deeper))
    seen = pj.table(s, d, "orders").select((F.col("o_custkey") + 1).alias("person")).distinct()
    _, kept = pedigree.sequenced_lineage(rows, seen)
    families = pedigree.nuclear_families(rows, seen)
    members = families.select(F.explode(F.concat(F.array("mother", "father"), "children")).alias("person")).distinct()
    out = pedigree.generations(rows).join(kept.withColumn("k", F.lit(True)), "person", "left").join(members.withColumn("m", F.lit(True)), "person", "left")
    return out.select("person", "layer", F.col("k").isNotNull().alias("kept"), F.col("m").isNotNull().alias("nuclear"))
