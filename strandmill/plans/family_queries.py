"""Queries of families with phased SNPs: haplotype words, inheritance and the scan for new mutations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import families as fm
from ..sources import projection as pj
from .relational import _posteriors, query

#: family, child, mother, father; person p is sample s(p - 1).
KIN = [(0, 3, 1, 2), (0, 4, 1, 2)]
_KIN = "select * from (values (0, 3, 1, 2), (0, 4, 1, 2)) as t(family, child, mother, father)"
#: Both haplotypes of each person at the site of order k: the children's come from their parents, with errors.
_ERROR = "(k % 4001 = 0 or (chrom = 'chr4' and k % 5 = 0))"
_ALLELES = {
    1: ("k {0} 3 % 2", "k {0} 5 % 2"),
    2: ("k {0} 7 % 2", "k {0} 11 % 2"),
    3: (f"case when {_ERROR} then 1 - k {{0}} 3 % 2 else k {{0}} 3 % 2 end", "k {0} 11 % 2"),
    4: ("case when chrom < 'chr3' then k {0} 5 % 2 else k {0} 11 % 2 end", "case when chrom < 'chr3' then k {0} 7 % 2 else k {0} 3 % 2 end"),
}
_MISSING = "p = 2 and k % 31 = 0"


def _snp_calls(s, d):
    """Phased SNPs of a family at the sites of het_snps: chrom, pos, person, gt_a, gt_b."""
    span = pj.table(s, d, "part").agg(((F.greatest(F.max("p_partkey") + 1, F.lit(1))) * 40).cast("long").alias("span"))
    o = pj.table(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    sites = o.crossJoin(F.broadcast(span)).select(F.concat(F.lit("chr"), (F.col("k") % 4 + 1).cast("string")).alias("chrom"), (F.col("k") * 7 % F.col("span")).alias("pos"), "k")
    sites = sites.groupBy("chrom", "pos").agg(F.min("k").alias("k"))
    each = F.array(*[F.struct(F.lit(p).cast("long").alias("p"), F.expr(a.format("div")).cast("int").alias("a"), F.expr(b.format("div")).cast("int").alias("b")) for p, (a, b) in _ALLELES.items()])
    rows = sites.select("chrom", "pos", "k", F.explode(each).alias("g")).select("chrom", "pos", "k", "g.*")
    known = lambda c: F.when(~F.expr(_MISSING), F.col(c))
    return rows.select("chrom", "pos", F.col("p").alias("person"), known("a").alias("gt_a"), known("b").alias("gt_b"))


_SITES = "sites as (select 'chr' || (o_orderkey % 4 + 1) as chrom, o_orderkey * 7 % (select greatest(max(p_partkey) + 1, 1) * 40 from part) as pos, min(o_orderkey) as k from orders group by 1, 2)"
_GENOTYPES = "snp_calls as (" + " union all ".join(f"select chrom, pos, {p} as person, case when not ({_MISSING.replace('p =', f'{p} =')}) then {a.format('//')} end as gt_a, case when not ({_MISSING.replace('p =', f'{p} =')}) then {b.format('//')} end as gt_b from sites" for p, (a, b) in _ALLELES.items()) + ")"
_TRIOS = f"""trio as (select q.*, c.chrom, c.pos, c.gt_a as c1, c.gt_b as c2, m.gt_a as m1, m.gt_b as m2, f.gt_a as f1, f.gt_b as f2
  from ({_KIN}) q join snp_calls c on c.person = child join snp_calls m on m.person = mother and m.chrom = c.chrom and m.pos = c.pos join snp_calls f on f.person = father and f.chrom = c.chrom and f.pos = c.pos),
fit as (select *, bool_and(coalesce((c1 in (m1, m2) and c2 in (f1, f2)) or (c2 in (m1, m2) and c1 in (f1, f2)), false)) over (partition by family, chrom, pos) as ok from trio)"""
_COUNTS = ", ".join(f"count(*) filter (ok and c{1 + k // 2} <> {p}{1 + k % 2}) as {p}{k}" for p in "mf" for k in range(4))
_NEAR = f"near as (select locus, family, child, {_COUNTS} from regions r join fit on fit.chrom = r.chrom and fit.pos between r.start - 500000 and r.start + 500000 group by all)"


def _best(p: str) -> str:
    return f"list_sort([struct_pack(d := {p}{0}, k := 0), struct_pack(d := {p}{1}, k := 1), struct_pack(d := {p}{2}, k := 2), struct_pack(d := {p}{3}, k := 3)])"


def _members(s):
    return s.createDataFrame(KIN, "family long, child long, mother long, father long")


def _inherited(s, d):
    calls = _snp_calls(s, d)
    sites = fm.numbered_sites(calls)
    words = fm.family_words(fm.haplotype_words(calls, sites), _members(s))
    loci = pj.regions(s, d).select("locus", "chrom", F.col("start").cast("long").alias("pos"))
    return fm.inheritance(fm.distances(loci, words, sites))


@query("mdl_14", f"with {_SITES}, {_GENOTYPES}, numbered as (select chrom, pos, row_number() over (partition by chrom order by pos) - 1 as n from sites), bits as (select chrom, n // 63 as word, person, case when gt_a = 1 then 1::bigint << (n % 63) else 0 end as b1, case when gt_b = 1 then 1::bigint << (n % 63) else 0 end as b2 from snp_calls join numbered using (chrom, pos)), ends as (select distinct c.chrom, e.word, person, 0::bigint, 0::bigint from snp_calls c join (select chrom, (max(n) + 1) // 63 as word from numbered group by 1) e using (chrom)) select chrom, word, person, bit_or(b1) as h1, bit_or(b2) as h2 from (select * from bits union all select * from ends) group by 1, 2, 3")
def mdl_14(s, d):
    """Haplotypes of every person as words of 63 sites."""
    calls = _snp_calls(s, d)
    return fm.haplotype_words(calls, fm.numbered_sites(calls)).select("chrom", "word", "person", "h1", "h2")


@query("mdl_13", f"with {_SITES}, {_GENOTYPES}, {_TRIOS}, {_NEAR}, two as (select locus, child, {_best('m')} as m, {_best('f')} as f from near), ok as (select *, m[1].d <= 10 and m[2].d >= 100 and f[1].d <= 10 and f[2].d >= 100 and (m[1].k < 2) <> (f[1].k < 2) as fits from two) select locus, child, case when fits then m[1].k end as maternal, case when fits then f[1].k end as paternal from ok")
def mdl_13(s, d):
    """Which haplotypes of their parents children have near every locus, by SNPs within 500,000 bases."""
    return _inherited(s, d).select("locus", "child", "maternal", "paternal")


def _scanned(s, d):
    at = F.array_sort(F.collect_list(F.struct("gt_a", "gt_b", (F.col("lp") / math.log(10)).alias("x"))))
    gl = _posteriors(s, d).groupBy("locus", "sample").agg(F.transform(at, lambda x: x["x"]).alias("gl"))
    freq = F.array(*[F.lit(-math.log10(3))] * 3)
    people = gl.select("locus", (F.substring("sample", 2, 9).cast("long") + 1).alias("person"), "gl", freq.alias("log_freq"))
    return fm.scan(_members(s), _inherited(s, d), people)


@query("mdl_15")
def mdl_15(s, d):
    """Likelihoods of no mutation and of one in each child, at loci where inheritance is known."""
    rounded = lambda c: F.transform(c, lambda x: F.round(x, 6)).alias(c)
    return _scanned(s, d).select("locus", "family", F.round("no_mutation", 6).alias("no_mutation"), F.round("any_mutation", 6).alias("any_mutation"), rounded("de_novo"), rounded("other"))


@query("snk_06")
def snk_06(s, d):
    """VCF lines of all loci with the family's likelihoods to three decimals, a dot where there are none."""
    loci = pj.regions(s, d).select("locus", "chrom", "start", "stop", "period")
    own = loci.join(_scanned(s, d), "locus", "left")
    info = F.concat(F.lit("BPDIFFS=2,4;START="), F.col("start") + 1, F.lit(";END="), "stop", F.lit(";PERIOD="), "period")
    line = F.concat_ws("\t", "chrom", (F.col("start") + 1).cast("string"), F.concat(F.lit("STR"), "locus"), F.lit("."), F.lit("."), F.lit("."), F.lit("."), info, F.lit("CHILDREN:NOMUT:ANYMUT:DENOVO:OTHER"), fm.family_call())
    return own.select("locus", line.alias("line"))
