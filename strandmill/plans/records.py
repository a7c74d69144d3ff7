"""Queries of read operators, ranges, runs and output records, most with their SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cigars as cg
from ..functions import genetics as g
from ..operators import filters as flt
from ..operators import columns, joins, ranges
from ..operators import reads as rd
from ..sources import projection as pj
from ..sources import vcf_index
from ..sources.shared import fresh, written
from .relational import _DISTS, _distances, query


def _alns(s, d):
    return pj.alignments(s, d)


@query("flt_03", "select rid from (select *, rname % 16 as flag from alns) where flag & 4 = 0 and pos <> 0 and cigar <> '' and length(bases) > 0")
def flt_03(s, d):
    r = _alns(s, d)
    return r.where(flt.is_placed((F.col("rname") % 16).cast("int"), F.col("pos"), F.col("cigar"), F.length("bases"))).select("rid")


@query("flt_04", "select rid from alns where not (regexp_matches(cigar, '^[0-9]+H') or cigar like '%H')")
def flt_04(s, d):
    return _alns(s, d).where(~flt.has_hard_clip(F.col("cigar"))).select("rid")


_ENDS = r"ends as (select *, length(regexp_extract(quals, '^[!-4]*')) as l, length(regexp_extract(regexp_replace(quals, '^[!-4]*', ''), '[!-4]*$')) as r from alns)"


@query("scl_02", f"with {_ENDS} select rid, l as trim_left, r as trim_right, substr(bases, l + 1, length(bases) - l - r) as bases from ends")
def scl_02(s, d):
    left, right = rd.low_quality_ends(F.col("quals"))
    r = _alns(s, d).withColumn("l", left).withColumn("r", right)
    return r.select("rid", F.col("l").cast("long").alias("trim_left"), F.col("r").cast("long").alias("trim_right"), F.expr("substring(bases, l + 1, length(bases) - l - r)").alias("bases"))


@query("flt_05", f"with {_ENDS} select rid from ends where not (length(bases) - l - r < length(bases) / 2.0)")
def flt_05(s, d):
    left, right = rd.low_quality_ends(F.col("quals"))
    n = F.length("bases")
    return _alns(s, d).where(~flt.trimmed_too_much(n, n - left - right)).select("rid")


@query("flt_10", "select rid from alns where try_cast(regexp_extract(cigar, '^([0-9]+)[M=X]', 1) as int) >= 10 and try_cast(regexp_extract(cigar, '([0-9]+)[M=X]$', 1) as int) >= 10 and left(bases, 10) = substr(ref, pos - ref_start + 1, 10) and right(bases, 10) = substr(ref, end_pos - ref_start - 9, 10)")
def flt_10(s, d):
    ok = rd.ends_match(*(F.col(c) for c in ("cigar", "bases", "pos", "end_pos", "ref", "ref_start")))
    return _alns(s, d).where(ok).select("rid")


_SUM = "list_sum([cast(x as bigint) for x in regexp_extract_all({0}, '([0-9]+)[M=X]', 1)])"


@query("flt_11", f"with c as (select rid, cigar, regexp_matches(cigar, '[ID]') as gap, regexp_extract(cigar, '^((?:[0-9]+[^ID0-9])*)[0-9]+[ID]', 1) as a, regexp_extract(cigar, '[0-9]+[ID]((?:[0-9]+[^ID0-9])*)$', 1) as b from alns) select rid, cast(case when gap then coalesce({_SUM.format('a')}, 0) else -1 end as bigint) as before, cast(case when gap then coalesce({_SUM.format('b')}, 0) else -1 end as bigint) as behind from c where not gap or (coalesce({_SUM.format('a')}, 0) >= 7 and coalesce({_SUM.format('b')}, 0) >= 7)")
def flt_11(s, d):
    before, behind = rd.before_indel(F.col("cigar"))
    r = _alns(s, d).select("rid", before.cast("long").alias("before"), behind.cast("long").alias("behind"))
    far = lambda c: (F.col(c) == -1) | (F.col(c) >= rd.END_TO_INDEL)
    return r.where(far("before") & far("behind"))


@query("scl_08", "select rid, regexp_matches(cigar, '^[0-9]+S') as starts_soft, cigar like '%S' as ends_soft, regexp_matches(cigar, '^[0-9]+H') as starts_hard, cigar like '%H' as ends_hard, regexp_matches(cigar, '^([0-9]+[M=])+$') as matches from alns")
def scl_08(s, d):
    return _alns(s, d).select("rid", *(c.alias(n) for n, c in rd.clips(F.col("cigar")).items()))


@query("scl_10", "select rid, case when cigar like '%S' then left(bases, length(bases) - 3) else bases end as bases, pos, end_pos from alns")
def scl_10(s, d):
    return _alns(s, d).select("rid", rd.unclipped_bases(F.col("cigar"), F.col("bases")).alias("bases"), "pos", "end_pos")


_REASON = "case when length(bases) - l - r < length(bases) / 2.0 then 'LOW_BASE_QUALS' when regexp_matches(cigar, '^[0-9]+H') or cigar like '%H' then 'HARD_CLIPPED' else 'PASS' end"


@query("snk_04", f"with {_ENDS} select rid, rid || chr(9) || '0' || chr(9) || chrom || chr(9) || (pos + 1) || chr(9) || '60' || chr(9) || case when cigar = '' then '*' else cigar end || chr(9) || '*' || chr(9) || '0' || chr(9) || '0' || chr(9) || bases || chr(9) || quals || chr(9) || 'FT:Z:' || {_REASON} as line from ends")
def snk_04(s, d):
    left, right = rd.low_quality_ends(F.col("quals"))
    n = F.length("bases")
    rules = {"LOW_BASE_QUALS": flt.trimmed_too_much(n, n - left - right), "HARD_CLIPPED": flt.has_hard_clip(F.col("cigar"))}
    reason = F.coalesce(flt.first_failing(rules), F.lit("PASS"))
    return _alns(s, d).select("rid", rd.tagged_sam({"name": F.col("rid")} | {c: F.col(c) for c in ("chrom", "pos", "cigar", "bases", "quals")}, reason).alias("line"))


def _edited(s, d, part, *names):
    """The part of `edited` of reads on their locus; every seventh is on the reverse strand."""
    r = pj.alignments_on_loci(s, d)
    columns = {c: F.col(c).cast("int") for c in ("mate", "pos", "ref_start", "start", "stop")} | {"reverse": F.col("rname") % 7 == 0}
    return rd.edited(r.select(*names, *(columns.get(c, F.col(c)).alias(c) for c in rd.NEEDS[part].split())), part)


@query("scl_01")
def scl_01(s, d):
    return _edited(s, d, "near", "rid").select("rid", "near_pos", "near_bases")


@query("scl_03")
def scl_03(s, d):
    return _edited(s, d, "low", "rid").select("rid", "low_pos", "low_cigar", "low_bases")


@query("scl_04")
def scl_04(s, d):
    return _edited(s, d, "adapter", "rid").select("rid", "adapter_at", "adapter_cigar", "adapter_bases")


#: Of every read its CIGAR's elements with places: op, n, at (first place), til (behind the last), seen (bases before).
_EL = r"list_transform(regexp_extract_all(cigar, '\d+[MIDNSHP=X]'), lambda x: {'op': right(x, 1), 'n': cast(left(x, length(x) - 1) as bigint)})"
_SUM = "coalesce(list_sum(list_transform(el[1:k - 1], lambda e: case when e.op in ({ops}) then e.n else 0 end)), 0)"
_ON_REF, _ON_READ = _SUM.format(ops="'M', 'D', 'N', '=', 'X'"), _SUM.format(ops="'M', 'I', 'S', '=', 'X'")
_WALK = (
    f"els as (select *, {_EL} as el from alns where cigar <> ''), placed as (select *, list_transform(range(1, len(el) + 1), lambda k: {{'op': el[k].op, 'n': el[k].n, 'at': pos + {_ON_REF}, 'seen': {_ON_READ}}}) as w0 from els), "
    "walk as (select *, list_transform(w0, lambda s: {'op': s.op, 'n': s.n, 'at': s.at, 'til': s.at + case when s.op in ('M', 'D', 'N', '=', 'X') then s.n else 0 end, 'seen': s.seen}) as w from placed), "
    "near as (select w.*, start, stop from walk w join regions using (locus))"
)
_LEFT = "list_max(list_transform(list_filter(w, lambda s: s.op in ('M', '=', 'X') and (s.at < start or (s.at = pos and pos = start))), lambda s: s.til))"
_RIGHT = "list_min(list_transform(list_filter(w, lambda s: s.op in ('M', '=', 'X') and s.til > stop), lambda s: s.at))"


def _walked(s, d):
    r = _alns(s, d).where("cigar <> ''").select("rid", "locus", "sample", "chrom", "pos", "end_pos", "bases", "quals", cg.steps(F.col("cigar"), F.col("pos")).alias("walk"))
    return r


def _on_loci(s, d):
    return pj.alignments_on_loci(s, d).where("cigar <> ''").select("rid", "pos", "end_pos", "bases", "start", "stop", cg.steps(F.col("cigar"), F.col("pos")).alias("walk"))


@query("scl_09", f"with {_WALK}, ends as (select rid, w, pos, end_pos, start, stop, {_LEFT} as a, {_RIGHT} as b from near) select rid, case when start >= pos and stop < end_pos and a is not null and b is not null then cast(coalesce(list_sum(list_transform(list_filter(w, lambda s: s.op in ('I', 'D') and s.at >= a and s.til <= b), lambda s: case when s.op = 'I' then s.n else -s.n end)), 0) as int) end as length_change from ends")
def scl_09(s, d):
    """Inserted less deleted bases of reads within their locus."""
    return _on_loci(s, d).select("rid", cg.length_change(F.col("walk"), F.col("pos"), F.col("end_pos"), F.col("start"), F.col("stop")).alias("length_change"))


@query("scl_16", f"with {_WALK} select rid, case when pos <= start and end_pos >= stop then array_to_string(list_transform(w, lambda s: case when s.op in ('M', '=', 'X') and greatest(s.at, start) < least(s.til, stop) then substr(bases, cast(s.seen + greatest(s.at, start) - s.at + 1 as bigint), cast(least(s.til, stop) - greatest(s.at, start) as bigint)) when s.op = 'I' and s.at > start and s.at <= stop then substr(bases, cast(s.seen + 1 as bigint), s.n) else '' end), '') end as inside from near")
def scl_16(s, d):
    """Bases of reads on the part of their locus from its start on."""
    return _on_loci(s, d).select("rid", cg.sequence_between(F.col("walk"), F.col("bases"), F.col("pos"), F.col("end_pos"), F.col("start"), F.col("stop")).alias("inside"))


_LEFT_BY = {
    "D": "list_position([substr(ref, cast(pos - ref_start + m1 - t + 1 as bigint), 1) <> substr(ref, cast(pos - ref_start + m1 + n - t + 1 as bigint), 1) for t in range(1, cast(m1 as bigint))], true)",
    "I": "list_position([substr(bases, cast(m1 - t + 1 as bigint), 1) <> substr(bases, cast(m1 + n - t + 1 as bigint), 1) for t in range(1, cast(m1 as bigint))], true)",
}


@query(
    "scl_15",
    rf"""with parts as (select rid, cigar, pos, ref_start, ref, bases, regexp_extract(cigar, '^(\d+H)?(\d+)M(\d+)([ID])(\d+)M(.*)$', ['head', 'm1', 'n', 'op', 'm2', 'tail']) as p from alns where cigar <> ''),
    typed as (select rid, cigar, pos, ref_start, ref, bases, p.head as head, p.op as op, p.tail as tail, try_cast(p.m1 as bigint) as m1, try_cast(p.n as bigint) as n, try_cast(p.m2 as bigint) as m2 from parts),
    tried as (select *, case when op = 'D' then {_LEFT_BY['D']} when op = 'I' then {_LEFT_BY['I']} end as first from typed),
    moved as (select *, case when op in ('I', 'D') then coalesce(first - 1, m1 - 1) else 0 end as k from tried)
    select rid, case when k > 0 then head || (m1 - k) || 'M' || n || op || (m2 + k) || 'M' || tail else cigar end as aligned from moved""",
)
def scl_15(s, d):
    """CIGARs of all reads with indels as far left as they go."""
    aligned = cg.left_aligned(F.col("cigar"), F.col("bases"), F.col("pos"), F.col("ref"), F.col("ref_start"))
    return _alns(s, d).where("cigar <> ''").select("rid", aligned.alias("aligned"))


_GAPS = "ins as (select locus, s.at as place, max(s.n) as size from (select locus, unnest(w) as s from walk) where s.op = 'I' group by 1, 2), gaps as (select locus, map_from_entries(list({'k': place, 'v': size})) as gaps from ins group by 1), bounds as (select locus, min(pos) as first, max(end_pos) as last from walk group by 1), laid as (select w.*, first, last, gaps from walk w join bounds using (locus) left join gaps using (locus))"
_GAP = "coalesce(gaps[{p}], 0)"
_OWN = "list_filter(w, lambda s: s.op = 'I' and s.at = {p})[1]"
_HELD = f"coalesce(substr(bases, cast(({_OWN}).seen + 1 as bigint), ({_OWN}).n), '')"
_BASE_AT = "coalesce(substr(bases, cast((list_filter(w, lambda s: s.op in ('M', '=', 'X') and s.at <= p and s.til > p)[1]).seen + p - (list_filter(w, lambda s: s.op in ('M', '=', 'X') and s.at <= p and s.til > p)[1]).at + 1 as bigint), 1), '-')"
_BLANK = f"repeat(' ', cast({_GAP.format(p='p')} + 1 as bigint))"
_PLACE = f"case when p > pos or {_OWN.format(p='p')} is not null then rpad({_HELD.format(p='p')}, cast({_GAP.format(p='p')} as int), '-') else repeat(' ', cast({_GAP.format(p='p')} as bigint)) end || {_BASE_AT}"
_BEHIND = f"case when {_OWN.format(p='end_pos')} is not null then rpad({_HELD.format(p='end_pos')}, cast({_GAP.format(p='end_pos')} as int), '-') else repeat(' ', cast({_GAP.format(p='end_pos')} as bigint)) end"
_ROW = f"array_to_string([{_BLANK} for p in range(first, pos)], '') || array_to_string([{_PLACE} for p in range(pos, end_pos)], '') || {_BEHIND} || case when end_pos < last then ' ' || array_to_string([{_BLANK} for p in range(end_pos + 1, last)], '') || repeat(' ', cast({_GAP.format(p='last')} as bigint)) else '' end"


@query("scl_25", f"with {_WALK}, {_GAPS} select rid, locus, {_ROW} as row from laid")
def scl_25(s, d):
    """All reads of every locus in fixed columns."""
    reads = _alns(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "locus")
    return columns.overlaid(reads).select("rid", "locus", "row")


def _shown(s, d):
    """Every second read of every locus, and the reference in the columns that these reads need."""
    k = F.row_number().over(Window.partitionBy("locus").orderBy("pos", "rid"))
    reads = _alns(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "locus").where("cigar <> ''").withColumn("k", k).where("k % 2 = 0")
    # Rows, layout and reference read them: they are made once.
    reads = written(reads.select("rid", "locus", "chrom", "sample", "pos", "end_pos", "cigar", "bases"), "shown")
    laid = columns.layout(reads).withColumn("ref", pj.reference("first", "cast(last - first as int)"))
    reference = columns.reference_row(F.col("ref"), F.col("first"), F.col("first"), F.col("last"), F.col("gaps"))
    return reads, laid.select("locus", reference.alias("reference"))


@query("snk_12")
def snk_12(s, d):
    """The reference's row of every locus, in the columns of the reads shown."""
    return _shown(s, d)[1]


@query("snk_08")
def snk_08(s, d):
    """Lines of alignment rows as table cells: contig, first and last place, sample, read, cells."""
    reads, reference = _shown(s, d)
    laid = columns.overlaid(reads, "chrom", "sample").join(reference, "locus")
    return laid.select("chrom", F.col("first").alias("start"), F.col("last").alias("stop"), "sample", "rid", columns.html_row(F.col("row"), F.col("reference")).alias("cells"))


_SEEN = "seen as (select w.rid, w.locus, w.sample, s.pos as snp_pos, list_filter(w.w, lambda x: x.op in ('M', '=', 'X') and x.at <= s.pos and x.til > s.pos)[1] as m, w.bases, w.quals from walk w join het_snps s on s.sample = w.sample and s.chrom = w.chrom and s.pos between w.pos and w.end_pos), based as (select rid, locus, sample, snp_pos, coalesce(substr(bases, cast(m.seen + snp_pos - m.at + 1 as bigint), 1), '-') as base, coalesce(substr(quals, cast(m.seen + snp_pos - m.at + 1 as bigint), 1), '-') as qual from seen)"


def _snp_bases(s, d):
    hit = joins.snps_in_reads(_walked(s, d), pj.het_snps(s, d))
    base, qual = (cg.base_at(F.col("walk"), F.col(c), F.col("snp_pos")) for c in ("bases", "quals"))
    return hit.select("rid", "locus", "sample", "chrom", "snp_pos", base.alias("base"), qual.alias("qual"))


@query("scl_22", f"with {_WALK}, {_SEEN} select rid, snp_pos, base, qual from based")
def scl_22(s, d):
    """Bases and qualities of reads at the SNPs of their sample."""
    return _snp_bases(s, d).select("rid", "snp_pos", "base", "qual")


@query("flt_09")
def flt_09(s, d):
    return _edited(s, d, "ends", "rid").where("largest_ends").select("rid")


@query("agg_27")
def agg_27(s, d):
    """Adapters by locus: reads, reads trimmed, bases cut."""
    cut = F.col("adapter_at") > 0
    return _edited(s, d, "adapter", "locus").groupBy("locus").agg(F.count("*").alias("total"), F.count_if(cut).alias("trimmed"), F.coalesce(F.sum("adapter_at"), F.lit(0)).alias("bases"))


@query("ord_06")
def ord_06(s, d):
    return rd.flank_paths(_alns(s, d).select("locus", "bases", F.substring("ref", 1, 60).alias("ref")).where("length(bases) > 15"))


@query("join_04", "select l_orderkey || '-' || l_linenumber as read_name, 's' || (s_suppkey % 5) as rg_sample, n_name as rg_library from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey")
def join_04(s, d):
    """A read's sample and library by its read group: group -> (sample, library)."""
    names = pj.table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("rg_library"))
    groups = pj.table(s, d, "supplier").join(names, "s_nationkey").select(F.col("s_suppkey").alias("rg"), F.concat(F.lit("s"), F.col("s_suppkey") % 5).alias("rg_sample"), "rg_library")
    r = pj.table(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("read_name"), F.col("l_suppkey").alias("rg"))
    return r.join(groups, "rg").select("read_name", "rg_sample", "rg_library")


_RUN = """n as (select r.locus, stop - start > 40 as too_long, coalesce(x.n, 0) as n, coalesce(x.low, 0) as low from regions r
  left join (select locus, count(*) as n, count(*) filter (qual < 5) as low from reads group by 1) x using (locus))"""


@query("agg_28", f"with {_RUN} select 'loci' as counter, count(*) as value from n union all select 'too long', count(*) from n where too_long union all select 'too few reads', count(*) from n where not too_long and n < 25 union all select 'genotyped', count(*) from n where not too_long and n >= 25 union all select 'reads', cast(sum(n) as bigint) from n union all select 'low quality reads', cast(sum(low) as bigint) from n union all select 'reads used', cast(coalesce(sum(n - low) filter (not too_long and n >= 25), 0) as bigint) from n")
def agg_28(s, d):
    """Counters of a run: loci by what became of them, reads by why they went."""
    n = pj.reads(s, d).groupBy("locus").agg(F.count("*").alias("n"), F.count_if(F.col("qual") < 5).alias("low"))
    r = pj.regions(s, d).join(n, "locus", "left").select((F.col("stop") - F.col("start") > 40).alias("long"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("low", F.lit(0)).alias("low"))
    used = ~F.col("long") & (F.col("n") >= 25)
    counters = {
        "loci": F.count("*"),
        "too long": F.count_if("long"),
        "too few reads": F.count_if(~F.col("long") & (F.col("n") < 25)),
        "genotyped": F.count_if(used),
        "reads": F.sum("n"),
        "low quality reads": F.sum("low"),
        "reads used": F.coalesce(F.sum(F.when(used, F.col("n") - F.col("low"))), F.lit(0)),
    }
    row = r.agg(*(c.cast("long").alias(n) for n, c in counters.items()))
    return row.unpivot([], list(counters), "counter", "value")


@query("win_05", "select r.locus, count(s.pos) as near from regions r left join het_snps s on s.chrom = r.chrom and s.pos between r.start - 500000 and r.start + 500000 group by 1")
def win_05(s, d):
    return ranges.count_within(pj.regions(s, d).select("locus", "chrom", "start"), pj.het_snps(s, d), ["chrom"], "locus", "start", "pos", 500_000).select("locus", F.col("n").alias("near"))


@query("join_10", "select r.locus, s.sample, count(*) as n_snps from regions r join het_snps s on s.chrom = r.chrom and s.pos between r.start - 500000 and r.start + 500000 group by 1, 2")
def join_10(s, d):
    """Phased SNPs of each sample within reach of a locus, for those that have any."""
    snps = pj.het_snps(s, d)
    loci = pj.regions(s, d).select("locus", "chrom", "start").crossJoin(F.broadcast(snps.select("sample").distinct()))
    return ranges.count_within(loci, snps, ["sample", "chrom"], "locus", "start", "pos", 500_000).where("n > 0").select("locus", "sample", F.col("n").alias("n_snps"))


@query("win_07", "select locus, chrom, start from (select *, lag(chrom) over (order by chrom, start, stop, locus) as before from regions) where before is null or before <> chrom")
def win_07(s, d):
    """Loci at which the sorted list changes its chromosome: the first of each, by one aggregation."""
    first = pj.regions(s, d).groupBy("chrom").agg(F.min(F.struct("start", "stop", "locus")).alias("f"))
    return first.select("f.locus", "chrom", "f.start")


@query("ord_01", "select locus, row_number() over (partition by chrom order by start, stop, locus) as ord from regions")
def ord_01(s, d):
    r = pj.regions(s, d).select("locus", "chrom", "start", "stop")
    return ranges.rank_by_position(r, ["chrom"], "start", ["stop", "locus"]).select("locus", F.col("ord").cast("long").alias("ord"))


@query("ord_04", "select rid, row_number() over (partition by chrom order by pos, library, rid) as ord from reads")
def ord_04(s, d):
    """Reads of all files (libraries) by position, on a tie in the order of the files."""
    return ranges.rank_by_position(pj.reads(s, d).select("rid", "chrom", "pos", "library"), ["chrom"], "pos", ["library", "rid"]).select("rid", F.col("ord").cast("long").alias("ord"))


@query("mth_09", "with m as (select sample, rname, min(hp) as low, max(hp) as high, count(hp) as tagged, count(*) as n from alns group by 1, 2) select rid, cast(case when low = high and tagged = n then case when low = 1 then -0.01 else -1000 end else 0 end as double) as p1, cast(case when low = high and tagged = n then case when low = 2 then -0.01 else -1000 end else 0 end as double) as p2 from alns join m using (sample, rname)")
def mth_09(s, d):
    return rd.tagged_phases(_alns(s, d))


#: A SNP's alleles are the reference's base and its complement; the first haplotype has the reference's at even places.
_REF_BASE = pj._BASE.format("//").replace("p +", "snp_pos +")
_LEAN = f"case when base = {_REF_BASE} then case when snp_pos % 2 = 0 then 1 else -1 end when base = translate({_REF_BASE}, 'ACGT', 'TGCA') then case when snp_pos % 2 = 0 then -1 else 1 end else 0 end"


@query("prj_04", f"with {_WALK}, {_SEEN}, p as (select rid, sum({_LEAN}) as lean from based group by 1) select r.locus, r.sample, count(*) filter (lean > 0) || '|' || count(*) filter (lean < 0) as psnp, count(*) filter (lean <> 0) as dsnp from reads r left join p using (rid) group by 1, 2")
def prj_04(s, d):
    """Reads whose bases at SNPs give them to the first and the second haplotype (PSNP), and that they tell apart (DSNP)."""
    ref = F.expr(pj._BASE.format("div").replace("p +", "snp_pos +"))
    first = F.when(F.col("snp_pos") % 2 == 0, 1).otherwise(-1)
    lean = F.sum(F.when(F.col("base") == ref, first).when(F.col("base") == F.translate(ref, "ACGT", "TGCA"), -first).otherwise(0))
    # Reads meet the places of SNPs before they have bases, each in the bin it begins in; equal rids begin in one place.
    met = joins.snps_of_reads(pj.reads(s, d).withColumn("end_pos", pj.aligned_end()), pj.het_snps(s, d))
    r = pj.alignments_of(met, "_bin", "snps")
    over = F.posexplode_outer(F.when(F.col("cigar") != "", F.col("snps"))).alias("k", "snp_pos")
    hit = r.select("rid", "locus", "sample", "chrom", "_bin", "pos", "cigar", "bases", over)
    based = hit.withColumn("base", F.when(F.col("snp_pos").isNotNull(), cg.base_at(cg.steps(F.col("cigar"), F.col("pos")), F.col("bases"), F.col("snp_pos"))))
    each = based.groupBy("sample", "chrom", "_bin", "rid", "locus").agg(lean.alias("lean"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("n"))
    t = each.groupBy("locus", "sample").agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("a", F.col("lean") > 0), ("b", F.col("lean") < 0))))
    return t.select("locus", "sample", F.concat_ws("|", "a", "b").alias("psnp"), (F.col("a") + F.col("b")).alias("dsnp"))


_INFO = "'START=' || (locus * 40 + 1) || ';END=' || (locus * 40 + 30) || ';INFRAME_PGEOM=0.9;INFRAME_DOWN=' || (sum(dstutter) % 7 / 100.0) || ';INFRAME_UP=' || (sum(dp) % 5 / 50.0) || ';OUTFRAME_PGEOM=0.8;OUTFRAME_DOWN=0.005;OUTFRAME_UP=0.02'"
_KEYS = ("INFRAME_PGEOM", "INFRAME_DOWN", "INFRAME_UP", "OUTFRAME_PGEOM", "OUTFRAME_DOWN", "OUTFRAME_UP")


def _value(key: str) -> str:
    x = f"cast(regexp_extract(info, '(?:^|;){key}=([^;]*)', 1) as double)"
    return f"{x if key.endswith('PGEOM') else f'greatest({x}, 0.01)'} as {key.lower()}"


@query("prj_13", f"with v as (select locus, {_INFO} as info from calls group by 1) select locus, cast(regexp_extract(info, '(?:^|;)START=([^;]*)', 1) as bigint) as start, cast(regexp_extract(info, '(?:^|;)END=([^;]*)', 1) as bigint) as stop, {', '.join(map(_value, _KEYS))} from v")
def prj_13(s, d):
    """Stutter models out of the INFO column of a VCF file; up and down are 0.01 at least."""
    down, up = (F.sum("dstutter") % 7 / 100).cast("string"), (F.sum("dp") % 5 / 50).cast("string")
    info = F.concat(F.lit("START="), F.col("locus") * 40 + 1, F.lit(";END="), F.col("locus") * 40 + 30, F.lit(";INFRAME_PGEOM=0.9;INFRAME_DOWN="), "down", F.lit(";INFRAME_UP="), "up", F.lit(";OUTFRAME_PGEOM=0.8;OUTFRAME_DOWN=0.005;OUTFRAME_UP=0.02"))
    v = pj.calls(s, d).groupBy("locus").agg(down.alias("down"), up.alias("up")).withColumn("pos", F.col("locus") * 40 + 1)
    line = F.concat_ws("\t", F.lit("chr1"), "pos", F.concat(F.lit("L"), "locus"), F.lit("A"), F.lit("."), F.lit("."), F.lit("."), info)
    path = fresh(s, "models") + ".vcf.gz"
    vcf_index.write_vcf(v.select(F.lit("chr1").alias("chrom"), "pos", line.alias("value")), path, ["##fileformat=VCFv4.2", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO".split())])
    at = lambda k, kind: F.col("info")[k].cast(kind)
    back = vcf_index.read_vcf(s, path)
    return back.select(F.substring("id", 2, 30).cast("long").alias("locus"), at("START", "long").alias("start"), at("END", "long").alias("stop"), *((at(k, "double") if k.endswith("PGEOM") else F.greatest(at(k, "double"), F.lit(0.01))).alias(k.lower()) for k in _KEYS))


@query("snk_07", f"with {_DISTS} select 0 as ord, '#PAIR' || chr(9) || 'D11' || chr(9) || 'D12' || chr(9) || 'D21' || chr(9) || 'D22' || chr(9) || 'FILTER' as line union all select pair + 1, pair || chr(9) || d11 || chr(9) || d12 || chr(9) || d21 || chr(9) || d22 || chr(9) || case when least(d11, d12, d21, d22) <= 2500 then 'PASS' else 'FAIL' end from dist")
def snk_07(s, d):
    """The lines of the table of phasing distances, a header first."""
    t = _distances(s, d)
    ok = F.when(F.least("d11", "d12", "d21", "d22") <= 2500, "PASS").otherwise("FAIL")
    lines = t.select((F.col("pair") + 1).cast("long").alias("ord"), F.concat_ws("\t", "pair", "d11", "d12", "d21", "d22", ok).alias("line"))
    head = s.range(1).select(F.lit(0).cast("long").alias("ord"), F.lit("\t".join(("#PAIR", "D11", "D12", "D21", "D22", "FILTER"))).alias("line"))
    return head.union(lines)


@query("snk_09", "select locus, chr(9) as sep, chrom || chr(9) || (start + 1) || chr(9) || coalesce(max(gt_a || '|' || gt_b) filter (sample = 's1'), '.') || chr(9) || coalesce(max(gt_a || '|' || gt_b) filter (sample = 's2'), '.') as line from regions join calls using (locus) group by locus, chrom, start")
def snk_09(s, d):
    """Records cut down to the columns of the samples kept; a sample without a call has a dot."""
    c = pj.calls(s, d).groupBy("locus").pivot("sample", ["s1", "s2"]).agg(F.max(F.concat_ws("|", "gt_a", "gt_b")))
    r = pj.regions(s, d).join(c, "locus")
    cells = [F.coalesce(x, F.lit(".")) for x in ("s1", "s2")]
    return r.select("locus", F.lit("\t").alias("sep"), F.concat_ws("\t", "chrom", F.col("start") + 1, *cells).alias("line"))


@query("snk_14", "select rid from (select rid, sample, row_number() over (partition by locus order by pos, rid) as k from reads where locus * 40 in (400, 1200, 4000) and sample in ('s1', 'ALL')) where k % 2 = 0")
def snk_14(s, d):
    """Rows to view: loci of these very starts, of one sample (or of all), every second one."""
    r = pj.reads(s, d).where((F.col("locus") * 40).isin(400, 1200, 4000) & F.col("sample").isin("s1", "ALL"))
    k = F.row_number().over(Window.partitionBy("locus").orderBy("pos", "rid"))
    return r.select("rid", k.alias("k")).where("k % 2 = 0").select("rid")


@query("win_04", "select doc_id, k, run[1] as base, cast(length(run) as bigint) as n, cast(sum(length(run)) over (partition by doc_id order by k) - length(run) as bigint) as start from (select doc_id, unnest(runs) as run, unnest(range(1, len(runs) + 1)) as k from (select doc_id, regexp_extract_all(seq, 'A+|C+|G+|T+') as runs from seqs))")
def win_04(s, d):
    """Homopolymers of every sequence: a base at start + i has i equal ones to its left and n - 1 - i to its right."""
    return columns.homopolymers(pj.sequences(s, d).select("doc_id", "seq"))


# Chances of an insertion or deletion after a homopolymer of 1 to 10 bases; beyond, they grow in steps.
GAP_CHANCES, GAP_STEP, LONGEST = (2.9e-5, 2.9e-5, 2.9e-5, 2.9e-5, 4.3e-5, 1.1e-4, 2.4e-4, 5.7e-4, 1.0e-3, 1.4e-3), 4.3e-4, 15
_CHANCE = f"case when n <= 10 then list_extract([{', '.join(map(repr, GAP_CHANCES))}], cast(n as int)) else 0.0014 + 0.00043 * (n - 10) end"


@query("mth_10", f"select n, round(ln({_CHANCE}), 9) as to_gap, round(ln(1 - 2 * ({_CHANCE})), 9) as to_match, count(*) as runs from (select least(15, length(run)) as n from (select unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) as run from seqs)) group by 1")
def mth_10(s, d):
    """Log chances of a gap and of none by the length of the homopolymer before, with how many runs have it."""
    runs = pj.sequences(s, d).select(F.explode(F.regexp_extract_all("seq", F.lit("A+|C+|G+|T+"), F.lit(0))).alias("run"))
    n = runs.groupBy(F.least(F.lit(LONGEST), F.length("run")).cast("long").alias("n")).agg(F.count("*").alias("runs"))
    chance = F.when(F.col("n") <= 10, F.element_at(F.array(*map(F.lit, GAP_CHANCES)), F.col("n").cast("int"))).otherwise(GAP_CHANCES[-1] + GAP_STEP * (F.col("n") - 10))
    return n.select("n", F.round(F.log(chance), 9).alias("to_gap"), F.round(F.log(1 - 2 * chance), 9).alias("to_match"), "runs")


@query("agg_06", "select locus, round(ln(sum(exp(bp_diff / 3.0))), 6) as lse from reads group by 1")
def agg_06(s, d):
    """Log-sum-exp in one pass: equal values are counted first, so a locus' sum has few terms whatever its depth."""
    n = pj.reads(s, d).groupBy("locus", "bp_diff").agg(F.count("*").alias("n"))
    top = n.groupBy("locus").agg(F.max("bp_diff").alias("top"), F.collect_list(F.struct("bp_diff", "n")).alias("terms"))
    total = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["n"] * F.exp((t["bp_diff"] - F.col("top")) / 3.0))
    return top.select("locus", F.round(F.col("top") / 3.0 + F.log(total), 6).alias("lse"))


@query("agg_07", "select locus, round(top + ln(sum(exp(x - top))), 6) as lse from (select locus, bp_diff / 1.5 as x, max(bp_diff / 1.5) over (partition by locus) as top from reads) where x - top > ln(0.001) group by locus, top")
def agg_07(s, d):
    """Log-sum-exp that leaves out terms below a thousandth of the largest."""
    n = pj.reads(s, d).groupBy("locus", "bp_diff").agg(F.count("*").alias("n"))
    top = n.groupBy("locus").agg((F.max("bp_diff") / 1.5).alias("top"), F.collect_list(F.struct("bp_diff", "n")).alias("terms"))
    near = F.filter("terms", lambda t: t["bp_diff"] / 1.5 - F.col("top") > F.log(F.lit(0.001)))
    total = F.aggregate(near, F.lit(0.0), lambda acc, t: acc + t["n"] * F.exp(t["bp_diff"] / 1.5 - F.col("top")))
    return top.select("locus", F.round(F.col("top") + F.log(total), 6).alias("lse"))


@query("mth_02", "select locus, round(sum(ln(1 - pow(10, -least(41, greatest(1, qual)) / 10.0))), 6) as total from reads group by 1")
def mth_02(s, d):
    return pj.reads(s, d).groupBy("locus").agg(F.round(F.sum(g.ln_correct(F.col("qual"))), 6).alias("total"))
