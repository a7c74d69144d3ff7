"""Genotypes to a fixpoint: alleles that only stutter shows are added until no locus gains one, unused ones go again.

All loci are worked on at once. Equal reads of a sample are one row with their number, so a deep locus is spread by its
different sequences. A round scores the distinct sequences of the loci still active against their new alleles only;
scores are kept as tables, one a round with a row for each sequence of an active locus, and never made again. A locus without a new allele is finished: its genotypes
are kept, and later rounds do not read its rows. Rounds end when no locus is active.

Rows of pooled reads are dealt and sorted by (locus, sample) and go through numpy in Arrow batches: pairs of alleles
are never rows. What is held at once is the distinct sequences of one sample at one locus, with a score for each allele,
and the sums of its genotypes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import edits
from ..functions import genetics as g
from ..functions import kernels as k
from ..functions.cigars import texts
from ..sources.shared import discard, written
from . import aggregates as agg

#: Scores closer than this are equal.
NEAR = 1e-9


#: Numbers worked on together: sequences times pairs of alleles.
CELLS = 1 << 18
_SCORES = "array<struct<allele:bigint,size:int,lp:double>>"
_ARROW_SCORES = pa.list_(pa.struct([("allele", pa.int64()), ("size", pa.int32()), ("lp", pa.float64())]))


@dataclass(frozen=True)
class StutterScore:
    """ln likelihood of a sequence given an allele: stutter by the difference of lengths, errors by what is left of the
    edit distance."""

    model: dict[str, float]
    error: float

    def __call__(self, seq: Column, allele: Column, period: Column) -> Column:
        diff = F.length(seq) - F.length(allele)
        return g.log_stutter(diff, period, self.model) + (F.levenshtein(seq, allele) - F.abs(diff)) * math.log(self.error / 3)

    def many(self, seqs: list[str], alleles: list[str], which: np.ndarray, other: np.ndarray, period: np.ndarray) -> np.ndarray:
        """The same of seqs[which[i]] given alleles[other[i]] at a locus of period[i]."""
        sizes = [np.array([len(t) for t in x], np.int64) for x in (seqs, alleles)]
        diff = sizes[0][which] - sizes[1][other]
        return k.log_stutter(diff, period, self.model) + (edits.distances(seqs, alleles, which, other) - np.abs(diff)) * math.log(self.error / 3)


def stutter_score(model: dict[str, float], error: float = 1e-3) -> StutterScore:
    return StutterScore(model, error)


@dataclass
class Fixpoint:
    """genotypes (locus, sample, gt_a, gt_b, log_post, n), alleles (locus, allele, seq, round, kept, number: the place
    among those kept), loci given up for too many alleles, and the scores by round (locus, seq, allele, lp)."""

    genotypes: DataFrame
    alleles: DataFrame
    given_up: DataFrame
    scores: list[DataFrame] = field(default_factory=list)


def _many_scores(score: StutterScore) -> Callable[[Column, Column, Column], Column]:
    """Scores of each sequence given the alleles listed beside it, a batch at once."""

    @F.arrow_udf(_SCORES)
    def run(seq: pa.Array, new: pa.Array, period: pa.Array) -> pa.Array:
        sizes, flat = new.value_lengths().to_numpy(), new.flatten()
        listed = flat.field("aseq").dictionary_encode()
        alleles, other = listed.dictionary.to_pylist(), listed.indices.to_numpy()
        which = np.repeat(np.arange(len(seq)), sizes)
        lp = score.many(texts(seq), alleles, which, other, np.repeat(period.to_numpy(), sizes))
        size = np.array([len(t) for t in alleles], np.int32)[other]
        made = pa.StructArray.from_arrays([flat.field("allele").cast(pa.int64()), pa.array(size), pa.array(lp, pa.float64())], fields=list(_ARROW_SCORES.value_type))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), made)

    return run


def _scored(seqs: DataFrame, new: DataFrame, periods: DataFrame, score: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """(locus, seq, s): what seqs hold in s (nothing, if they have no such column) and the scores of the new alleles of
    their locus, in order of their numbers. A locus has few alleles, so they are gathered; its sequences are not.

    A score that has `many` works on batches, another one on columns."""
    listed = new.groupBy("locus").agg(F.array_sort(F.collect_list(F.struct("allele", "aseq"))).alias("new")).join(periods, "locus")
    if hasattr(score, "many"):
        own = _many_scores(score)(F.col("seq"), F.col("new"), F.col("period"))
    else:
        own = F.transform("new", lambda a: F.struct(a["allele"].alias("allele"), F.length(a["aseq"]).alias("size"), score(F.col("seq"), a["aseq"], F.col("period")).alias("lp")))
    return seqs.join(listed, "locus").select("locus", "seq", F.concat("s", own).alias("s") if "s" in seqs.columns else own.alias("s"))


def _spread(by_sequence: DataFrame) -> DataFrame:
    """(locus, seq, allele, lp)."""
    return by_sequence.select("locus", "seq", F.inline("s")).select("locus", "seq", "allele", "lp")


def _new_only(by_sequence: DataFrame, new: DataFrame) -> DataFrame:
    return _spread(by_sequence).join(new.select("locus", "allele"), ["locus", "allele"], "left_semi").select("locus", "seq", "allele", "lp")


def _kept(by_sequence: DataFrame, keep: DataFrame) -> DataFrame:
    """Scores of the alleles kept only; loci without any go."""
    own = keep.groupBy("locus").agg(F.collect_set("allele").alias("own"))
    return by_sequence.join(own, "locus").select("locus", "seq", F.filter("s", lambda x: F.array_contains("own", x["allele"])).alias("s"))


def _genotyped(pooled: DataFrame, by_sequence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best genotype of each sample, and each pooled sequence with the allele that it is given to, the reads of its
    sample (whole), and the allele that it shows without stutter (null if it shows none)."""
    parts = int(pooled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reads = pooled.join(by_sequence, ["locus", "seq"]).select("locus", "sample", "seq", "n", "s")
    dealt = reads.repartition(parts, "locus", "sample").sortWithinPartitions("locus", "sample")
    kinds = {f.name: f for f in reads.schema.fields}
    more = "allele bigint, step int, whole bigint, shown bigint, leads boolean, gt_a bigint, gt_b bigint, log_post double"
    schema = T.StructType([*(kinds[c] for c in ("locus", "sample", "seq", "n")), *T.StructType.fromDDL(more).fields])
    rows = written(dealt.mapInArrow(_genotypes_of, schema), "genotypes")
    best = rows.where("leads").select("locus", "sample", "gt_a", "gt_b", "log_post", F.col("whole").alias("n"))
    return best, rows.where("sample is not null").select("locus", "sample", "seq", "n", "allele", "step", "whole", "shown")


def _genotypes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of rows sorted by (locus, sample), each once it is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last group may go on; as long as it does, its rows are only kept.
        if held and _firsts(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch])).tolist() == [0]:
            held.append(batch)
            continue
        rows = pa.concat_batches([*held, batch])
        last = int(_firsts(rows)[-1])
        if last:
            yield _genotyped_rows(rows.slice(0, last))
        held = [rows.slice(last)]
    if held:
        yield _genotyped_rows(pa.concat_batches(held))


def _firsts(rows: pa.RecordBatch) -> np.ndarray:
    """Where groups of equal locus and sample begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in ("locus", "sample"):
        code = rows.column(c).dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(x, y) + np.log1p(np.exp(-np.abs(x - y))) - math.log(2)


def _likelihoods(lp: np.ndarray, n: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over the rows of each group, a column for each genotype."""
    step = max(1, CELLS // len(a))
    out = np.empty((len(starts), len(a)))
    ends, at = np.append(starts[1:], len(lp)), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, side="right")))
        low, high = starts[at], ends[to - 1]
        if high - low <= step:
            out[at:to] = np.add.reduceat(n[low:high, None] * _pair(lp[low:high, a], lp[low:high, b]), starts[at:to] - low, axis=0)
        else:  # one group, a part of its rows at once
            out[at] = sum(n[k : min(k + step, high)] @ _pair(lp[k : min(k + step, high)][:, a], lp[k : min(k + step, high)][:, b]) for k in range(low, high, step))
        at = to
    return out


def _genotyped_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
    firsts = _firsts(rows)
    group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, rows.num_rows)))
    scores, n = rows.column("s"), rows.column("n").to_numpy()
    sizes = scores.value_lengths().to_numpy()
    offsets = np.cumsum([0, *sizes])[:-1]
    flat = scores.flatten()
    number, size, lp = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("allele", "size", "lp"))
    long = np.array([len(t) for t in texts(rows.column("seq"))], np.int64)
    whole = np.add.reduceat(n, firsts)
    out = {c: np.zeros(rows.num_rows, np.int64) for c in ("allele", "step", "shown")}
    shows = np.zeros(rows.num_rows, bool)
    gt = {c: np.zeros(len(firsts), np.int64) for c in ("gt_a", "gt_b")}
    post = np.zeros(len(firsts))
    for count in np.unique(sizes[firsts]).tolist():
        own = np.flatnonzero(sizes[firsts] == count)
        some = np.flatnonzero(sizes[firsts][group] == count)
        starts = np.searchsorted(group[some], own)
        at = offsets[some][:, None] + np.arange(count)
        # Genotypes in order of their alleles, the smaller one first: of equals the first is taken.
        a, b = np.triu_indices(count)
        # A slice of groups at once: their sums are as many as groups times genotypes.
        width = max(1, CELLS // len(a))
        best, log_post = np.empty(len(own), np.int64), np.empty(len(own))
        for low in range(0, len(own), width):
            part = slice(low, low + width)
            edge = starts[low + width] if low + width < len(own) else len(some)
            like = _likelihoods(lp[at[starts[low] : edge]], n[some[starts[low] : edge]], starts[part] - starts[low], a, b)
            like += np.where(a == b, 0.0, math.log(2))
            best[part] = np.round(like, 9).argmax(1)
            top = like.max(1)
            log_post[part] = like[np.arange(len(like)), best[part]] - top - np.log(np.exp(like - top[:, None]).sum(1))
        post[own] = log_post
        at_a, at_b = (offsets[some] + x[best][np.searchsorted(own, group[some])] for x in (a, b))
        gt["gt_a"][own], gt["gt_b"][own] = number[at_a[starts]], number[at_b[starts]]
        to = np.where(lp[at_b] > lp[at_a] + NEAR, at_b, at_a)
        out["allele"][some], out["step"][some] = number[to], long[some] - size[to]
        first = np.where(np.round(lp[at_b], 9) > np.round(lp[at_a], 9), at_b, at_a)
        out["shown"][some], shows[some] = number[first], long[some] == size[first]
    leads = np.zeros(rows.num_rows, bool)
    leads[firsts] = True
    column = lambda x, kind, off=None: pa.array(x, kind, mask=off)
    made = {
        "allele": column(out["allele"], pa.int64()), "step": column(out["step"].astype(np.int32), pa.int32()), "whole": column(whole[group], pa.int64()),
        "shown": column(out["shown"], pa.int64(), ~shows), "leads": column(leads, pa.bool_()),
        **{c: column(gt[c][group], pa.int64(), ~leads) for c in gt}, "log_post": column(post[group], pa.float64(), ~leads),
    }
    kept = ("locus", "sample", "seq", "n")
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *made.values()], names=[*kept, *made])


def _numbered(found: DataFrame, alleles: DataFrame, number: int) -> DataFrame:
    """New alleles (locus, seq), in order of length and letters behind those that the locus has."""
    have = alleles.groupBy("locus").agg(F.count("*").alias("have"))
    place = F.row_number().over(Window.partitionBy("locus").orderBy(F.length("seq"), "seq")) - 1
    return found.join(have, "locus").select("locus", (F.col("have") + place).alias("allele"), F.col("seq").alias("aseq"), F.lit(number).alias("round"))


def to_fixpoint(
    spans: DataFrame,
    loci: DataFrame,
    score: Callable[[Column, Column, Column], Column],
    least: int = 2,
    share: float = 0.15,
    most: int = 1000,
    prune: bool = True,
) -> Fixpoint:
    """spans: locus, sample, seq (what a read holds of the repeat, one row a read). loci: locus, period, ref.

    The first alleles are the reference's (number 0) and the candidates of `allele_support`. A sequence that reads show
    as stutter of their sample's alleles, at least `least` of them and `share` of the sample's reads, becomes an allele.
    A locus that would have more than `most` alleles is given up and has no genotypes. Then alleles that no sample's
    genotype has, and after them those that no read shows without stutter, go, and the genotypes of their loci are found
    again from the scores that there are. Null sequences take no part; loci without reads have no rows; an empty table
    gives none. Genotypes are numbers of alleles that were kept, the smaller first; ties go to smaller numbers.
    """
    spans = spans.where(F.col("locus").isNotNull() & F.col("seq").isNotNull()).select("locus", "sample", "seq")
    spans = spans.join(loci.select("locus"), "locus", "left_semi")
    pooled = written(spans.groupBy("locus", "sample", "seq").agg(F.count("*").alias("n")), "pooled")
    seqs = written(pooled.select("locus", "seq").distinct(), "sequences")
    periods = loci.select("locus", "period")

    ref = loci.join(pooled.select("locus").distinct(), "locus", "left_semi").select("locus", F.lit(0).cast("long").alias("allele"), F.col("ref").alias("aseq"), F.lit(0).alias("round"))
    ref = written(ref, "alleles")
    strong = agg.allele_support(pooled, "seq", "n").where("candidate").select("locus", "seq").join(ref.select("locus", F.col("aseq").alias("seq")), ["locus", "seq"], "left_anti")
    new = written(ref.unionByName(_numbered(strong, ref, 0).withColumn("allele", F.col("allele").cast("long"))), "alleles")
    discard(ref)
    alleles, scores, finals, lost, done, shows = new, [], [], [], [], []
    state, number = seqs, 0
    while True:
        state = written(_scored(state, new, periods, score), "scores")
        scores.append(_spread(state) if number == 0 else _new_only(state, new))
        own = pooled if number == 0 else pooled.join(new.select("locus").distinct(), "locus", "left_semi")
        best, given = _genotyped(own, state)
        odd = given.where((F.col("step") != 0) & (F.col("n") >= least) & (F.col("n") >= share * F.col("whole")))
        odd = odd.select("locus", "seq").distinct().join(alleles.select("locus", F.col("aseq").alias("seq")), ["locus", "seq"], "left_anti")
        found = written(_numbered(odd, alleles, number + 1).withColumn("allele", F.col("allele").cast("long")), "alleles")
        over = found.where(F.col("allele") >= most).select("locus").distinct()
        lost.append(written(over, "lost"))
        going = found.select("locus").distinct()
        finals.append(best.join(going, "locus", "left_anti"))
        done.append(state.join(going, "locus", "left_anti"))
        shows.append(_shown(given).join(going, "locus", "left_anti"))
        new = found.join(lost[-1], "locus", "left_anti")
        if new.isEmpty():
            break
        number += 1
        alleles = alleles.unionByName(new)
    given_up = _union(lost)
    genotypes = _union(finals)
    alleles = alleles.join(given_up, "locus", "left_anti")
    every = _union(done)
    if prune:
        alive = pooled.join(given_up, "locus", "left_anti")
        keep = written(_called(genotypes, alleles), "kept")
        genotypes, shown = _again(genotypes, _union(shows), alive, every, alleles, keep)
        seen = written(keep.join(shown, ["locus", "allele"], "left_semi").unionByName(keep.where("allele = 0")).distinct(), "kept")
        genotypes, _ = _again(genotypes, shown, alive, every, keep, seen)
        keep = seen
    else:
        keep = alleles
    return _renumbered(genotypes, alleles, keep, given_up, scores)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _called(genotypes: DataFrame, alleles: DataFrame) -> DataFrame:
    called = genotypes.select("locus", F.explode(F.array("gt_a", "gt_b")).alias("allele")).distinct()
    return alleles.join(called, ["locus", "allele"], "left_semi").unionByName(alleles.where("allele = 0")).distinct()


def _shown(given: DataFrame) -> DataFrame:
    """Alleles that some read is given to without stutter."""
    return given.where("shown is not null").select("locus", F.col("shown").alias("allele")).distinct()


def _again(genotypes: DataFrame, shown: DataFrame, pooled: DataFrame, scores: DataFrame, before: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genotypes, and alleles shown, of loci that have lost alleles, from the scores of those kept; those of others stay."""
    gone = written(before.join(keep, ["locus", "allele"], "left_anti").select("locus").distinct(), "affected")
    if gone.isEmpty():
        return genotypes, shown
    own = _kept(scores.join(gone, "locus", "left_semi"), keep)
    best, given = _genotyped(pooled.join(gone, "locus", "left_semi"), own)
    return genotypes.join(gone, "locus", "left_anti").unionByName(best), shown.join(gone, "locus", "left_anti").unionByName(_shown(given))


def _renumbered(genotypes: DataFrame, alleles: DataFrame, keep: DataFrame, given_up: DataFrame, scores: list[DataFrame]) -> Fixpoint:
    place = F.row_number().over(Window.partitionBy("locus").orderBy("allele")) - 1
    number = written(keep.select("locus", "allele", place.cast("long").alias("number")), "numbers")
    listed = alleles.join(number, ["locus", "allele"], "left").select("locus", "allele", F.col("aseq").alias("seq"), "round", F.col("number").isNotNull().alias("kept"), "number")
    out = genotypes
    for c in ("gt_a", "gt_b"):
        own = number.select("locus", F.col("allele").alias(c), F.col("number").alias(f"new_{c}"))
        out = out.join(own, ["locus", c])
    out = out.select("locus", "sample", F.col("new_gt_a").alias("gt_a"), F.col("new_gt_b").alias("gt_b"), "log_post", "n")
    return Fixpoint(out, listed, given_up, scores)
