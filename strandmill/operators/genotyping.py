"""From reads at loci to genotypes: candidate alleles, haplotype blocks, reads' likelihoods, genotype posteriors.

Reads are aligned row by row, so a deep locus is spread over tasks; sums by fragment and by sample combine before the
shuffle. What is gathered for a locus is its candidate alleles, which their thresholds keep few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import haplotypes as hp
from ..functions import read_ops as ro
from ..functions.cigars import texts
from . import aggregates as agg
from .reads import cigar_text, ro_split

#: The stutter model of a locus that has none of its own.
MODEL = {"in_geom": 0.9, "in_up": 0.05, "in_down": 0.05, "out_geom": 0.9, "out_up": 0.01, "out_down": 0.01}
_BLOCKS = "blocks array<struct<start long, end long, seqs array<string>, repeat boolean>>"
_ARROW_BLOCKS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seqs", pa.list_(pa.string())), ("repeat", pa.bool_())]))


def _add(rows: DataFrame, inputs: list[str], new: str, types: list[pa.DataType], one: Callable[..., tuple]) -> DataFrame:
    """Adds columns that `one` makes of the inputs; equal inputs in a batch are worked on once."""
    fields = T.StructType.fromDDL(new).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}
            columns = [batch.column(batch.schema.names.index(c)) for c in inputs]
            # Flat columns without nulls go by way of numpy, which takes a fraction of the time.
            values = [texts(x) if not x.null_count and not pa.types.is_nested(x.type) else x.to_pylist() for x in columns]
            out = []
            for v in zip(*values, strict=True):
                key = repr(v)
                if key not in known:
                    known[key] = one(*v)
                out.append(known[key])
            more = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *(f.name for f in fields)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))


def _cigar(text: str) -> list[tuple[str, int]]:
    return [(op, int(n)) for n, op in ro_split(text)]


def spanned_alleles(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus, sample, allele) of reads that reach beyond the repeat and its padding on both sides."""

    def one(pos, end, cigar, bases, start, stop):
        return (ro.sequence_between(ro.Read(pos, tuple(_cigar(cigar)), bases, ""), start - hp.PAD, stop + hp.PAD),)

    near = reads.select("locus", "sample", "pos", "end_pos", "cigar", "bases").join(loci.select("locus", "start", "stop"), "locus")
    near = near.where((F.col("pos") < F.col("start") - hp.PAD) & (F.col("end_pos") > F.col("stop") + hp.PAD) & (F.col("cigar") != ""))
    found = _add(near, ["pos", "end_pos", "cigar", "bases", "start", "stop"], "allele string", [pa.string()], one)
    return found.where("allele is not null").select("locus", "sample", "allele")


def haplotype_blocks(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus, period, blocks) of loci that reads span; the flanks go as far as reads do, FLANK bases at most.

    reads: locus, sample, pos, end_pos, cigar, bases. loci: locus, start, stop, period, ref_start, ref (the reference
    from FLANK + PAD bases before to as many behind). A locus without a read 5 bases beyond the padding on each side,
    or too near to the end of its reference, has no row.
    """
    alleles = spanned_alleles(reads, loci)
    chosen = agg.allele_support(alleles, "allele").where("candidate").groupBy("locus").agg(F.array_sort(F.collect_set("allele")).alias("alleles"))
    reach = reads.groupBy("locus").agg(F.min("pos").alias("first"), F.max("end_pos").alias("last"))
    rows = loci.select("locus", "start", "stop", "period", "ref_start", "ref").join(reach, "locus").join(chosen, "locus", "left")
    rows = rows.where((F.col("first") + 5 < F.col("start") - hp.PAD) & (F.col("last") - 5 > F.col("stop") + hp.PAD))

    def one(start, stop, period, ref, ref_start, alleles, first, last):
        if start - hp.PAD - hp.FLANK < ref_start or stop + hp.PAD + hp.FLANK > ref_start + len(ref):
            return (None,)
        blocks = hp.fuse_blocks([hp.repeat_block(start, stop, period, ref, ref_start, alleles or [])], ref, ref_start, first, last)
        return (blocks and [{"start": b.start, "end": b.end, "seqs": list(b.seqs), "repeat": b.repeat} for b in blocks],)

    out = _add(rows, ["start", "stop", "period", "ref", "ref_start", "alleles", "first", "last"], _BLOCKS, [_ARROW_BLOCKS], one)
    return out.where("blocks is not null").select("locus", "period", "blocks")


def matching_reads(reads: DataFrame) -> DataFrame:
    """Adds matched (the CIGAR with = and X for M, without clips) and kept (the bases it covers)."""

    def one(pos, cigar, bases, ref_start, ref):
        kept, ops = hp.matching_cigar(_cigar(cigar), bases, pos, ref, ref_start)
        return cigar_text((op, n) for op, n in ops), kept

    return _add(reads, ["pos", "cigar", "bases", "ref_start", "ref"], "matched string, kept string", [pa.string(), pa.string()], one)


def haplotype_likelihoods(reads: DataFrame, blocks: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """Adds seed and log_probs (by haplotype, in the order of `haplotypes`) to reads of loci with blocks; a read without
    a seed says nothing (null, zeros).

    reads: locus, sample, rname, pos, cigar, bases, quals, ref_start, ref (the reference along the read) and others.
    """
    model = model or MODEL

    def one(pos, cigar, bases, quals, ref_start, ref, period, blocks):
        made = [hp.Block(b["start"], b["end"], tuple(b["seqs"]), b["repeat"]) for b in blocks]
        ops = _cigar(cigar)
        kept, matched = hp.matching_cigar(ops, bases, pos, ref, ref_start)
        quality = hp.matching_cigar(ops, quals, pos, ref, ref_start)[0]
        seed = hp.best_seed(pos, matched, made, len(kept)) if kept else None
        if seed is None:
            n = 1
            for b in made:
                n *= len(b.seqs)
            return None, [0.0] * n
        return seed, hp.read_likelihoods(kept, quality, seed, made, period, model)

    # one read takes milliseconds: deal them evenly, by the keys that genotypes() sums fragments by
    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = reads.join(blocks, "locus").repartition(parts, "locus", "sample", "rname")
    out = _add(near, ["pos", "cigar", "bases", "quals", "ref_start", "ref", "period", "blocks"], "seed int, log_probs array<double>", [pa.int32(), pa.list_(pa.float64())], one)
    return out.drop("period", "blocks")


def genotypes(likelihoods: DataFrame) -> DataFrame:
    """(locus, sample, gt_a, gt_b, log_post, n) of the best unordered genotype, gt_a <= gt_b, by haplotype number; ties
    go to smaller numbers. Mates count as one fragment; every ordered pair of haplotypes is as likely beforehand.

    likelihoods: locus, sample, rname, log_probs, seed. Reads without a seed take no part.
    """
    each = likelihoods.where("seed is not null").select("locus", "sample", "rname", F.posexplode("log_probs").alias("h", "lp"))
    fragment = each.groupBy("locus", "sample", "rname", "h").agg(F.sum("lp").alias("lp"))
    fragment = fragment.groupBy("locus", "sample", "rname").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "lp"))), lambda x: x["lp"]).alias("lps"))

    def pair(x, y):
        return F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))) - F.log(F.lit(2.0))

    of_b = F.transform("lps", lambda y, b: F.transform(F.slice("lps", F.lit(1), b + 1), lambda x, a: F.struct(a.alias("gt_a"), b.alias("gt_b"), pair(x, y).alias("lp"))))
    rows = fragment.select("locus", "sample", F.inline(F.flatten(of_b)))
    like = rows.groupBy("locus", "sample", "gt_a", "gt_b").agg(F.sum("lp").alias("lp"), F.count("*").alias("n"))
    like = like.withColumn("lp", F.col("lp") + F.when(F.col("gt_a") == F.col("gt_b"), 0.0).otherwise(F.log(F.lit(2.0))))
    total = agg.grouped_log_sum_exp(like, ["locus", "sample"], "lp")
    best = like.groupBy("locus", "sample").agg(F.min(F.struct((-F.round("lp", 9)).alias("k"), "gt_a", "gt_b", "lp", "n")).alias("b"))
    return best.join(total.select("locus", "sample", "lse"), ["locus", "sample"]).select("locus", "sample", "b.gt_a", "b.gt_b", (F.col("b.lp") - F.col("lse")).alias("log_post"), "b.n")
