"""Queries of the model operators on projected tables; they have no SQL form and are tested by small cases."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import cigars as cg
from ..functions import haplotypes as hp
from ..operators import fixpoint, joins, models
from ..operators import genotyping as gt
from ..sources import projection as pj
from .relational import _posteriors


def mdl_01(s, d):
    """Stutter models of every locus, learned from its reads."""
    return models.learn_stutter_models(pj.reads(s, d).select("locus", "sample", "bp_diff"), pj.regions(s, d), least_reads=20)


def mdl_16(s, d):
    """De-novo likelihoods of trios from the genotype posteriors of their reads."""
    both = F.col("lp") / math.log(10) + F.when(F.col("gt_a") < F.col("gt_b"), math.log10(2)).otherwise(0.0)
    ordered = F.array_sort(F.collect_list(F.struct("gt_b", "gt_a", both.alias("x"))))
    gl = _posteriors(s, d).where("gt_a <= gt_b").groupBy("locus", "sample").agg(F.transform(ordered, lambda x: x["x"]).alias("gl"))
    people = gl.withColumn("person", F.substring("sample", 2, 9).cast("int") + 1)
    kin = s.sql("select * from values (0, 3, 1, 2), (0, 4, 1, 2) as t(family, child, father, mother)")
    t = joins.trios(kin, people, "person", ["gl"])
    freq = F.array(*[F.log10(F.lit(x)) for x in (0.5, 0.3, 0.2)])
    out = models.de_novo_trios(t.select("locus", "child", F.col("m_gl").alias("gl_mother"), F.col("f_gl").alias("gl_father"), F.col("c_gl").alias("gl_child"), freq.alias("log_freq")))
    at = lambda c: F.array_max(c)
    return out.select("locus", "child", F.round("no_mutation", 6).alias("no_mutation"), F.round(at("de_novo"), 6).alias("best_de_novo"), F.round(at("other"), 6).alias("best_other"))


def scl_11(s, d):
    """Alignments of reads to their neighbourhood. The reads lie end to end over the whole sequence, 63 bases each (the
    last one fewer) less the middle three; pos is a read's first base, from 0. The neighbourhood has 10 bases before
    and 17 after."""
    # Aligning takes long for the bytes of a text, so texts are dealt evenly, not as their files lie.
    texts = pj.sequences(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions")))
    pieces = texts.select("doc_id", F.regexp_extract_all("seq", F.lit("(.{1,63})"), 1).alias("p"))

    def tile(x, i):
        read = F.concat(F.substring(x, 1, 30), F.substring(x, 34, 30))
        before = F.when(i > 0, F.right(F.get("p", i - 1), F.lit(10))).otherwise("")
        after = F.coalesce(F.left(F.get("p", i + 1), F.lit(17)), F.lit(""))
        return F.struct((i * 63).alias("pos"), read.alias("read"), F.concat(before, x, after).alias("ref"))

    return models.align_reads(pieces.select("doc_id", F.inline(F.transform("p", tile))), "read").select("doc_id", "pos", "score", "cigar")


def _loci(s, d):
    """Regions with the reference around them."""
    around = hp.FLANK + hp.PAD
    return pj.regions(s, d).withColumn("ref_start", F.col("start") - around).withColumn("ref", pj.reference(f"start - {around}", f"stop - start + {2 * around}"))


def scl_18(s, d):
    """Haplotype blocks of every locus that reads span."""
    blocks = gt.haplotype_blocks(pj.alignments(s, d), _loci(s, d))
    return blocks.select("locus", F.posexplode("blocks").alias("block", "b")).select("locus", "block", "b.start", "b.end", "b.repeat", F.array_join("b.seqs", ",").alias("seqs"))


def scl_14(s, d):
    """CIGARs that tell matches from mismatches, and bases without clips."""
    return gt.matching_reads(pj.alignments(s, d).where("cigar <> ''").select("rid", "pos", "cigar", "bases", "ref_start", "ref")).select("rid", "matched", "kept")


def _to_fixpoint(s, d):
    """Repeats and their padding, as reads hold them, genotyped until no allele is added."""
    pad = hp.PAD
    loci = pj.regions(s, d).select("locus", "period", "start", "stop", pj.reference(f"start - {pad}", f"stop - start + {2 * pad}").alias("ref"))
    ends = loci.select("locus", (F.col("start") - pad).alias("low"), (F.col("stop") + pad).alias("high"))
    # Loci are joined before there are bases, so that only reads that span them get any, and none are shuffled.
    r = pj.alignments_of(pj.reads(s, d).join(ends, "locus"), "low", "high").where("cigar <> ''")
    held = cg.bases_between(*map(F.col, ("cigar", "bases", "pos", "end_pos", "low", "high")))
    spans = r.where("pos < low and end_pos > high").select("locus", "sample", held.alias("seq"))
    return fixpoint.to_fixpoint(spans, loci.select("locus", "period", "ref"), fixpoint.stutter_score(gt.MODEL))


def mdl_07(s, d):
    """Genotypes of every sample at every locus that reads span."""
    return _to_fixpoint(s, d).genotypes.select("locus", "sample", "gt_a", "gt_b", F.round("log_post", 6).alias("log_post"), "n")


def mdl_08(s, d):
    """Alleles of every locus, with the round that added them; kept says whether a genotype and a read hold them."""
    return _to_fixpoint(s, d).alleles.select("locus", "allele", "seq", "round", "kept")


def mdl_09(s, d):
    """Numbers of alleles before and after those unused are taken away."""
    return _to_fixpoint(s, d).alleles.where("kept").select("locus", "allele", "number", "seq")


QUERIES = {f.__name__: f for f in (mdl_01, mdl_07, mdl_08, mdl_09, mdl_16, scl_11, scl_14, scl_18)}
