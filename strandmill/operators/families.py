"""Families with phased SNPs: haplotypes as bit words, inheritance near each locus, and likelihoods of new mutations.

Sites of a chromosome are numbered; a person's haplotype is one word of 63 bits for every 63 sites. Mendelian checks and
the distances of a child's haplotypes to a parent's are bit operations on words, and running sums over the words of a
chromosome give the distance of any range of sites as the difference of its two ends, so no SNP is paired with a locus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import aggregates as agg
from . import ranges

BITS = 63
# The largest distance of a match, the least of the next best pairing.
MOST, NEXT = 10, 100


def numbered_sites(calls: DataFrame) -> DataFrame:
    """(chrom, pos, n): sites of each chromosome numbered from 0."""
    return ranges.rank_by_position(calls.select("chrom", "pos").distinct(), ["chrom"], "pos", [], "ord").select("chrom", "pos", (F.col("ord") - 1).cast("long").alias("n"))


def haplotype_words(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """(chrom, word, person, h1, h2, missing): bit n % 63 of word n div 63 tells the allele of site n.

    calls: chrom, pos, person, gt_a, gt_b (0 or 1; null where the genotype is missing), a row for each person and site.
    A last word, all missing, follows the last site, so that every number of sites up to all of them has its word.
    """
    bit = F.expr(f"shiftleft(1L, cast(n % {BITS} as int))")
    set_if = lambda c: F.when(c, bit).otherwise(F.lit(0).cast("long"))
    missing = F.col("gt_a").isNull() | F.col("gt_b").isNull()
    rows = calls.join(sites, ["chrom", "pos"]).select(
        "chrom", F.expr(f"n div {BITS}").alias("word"), "person", set_if(~missing & (F.col("gt_a") == 1)).alias("h1"), set_if(~missing & (F.col("gt_b") == 1)).alias("h2"), set_if(missing).alias("missing")
    )
    last = sites.groupBy("chrom").agg(F.expr(f"(max(n) + 1) div {BITS}").alias("word"))
    none = F.lit(0).cast("long")
    ends = calls.select("chrom", "person").distinct().join(last, "chrom").select("chrom", "word", "person", none.alias("h1"), none.alias("h2"), none.alias("missing"))
    return rows.unionByName(ends).groupBy("chrom", "word", "person").agg(*(F.bit_or(c).alias(c) for c in ("h1", "h2", "missing")))


def _shared(a: Column, b: Column) -> Column:
    """Bits in which two words agree."""
    return F.bitwise_not(a.bitwiseXOR(b))


def family_words(words: DataFrame, kin: DataFrame) -> DataFrame:
    """(family, child, chrom, word, m0-m3, f0-f3): bits in which the child's haplotypes differ from the mother's and
    father's (first with first, first with second, second with first, second with second).

    kin: family, child, mother, father. Sites where a member of the family has no genotype, or a child's is not made of
    one allele of each parent, differ nowhere.
    """
    own = lambda who, p: words.select("chrom", "word", F.col("person").alias(who), *(F.col(c).alias(f"{p}_{c}") for c in ("h1", "h2", "missing")))
    rows = kin.select("family", "child", "mother", "father").distinct().join(own("child", "c"), "child")
    rows = rows.join(own("mother", "m"), ["chrom", "word", "mother"]).join(own("father", "f"), ["chrom", "word", "father"])
    c = F.col
    has = lambda child, p: _shared(c(child), c(f"{p}_h1")).bitwiseOR(_shared(c(child), c(f"{p}_h2")))
    mendelian = has("c_h1", "m").bitwiseAND(has("c_h2", "f")).bitwiseOR(has("c_h2", "m").bitwiseAND(has("c_h1", "f")))
    called = F.bitwise_not(c("c_missing").bitwiseOR(c("m_missing")).bitwiseOR(c("f_missing")))
    rows = rows.withColumn("use", F.bit_and(mendelian.bitwiseAND(called)).over(Window.partitionBy("family", "chrom", "word")))
    pairs = [(f"{p[0]}{k}", c(f"c_h{1 + k // 2}").bitwiseXOR(c(f"{p[0]}_h{1 + k % 2}")).bitwiseAND(c("use"))) for p in ("mother", "father") for k in range(4)]
    return rows.select("family", "child", "chrom", "word", *(x.alias(n) for n, x in pairs))


_PAIRS = [f"{p}{k}" for p in "mf" for k in range(4)]


def distances(loci: DataFrame, words: DataFrame, sites: DataFrame, reach: int = 500_000) -> DataFrame:
    """(locus, family, child, m0-m3, f0-f3): distances of the haplotypes over the sites within reach of the locus, both
    ends included. loci: locus, chrom, pos. words: those of `family_words`."""
    ends = F.array(F.struct(F.lit(0).alias("turn"), (F.col("pos") - reach).alias("at")), F.struct(F.lit(2).alias("turn"), (F.col("pos") + reach).alias("at")))
    marks = loci.select("locus", "chrom", F.explode(ends).alias("e")).select("locus", "chrom", "e.turn", F.col("e.at").cast("long").alias("at"))
    counted = ranges.counts_before(marks, sites, ["chrom"], "pos")
    before = Window.partitionBy("family", "child", "chrom").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    running = words.select("*", *(F.coalesce(F.sum(F.bit_count(p)).over(before), F.lit(0)).alias(f"sum_{p}") for p in _PAIRS))
    low = F.expr(f"shiftleft(1L, cast(n % {BITS} as int)) - 1")
    at = counted.withColumn("word", F.expr(f"n div {BITS}")).join(running, ["chrom", "word"])
    sign = F.when(F.col("turn") == 2, 1).otherwise(-1)
    upto = [F.sum(sign * (F.col(f"sum_{p}") + F.bit_count(F.col(p).bitwiseAND(low)))).alias(p) for p in _PAIRS]
    return at.groupBy("locus", "family", "child").agg(*upto)


def inheritance(found: DataFrame, most: int = MOST, following: int = NEXT) -> DataFrame:
    """(locus, family, child, maternal, paternal): which pairing each parent's haplotype came by (0 to 3), null where a
    parent has no match within `most`, another pairing nearer than `following`, or both match one haplotype."""
    two = {p: agg.two_smallest([F.col(f"{p}{k}") for k in range(4)]) for p in "mf"}
    rows = found.select("locus", "family", "child", two["m"].alias("m"), two["f"].alias("f"))
    fits = lambda p: (F.col(f"{p}.best") <= most) & (F.col(f"{p}.second") >= following)
    ok = fits("m") & fits("f") & ((F.col("m.best_index") < 2) != (F.col("f.best_index") < 2))
    return rows.select("locus", "family", "child", F.when(ok, F.col("m.best_index")).alias("maternal"), F.when(ok, F.col("f.best_index")).alias("paternal"))


def family_likelihoods(mother: np.ndarray, father: np.ndarray, children: np.ndarray, maternal: np.ndarray, paternal: np.ndarray, log_freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 likelihoods of families (r) of equal size: without a mutation, and for each child with one that is new to
    the parents or not. Genotype likelihoods are log10 by ordered pairs: (r, a, a), children (r, c, a, a)."""
    r, n = log_freq.shape
    top = mother.max((1, 2)) + father.max((1, 2)) + children.max((2, 3)).sum(1)
    prior = 10 ** (log_freq[:, :, None] + log_freq[:, None, :])
    m = 10 ** (mother - mother.max((1, 2), keepdims=True)) * prior
    f = 10 ** (father - father.max((1, 2), keepdims=True)) * prior
    c = 10 ** (children - children.max((2, 3), keepdims=True))
    alleles = np.arange(n)
    # The parents' four haplotypes are the axes i, j, k, l.
    i, j, k, l = np.meshgrid(alleles, alleles, alleles, alleles, indexing="ij")  # noqa: E741
    both = m[:, :, :, None, None] * f[:, None, None, :, :]
    rows = np.arange(r)[:, None, None, None, None]
    from_mother = np.where((maternal % 2 == 0)[:, :, None, None, None, None], i, j)
    from_father = np.where((paternal % 2 == 0)[:, :, None, None, None, None], k, l)
    first = np.where((maternal < 2)[:, :, None, None, None, None], from_mother, from_father)
    second = np.where((maternal < 2)[:, :, None, None, None, None], from_father, from_mother)
    each = [c[:, x][rows, first[:, x], second[:, x]] for x in range(c.shape[1])]
    with np.errstate(divide="ignore"):
        none = np.log10((both * np.prod(each, axis=0)).sum((1, 2, 3, 4))) + top
        new, other = np.zeros((r, len(each))), np.zeros((r, len(each)))
        chance = 1 / (2 * (n - 1)) if n > 1 else 0.0
        for x in range(len(each)):
            rest = both * np.prod([e for y, e in enumerate(each) if y != x], axis=0)
            for to in range(n):
                known = (i == to) | (j == to) | (k == to) | (l == to)
                gained = np.where(first[:, x] != to, c[:, x][rows, to, second[:, x]], 0) + np.where(second[:, x] != to, c[:, x][rows, first[:, x], to], 0)
                weight = rest * gained * chance
                new[:, x] += np.where(known, 0, weight).sum((1, 2, 3, 4))
                other[:, x] += np.where(known, weight, 0).sum((1, 2, 3, 4))
        return none, np.log10(new) + top[:, None], np.log10(other) + top[:, None]


_ADDED = "no_mutation double, any_mutation double, de_novo array<double>, other array<double>"


def scan(kin: DataFrame, inherited: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """(locus, family, children, no_mutation, any_mutation, de_novo, other), log10: loci at which all children of a
    family have an inheritance and all members likelihoods; children in order of their names.

    likelihoods: locus, person, gl (log10 by ordered pairs, row by row), log_freq (log10 of the alleles' frequencies).
    Loci of one allele are left out.
    """
    gl = likelihoods.where(F.size("log_freq") > 1).select("locus", "person", "gl", "log_freq")
    of = lambda who: gl.select("locus", F.col("person").alias(who), F.col("gl").alias(f"{who}_gl"))
    rows = inherited.where("maternal is not null").join(kin.select("family", "child", "mother", "father").distinct(), ["family", "child"])
    rows = rows.join(gl.withColumnsRenamed({"person": "child", "gl": "child_gl"}), ["locus", "child"])
    own = F.array_sort(F.collect_list(F.struct("child", "maternal", "paternal", "child_gl")))
    sizes = kin.groupBy("family").agg(F.countDistinct("child").alias("size"))
    whole = rows.groupBy("locus", "family", "mother", "father").agg(own.alias("c"), F.first("log_freq").alias("log_freq"))
    whole = whole.join(sizes, "family").where(F.size("c") == F.col("size")).join(of("mother"), ["locus", "mother"]).join(of("father"), ["locus", "father"])
    whole = whole.select("locus", "family", "mother_gl", "father_gl", "log_freq", F.col("c.child").alias("children"), F.col("c.maternal").alias("maternal"), F.col("c.paternal").alias("paternal"), F.col("c.child_gl").alias("children_gl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {c: batch.column(batch.schema.names.index(c)).to_pylist() for c in ("mother_gl", "father_gl", "log_freq", "maternal", "paternal", "children_gl")}
            out: list = [None] * batch.num_rows
            alike: dict[tuple[int, int], list[int]] = {}
            for at, (freq, own) in enumerate(zip(given["log_freq"], given["maternal"], strict=True)):
                alike.setdefault((len(freq), len(own)), []).append(at)
            for (n, c), every in alike.items():
                step = max(1, 200_000 // (n**4 * c))
                for lo in range(0, len(every), step):
                    at = every[lo : lo + step]
                    pick = lambda name, shape, at=at: np.array([given[name][x] for x in at], float).reshape(len(at), *shape)
                    none, new, other = family_likelihoods(pick("mother_gl", (n, n)), pick("father_gl", (n, n)), pick("children_gl", (c, n, n)), pick("maternal", (c,)), pick("paternal", (c,)), pick("log_freq", (n,)))
                    every_way = np.concatenate([new, other], axis=1)
                    top = every_way.max(1, keepdims=True)
                    total = top[:, 0] + np.log10((10 ** (every_way - np.where(np.isfinite(top), top, 0))).sum(1)) if len(at) else top
                    for k, x in enumerate(at):
                        out[x] = (float(none[k]), float(total[k]), new[k].tolist(), other[k].tolist())
            kinds = [pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            added = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            names = ["locus", "family", "children"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), *added], names=[*names, "no_mutation", "any_mutation", "de_novo", "other"])

    kept = [whole.schema[c] for c in ("locus", "family", "children")]
    return whole.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(_ADDED).fields]))


def family_call(places: int = 3) -> Column:
    """CHILDREN:NOMUT:ANYMUT:DENOVO:OTHER of a row of `scan`, or a dot where the locus was not scanned."""
    number = lambda x: F.format_string(f"%.{places}f", x)
    several = lambda c: F.array_join(F.transform(c, number), ",")
    text = F.concat_ws(":", F.array_join(F.transform("children", lambda x: x.cast("string")), ","), number(F.col("no_mutation")), number(F.col("any_mutation")), several("de_novo"), several("other"))
    return F.when(F.col("no_mutation").isNotNull(), text).otherwise(".")
