"""Column functions: sequence, CIGAR, quality, stutter and likelihood arithmetic, all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN_HALF = math.log(0.5)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA")


def cigar_elements(cigar: Column) -> Column:
    """array<struct<op, len>> of a CIGAR string."""
    found = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda e: F.struct(F.right(e, F.lit(1)).alias("op"), F.substring(e, F.lit(1), F.length(e) - 1).cast("int").alias("len")))


def cigar_string(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda e: F.concat(e["len"].cast("string"), e["op"])), "")


def cigar_sum(elements: Column, ops: str) -> Column:
    kept = F.filter(elements, lambda e: F.lit(ops).contains(e["op"]))
    return F.aggregate(kept, F.lit(0), lambda acc, e: acc + e["len"])


def cigar_count(elements: Column, ops: str) -> Column:
    return F.size(F.filter(elements, lambda e: F.lit(ops).contains(e["op"])))


def ln_correct(phred: Column) -> Column:
    """ln of the chance that a base of the quality (held within 0 and 41) is right; 0 counts as 1."""
    q = F.greatest(F.lit(1), F.least(F.lit(41), phred))
    return F.log(1 - F.pow(F.lit(10.0), -q / 10.0))


def ln_error(phred: Column) -> Column:
    """ln of the chance of one certain wrong base."""
    q = F.greatest(F.lit(0), F.least(F.lit(41), phred))
    return F.log(F.pow(F.lit(10.0), -q / 10.0) / 3)


def sum_ln_correct(phreds: Column) -> Column:
    return F.aggregate(phreds, F.lit(0.0), lambda acc, q: acc + ln_correct(q))


def log_sum_exp(values: Column) -> Column:
    """Of an array, exact; null if it is empty."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def log_sum_exp_2(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def trunc_div(a: Column, b: Column) -> Column:
    """Integer division towards zero."""
    return F.signum(a).cast("long") * F.floor(F.abs(a) / b).cast("long")


def log_stutter(diff: Column, period: Column, model: dict[str, float]) -> Column:
    """ln of the chance that a read differs by diff base pairs from its allele.

    model: in_geom, in_up, in_down, out_geom, out_up, out_down.
    """
    whole = trunc_div(diff, period)
    outside = F.abs(diff - whole)
    inside = F.abs(whole)

    def branch(kind: str, steps: Column) -> Column:
        g = model[f"{kind}_geom"]
        side = F.when(diff > 0, math.log(model[f"{kind}_up"])).otherwise(math.log(model[f"{kind}_down"]))
        return side + math.log(g) + (steps - 1) * math.log(1 - g)

    same = math.log(1 - model["in_up"] - model["in_down"] - model["out_up"] - model["out_down"])
    return F.when(diff % period != 0, branch("out", outside)).when(diff == 0, F.lit(same)).otherwise(branch("in", inside))


def log_pcr_artifact(diff: Column, period: Column, model: dict[str, float], most: int = 6) -> Column:
    """As log_stutter, but next to nothing beyond `most` repeat units."""
    return F.when(F.abs(diff) > most * period, F.lit(-1e7)).otherwise(log_stutter(diff, period, model))


def genotype_prior(a: Column, b: Column, alleles: Column, haploid: bool = False) -> Column:
    """ln of the prior of an ordered genotype: homozygotes weigh twice a heterozygote's order."""
    if haploid:
        return F.when(a == b, -F.log(alleles)).otherwise(F.lit(-1.7976931348623157e308 / 2))
    return F.when(a == b, F.lit(math.log(2))).otherwise(F.lit(0.0)) - F.log(alleles) - F.log(alleles + 1)


def hardy_weinberg(log_p: Column, log_q: Column, same: Column, phased: bool) -> Column:
    """log10 of the chance of a genotype of allele frequencies 10^log_p, 10^log_q."""
    return log_p + log_q if phased else F.when(same, log_p + log_q).otherwise(math.log10(2) + log_p + log_q)


def mutation_prior(alleles: Column) -> Column:
    """log10 of the chance of one certain mutation on one of two haplotypes."""
    return -math.log10(2) - F.log10(alleles - 1)


def phred_likelihoods(gls: Column) -> Column:
    best = F.array_max(gls)
    return F.transform(gls, lambda g: F.least(F.lit(999), (-10 * (g - best)).cast("int")))


def gl_difference(gls: Column, called: Column, tolerance: float = 1e-10) -> Column:
    """The best likelihood over the second best if the called genotype is a best one, else what the call lacks."""
    order = F.sort_array(gls, asc=False)
    own = F.element_at(gls, called + 1)
    best = order[0]
    return F.when(F.size(gls) <= 1, F.lit(-1000.0)).when(best - own < tolerance, best - F.try_element_at(order, F.lit(2))).otherwise(own - best)


def is_mendelian(child: tuple[Column, Column], mother: tuple[Column, Column], father: tuple[Column, Column]) -> Column:
    a, b = child
    m = lambda x: (x == mother[0]) | (x == mother[1])
    f = lambda x: (x == father[0]) | (x == father[1])
    return (m(a) & f(b)) | (m(b) & f(a))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """log10 of twice the lower tail of a fair binomial at the smaller count, at most 0; null without trials."""
    low = F.least(k, n - k)
    term = lambda i: F.exp(_ln_choose(n, i) - n * math.log(2))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), low.cast("long")), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(n > 0, F.log10(F.least(F.lit(1.0), 2 * tail)))


def _ln_factorial(n: Column) -> Column:
    """Exact sums of logarithms."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(n.cast("long"), F.lit(1).cast("long"))), F.lit(0.0), lambda acc, i: acc + F.log(i)))


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """log10 p of Fisher's exact test: tables with these margins that are no likelier than the one seen."""
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    ln_p = lambda x: _ln_choose(row, x) + _ln_choose(n - row, col - x) - _ln_choose(n, col)
    seen = ln_p(a)
    low, high = F.greatest(F.lit(0).cast("long"), col - (n - row)), F.least(row, col)
    total = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda acc, x: acc + F.when(ln_p(x) <= seen + 1e-8, F.exp(ln_p(x))).otherwise(F.lit(0.0)))
    return F.log10(F.least(F.lit(1.0), total))


def histogram_string(counts: Column) -> Column:
    """key|count;... by key from an array of (key, count); a dot where it is empty."""
    text = F.array_join(F.transform(F.array_sort(counts), lambda s: F.concat(s["key"].cast("string"), F.lit("|"), s["count"].cast("string"))), ";")
    return F.when(F.size(counts) > 0, text).otherwise(F.lit("."))


def info_map(info: Column) -> Column:
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def int_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("int"))


def genotype(gt: Column) -> Column:
    """struct<a, b, phased, missing> of a VCF GT; a single entry is missing, -1 stands for no allele."""
    parts = F.split(gt, r"[|/]")
    whole = F.size(parts) == 2
    a, b = parts.getItem(0).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    missing = ~whole | a.isNull() | b.isNull()
    return F.struct(
        F.when(missing, F.lit(-1)).otherwise(a).alias("a"), F.when(missing, F.lit(-1)).otherwise(b).alias("b"), (whole & gt.contains("|")).alias("phased"), missing.alias("missing")
    )
