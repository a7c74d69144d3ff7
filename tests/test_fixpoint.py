"""Genotypes to a fixpoint against a plain loop over each locus."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import kernels as k
from strandmill.operators import fixpoint

MODEL = {"in_geom": 0.9, "in_up": 0.05, "in_down": 0.08, "out_geom": 0.9, "out_up": 0.01, "out_down": 0.01}
ERROR = 1e-3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def score(seq, allele, period):
    import numpy as np

    diff = len(seq) - len(allele)
    return float(k.log_stutter(np.array([diff]), period, MODEL)[0]) + (edits(seq, allele) - abs(diff)) * math.log(ERROR / 3)


def genotype(samples, alleles, period):
    """{sample: (a, b, log_post)} by sequences of alleles {number: seq}."""
    out = {}
    for s, reads in samples.items():
        like = {}
        for b in alleles:
            for a in alleles:
                if a <= b:
                    lp = sum(math.log(0.5 * math.exp(score(q, alleles[a], period)) + 0.5 * math.exp(score(q, alleles[b], period))) for q in reads)
                    like[a, b] = lp + (math.log(2) if a != b else 0)
        top = max(like.values())
        total = top + math.log(sum(math.exp(v - top) for v in like.values()))
        a, b = min(like, key=lambda g: (-round(like[g], 9), *g))
        out[s] = (a, b, like[a, b] - total)
    return out


def given(q, a, b, alleles, period):
    return b if score(q, alleles[b], period) > score(q, alleles[a], period) + 1e-9 else a


def plain(reads, ref, period, most):
    """(alleles {number: (seq, round)}, kept numbers, genotypes) of one locus, or None if it is given up."""
    samples = {}
    for s, q in reads:
        samples.setdefault(s, []).append(q)
    count, shares, strong = {}, {}, set()
    for own in samples.values():
        for q in set(own):
            n = own.count(q)
            count[q] = count.get(q, 0) + n
            shares[q] = shares.get(q, 0) + n / len(own)
            if n >= 2 and n / len(own) >= 0.2:
                strong.add(q)
    first = [q for q in count if q in strong or round(shares[q], 9) > 0.05 * len(samples) or count[q] > 0.05 * len(reads)]
    order = lambda x: sorted(x, key=lambda q: (len(q), q))
    alleles = dict(enumerate([ref, *order(set(first) - {ref})]))
    since = dict.fromkeys(alleles, 0)
    number = 0
    while True:
        best = genotype(samples, alleles, period)
        new = set()
        for s, own in samples.items():
            a, b, _ = best[s]
            for q in set(own):
                n = own.count(q)
                to = alleles[given(q, a, b, alleles, period)]
                if len(q) != len(to) and n >= 2 and n >= 0.15 * len(own) and q not in alleles.values():
                    new.add(q)
        if not new:
            break
        if len(alleles) + len(new) > most:
            return None
        number += 1
        for q in order(new):
            since[len(alleles)] = number
            alleles[len(alleles)] = q
    keep = {0} | {x for a, b, _ in best.values() for x in (a, b)}
    left = {n: q for n, q in alleles.items() if n in keep}
    best = genotype(samples, left, period)
    seen = {0}
    for s, own in samples.items():
        a, b, _ = best[s]
        for q in own:
            to = min((a, b), key=lambda x: (-round(score(q, left[x], period), 9), x))
            if len(left[to]) == len(q):
                seen.add(to)
    left = {n: q for n, q in left.items() if n in seen}
    best = genotype(samples, left, period)
    place = {n: i for i, n in enumerate(sorted(left))}
    return {n: (q, since[n]) for n, q in alleles.items()}, place, {s: (place[a], place[b], lp) for s, (a, b, lp) in best.items()}


def made(seed):
    rng = random.Random(seed)
    loci, reads = [], []
    for locus in range(40):
        period = rng.randint(2, 4)
        unit = "".join(rng.choices("ACGT", k=period))
        units = rng.randint(5, 9)
        loci.append((locus, period, unit * units))
        samples = rng.choice([1, 3, 12, 25])
        for s in range(samples):
            pair = [max(2, units + rng.choice([0, 0, 0, -2, -1, 1, 2, 4])) for _ in range(2)]
            for _ in range(rng.randint(1, 14)):
                n = max(1, rng.choice(pair) + rng.choice([0] * 5 + [-1, -1, 1, 2]))
                q = unit * n
                if rng.random() < 0.05:
                    at = rng.randrange(len(q))
                    q = q[:at] + rng.choice("ACGT") + q[at + 1 :]
                reads.append((locus, f"s{s}", q if rng.random() > 0.02 else q + rng.choice("ACGT")))
    return loci, reads


@pytest.mark.parametrize("most", [1000, 6])
def test_equals_a_plain_loop(spark, most):
    loci, reads = made(3)
    frame = spark.createDataFrame(reads + [(1, "s0", None), (None, "s0", "AC"), (99, "s0", "AC")], "locus long, sample string, seq string").repartition(4)
    table = spark.createDataFrame(loci + [(50, 2, "ACAC")], "locus long, period int, ref string")
    out = fixpoint.to_fixpoint(frame, table, fixpoint.stutter_score(MODEL, ERROR), most=most)
    genotypes, alleles, lost = {}, {}, {r.locus for r in out.given_up.collect()}
    for r in out.genotypes.collect():
        assert (r.locus, r.sample) not in genotypes
        genotypes[r.locus, r.sample] = (r.gt_a, r.gt_b, r.log_post, r.n)
    for r in out.alleles.collect():
        alleles.setdefault(r.locus, {})[r.allele] = (r.seq, r.round, r.number)
    later = 0
    for locus, period, ref in loci:
        own = [(s, q) for i, s, q in reads if i == locus]
        want = plain(own, ref, period, most)
        assert (want is None) == (locus in lost)
        if want is None:
            assert locus not in alleles
            continue
        listed, place, best = want
        later += max(r for _, r in listed.values())
        assert alleles[locus] == {n: (q, r, place.get(n)) for n, (q, r) in listed.items()}
        for s, (a, b, lp) in best.items():
            got = genotypes.pop((locus, s))
            assert got[:2] == (a, b) and math.isclose(got[2], lp, abs_tol=1e-6) and got[3] == sum(x == s for x, _ in own)
    assert not genotypes and (most < 1000 or later > 3) and (most == 1000 or lost)
    # Scores are made once, of new alleles of active loci only.
    rows = [[(r.locus, r.seq, r.allele) for r in t.collect()] for t in out.scores]
    assert sum(map(len, rows)) == len({x for t in rows for x in t})
    for number, t in enumerate(rows):
        assert {alleles[i][a][1] for i, _, a in t if i in alleles} <= {number}
    active = [{i for i, _, _ in t} for t in rows]
    assert all(b < a for a, b in zip(active, active[1:]))


def test_no_reads(spark):
    none = spark.createDataFrame([], "locus long, sample string, seq string")
    out = fixpoint.to_fixpoint(none, spark.createDataFrame([(1, 2, "ACAC")], "locus long, period int, ref string"), fixpoint.stutter_score(MODEL))
    assert out.genotypes.count() == out.alleles.count() == out.given_up.count() == 0


def test_cigar_walks_equal_the_plain_ones(spark):
    from strandmill.functions import cigars as cg
    from strandmill.functions import read_ops as ro

    rng = random.Random(8)
    rows = []
    for n in range(400):
        ops = [(rng.choice("M=XIDN"), rng.randint(1, 6)) for _ in range(rng.randint(1, 6))]
        ops = ([("H", 2)] if rng.random() < 0.2 else []) + ([("S", 3)] if rng.random() < 0.3 else []) + ops + ([("S", 2)] if rng.random() < 0.3 else [])
        size = sum(m for op, m in ops if op in "M=XIS")
        pos = rng.randint(0, 10)
        end = pos + sum(m for op, m in ops if op in "M=XDN")
        start = rng.randint(0, 20)
        rows.append((n, "".join(f"{m}{op}" for op, m in ops), "".join(rng.choices("ACGT", k=size)), pos, end, start, start + rng.randint(0, 12)))
    df = spark.createDataFrame(rows, "n long, cigar string, bases string, pos long, end_pos long, start long, stop long").withColumn("w", cg.steps(F.col("cigar"), F.col("pos")))
    c = F.col
    got = df.select(
        "n",
        cg.length_change(c("w"), c("pos"), c("end_pos"), c("start"), c("stop")).alias("change"),
        cg.sequence_between(c("w"), c("bases"), c("pos"), c("end_pos"), c("start"), c("stop")).alias("inside"),
        cg.base_at(c("w"), c("bases"), c("start")).alias("base"),
    ).collect()
    for r in got:
        _, cigar, bases, pos, end, start, stop = rows[r.n]
        import re

        ops = tuple((op, int(m)) for m, op in re.findall(r"(\d+)(\D)", cigar))
        read = ro.Read(pos, ops, bases, "I" * len(bases))
        assert r.change == ro.length_change(read, start, stop) and r.inside == ro.sequence_between(read, start, stop), rows[r.n]
        assert r.base == k.bases_at(list(ops), bases, bases, pos, [start])[0][0]


def shifted(ops, bases, pos, ref, ref_start):
    """One place at a time."""
    ops = [list(x) for x in ops]
    k = 0
    while k < len(ops):
        op, n = ops[k]
        at = pos - ref_start + sum(m for o, m in ops[:k] if o in "MD")
        seen = sum(m for o, m in ops[:k] if o in "MIS")
        while op in "ID" and k and ops[k - 1][0] == "M" and ops[k - 1][1] > 1 and (ref[at - 1] == ref[at + n - 1] if op == "D" else bases[seen - 1] == bases[seen + n - 1]):
            ops[k - 1][1] -= 1
            if k + 1 < len(ops) and ops[k + 1][0] == "M":
                ops[k + 1][1] += 1
            else:
                ops.insert(k + 1, ["M", 1])
            at, seen = at - 1, seen - 1
        k += 1
    return "".join(f"{m}{o}" for o, m in ops)


def test_left_alignment_equals_single_steps(spark):
    from strandmill.functions import cigars as cg

    rng = random.Random(9)
    rows = []
    for n in range(500):
        ops = [("M", rng.randint(1, 12))]
        for _ in range(rng.randint(0, 3)):
            ops += [(rng.choice("ID"), rng.randint(1, 4))] + ([("M", rng.randint(1, 9))] if rng.random() < 0.9 else [])
        ops = [x for i, x in enumerate(ops) if i == 0 or x[0] != ops[i - 1][0]]
        ops = ([("H", 2)] if rng.random() < 0.2 else []) + ([("S", 3)] if rng.random() < 0.3 else []) + ops + ([("S", 2)] if rng.random() < 0.3 else [])
        letters = rng.choice(["A", "AC", "ACGT"])
        bases = "".join(rng.choices(letters, k=sum(m for o, m in ops if o in "MIS")))
        unit = "".join(rng.choices("ACGT", k=rng.randint(1, 3)))
        rows.append((n, "".join(f"{m}{o}" for o, m in ops), bases, 5, rng.choice([unit * 40, "".join(rng.choices(letters, k=80))]), 2))
    df = spark.createDataFrame(rows, "n long, cigar string, bases string, pos long, ref string, ref_start long")
    c = F.col
    moved = 0
    for r in df.select("*", cg.left_aligned(c("cigar"), c("bases"), c("pos"), c("ref"), c("ref_start")).alias("got")).collect():
        import re

        ops = [(op, int(m)) for m, op in re.findall(r"(\d+)(\D)", r.cigar)]
        assert r.got == shifted(ops, r.bases, r.pos, r.ref, r.ref_start), r
        moved += r.got != r.cigar
    assert moved > 100
