"""Haplotypes of blocks, stutter and flank alignment against plain forms of their definitions, and genotypes of reads
made from known alleles."""

import math
import random

import numpy as np
import pytest

from strandmill.functions import haplotypes as hp
from strandmill.functions import kernels as k

MODEL = {"in_geom": 0.9, "in_down": 0.01, "in_up": 0.02, "out_geom": 0.7, "out_down": 0.001, "out_up": 0.001}
BLOCKS = [hp.Block(0, 8, ("ACGGTATC", "ACGGTCTC")), hp.Block(8, 12, ("ATAT", "ATATAT", "ATATATAT"), True), hp.Block(12, 19, ("GAATCCC", "GAATTCC"))]


def sequence(blocks, choice):
    return "".join(b.seqs[c] for b, c in zip(blocks, choice, strict=True))


def test_haplotypes_of_three_blocks():
    order = hp.haplotypes(BLOCKS)
    assert len(order) == len(set(order)) == 12
    assert all(sum(a != b for a, b in zip(x, y)) == 1 for x, y in zip(order, order[1:]))
    assert order[:7] == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 2, 0), (1, 2, 0), (1, 2, 1)]
    back = hp.reverse_blocks(BLOCKS)
    for choice in order:
        assert sequence(back, choice[::-1]) == sequence(BLOCKS, choice)[::-1]
    assert hp.reverse_blocks(back) == BLOCKS and back[1].repeat


def test_runs_reach_into_neighbours():
    assert hp.run_lengths(["ACC", "CCG", "GT"]) == [[1, 4, 4], [4, 4, 2], [2, 1]]
    assert hp.run_lengths(["AAC", "", "CT"]) == [[2, 2, 2], [], [2, 1]]


def test_transitions_sum_to_one():
    indel, stay = hp.run_transitions()
    assert np.allclose(2 * np.exp(indel[1:]) + np.exp(stay[1:]), 1) and (np.diff(indel[1:]) >= 0).all()


def plain_stutter(read, right, wrong, block, period, step):
    """Every place of the change by itself; the read ends at its last base and block and read are taken from the right."""
    size = len(block)

    def fit(r, q):
        return right[-1 - r] if block[size - 1 - q] == read[-1 - r] else wrong[-1 - r]

    seen = min(size + step, len(read))
    if step == 0:
        return sum(fit(r, r) for r in range(seen))
    terms = []
    for place in range(size + min(step, 0) + 1):
        total = 0.0
        if step > 0:
            place = min(place, max(0, seen - step), max(0, size - period))
        for r in range(seen):
            if step < 0:
                total += fit(r, r if r < place else r - step)
            elif r < place:
                total += fit(r, r)
            elif r < place + step:
                q = place + (r - place) % period
                total += fit(r, q) if q < size else right[-1 - r]
            else:
                total += fit(r, r - step)
        terms.append(total)
    return k.lse(np.array(terms)) - math.log(len(terms))


@pytest.mark.parametrize("period,block", [(2, "ATATATAT"), (3, "CAGCAGCAACAG"), (1, "AAAA"), (4, "GAT"), (2, "ATGTAT")])
def test_stutter_against_every_place(period, block):
    rng = random.Random(period)
    read = "".join(rng.choice("ACGT") for _ in range(6)) + block + block[-period:] + block
    right, wrong = hp.quality_logs("".join(rng.choice("5:I") for _ in read))
    code = lambda s: np.frombuffer(s.encode(), np.uint8)
    rows = hp.stutter_rows(code(read), right, wrong, code(block), period, 3)
    assert set(rows) == {s for s in range(-3 * period, 3 * period + 1, period) if len(block) + s >= 0}
    for step, got in rows.items():
        for j in range(len(read)):
            assert math.isclose(got[j], plain_stutter(read[: j + 1], right[: j + 1], wrong[: j + 1], block, period, step), abs_tol=1e-9), (step, j)


def plain_forward(parts, repeat, read, right, wrong, period, model):
    """Cell by cell."""
    n, (indel, stay), low = len(read), hp.run_transitions(), hp.LOW
    emit = lambda c, j: right[j] if read[j] == c else wrong[j]
    runs = hp.run_lengths(parts)
    match = [emit(parts[0][0], j) + sum(right[:j]) for j in range(n)]
    gained, lost, out, after = [right[j] + sum(right[:j]) for j in range(n)], [low] * n, [], False
    out.append(match[-1])
    for b, part in enumerate(parts):
        if repeat[b]:
            now = []
            for j in range(n):
                terms = []
                for step in range(-6 * period, 6 * period + 1, period):
                    if len(part) + step >= 0:
                        seen = min(len(part) + step, j + 1)
                        fit = plain_stutter(read[: j + 1], right[: j + 1], wrong[: j + 1], part, period, step) if seen else 0.0
                        terms.append(fit + float(k.log_stutter(np.array(step), period, model)) + (match[j - seen] if j >= seen else 0))
                now.append(k.lse(np.array(terms)))
            out += [low] * (len(part) - 1) + [now[-1]]
            match, gained, lost, after = now, [low] * n, [low] * n, True
            continue
        for x in range(1 if b == 0 else 0, len(part)):
            h = min(hp.RUN_MOST, max(runs[b][x], runs[b][max(0, x - 1)]))
            m, i, d = [emit(part[x], 0)], [low if after else right[0]], [low if after else max(lost[0] + hp.GO_ON, match[0] + hp.OPEN)]
            for j in range(1, n):
                if after:
                    m, i, d = [*m, emit(part[x], j) + match[j - 1]], [*i, low], [*d, low]
                    continue
                m.append(emit(part[x], j) + max(i[j - 1] + indel[h], match[j - 1] + stay[h], lost[j - 1] + indel[h]))
                i.append(right[j] + max(match[j - 1] + hp.OPEN, i[j - 1] + hp.GO_ON))
                d.append(max(match[j] + hp.OPEN, lost[j] + hp.GO_ON))
            match, gained, lost, after = m, i, d, False
            out.append(match[-1])
    return out


def test_forward_against_cells():
    rng = random.Random(5)
    for read in ("CGGTATCATATATGAATC", "GGTCTCATATGAAATCC", "ACGGTTATCATATATATATGA"):
        right, wrong = hp.quality_logs("".join(rng.choice("+5I") for _ in read))
        letters = np.frombuffer(read.encode(), np.uint8)
        for choice in hp.haplotypes(BLOCKS):
            parts = [b.seqs[c] for b, c in zip(BLOCKS, choice, strict=True)]
            repeat = [b.repeat for b in BLOCKS]
            got = hp.forward(parts, repeat, letters, right, wrong, 2, MODEL)
            want = plain_forward(parts, repeat, read, right, wrong, 2, MODEL)
            assert np.allclose(got[got > -1e6], np.array(want)[got > -1e6], atol=1e-8)
            assert (got > -1e6).tolist() == [w > -1e6 for w in want]


def test_reads_prefer_their_haplotype():
    flank = "GATTACAGGCTTACCGATGC", "TTGCAGGACCATGACCTGAA"
    blocks = [hp.Block(0, 20, flank[:1]), hp.Block(20, 32, ("CAG" * 4, "CAG" * 5, "CAG" * 7), True), hp.Block(32, 52, flank[1:])]
    for number, units in enumerate((4, 5, 7)):
        read = flank[0][4:] + "CAG" * units + flank[1][:15]
        got = hp.read_likelihoods(read, "I" * len(read), 7, blocks, 3, MODEL)
        assert int(np.argmax(got)) == number and max(got) < 0


def test_seed_is_far_from_repeats_and_indels():
    blocks = [hp.Block(0, 20, ("A" * 20,)), hp.Block(20, 30, ("A" * 10,), True), hp.Block(30, 50, ("A" * 20,))]
    assert hp.best_seed(0, [("=", 50)], blocks, 50) == 30 + 9  # equal distances: the last
    assert hp.best_seed(0, [("=", 30), ("D", 3), ("=", 8)], blocks, 38) == 9
    assert hp.best_seed(0, [("=", 7), ("X", 1), ("=", 5)], blocks, 13) is None
    assert hp.best_seed(18, [("=", 16)], blocks, 16) is None


def test_matching_cigar_drops_clips():
    kept, ops = hp.matching_cigar([("S", 2), ("M", 4), ("I", 1), ("M", 2), ("D", 1), ("M", 2), ("S", 1)], "TTACGTGCATAC", 10, "ACCTCAGTA", 10)
    assert kept == "ACGTGCATA" and ops == [("=", 2), ("X", 1), ("=", 1), ("I", 1), ("=", 2), ("D", 1), ("=", 2)]


def test_trim_is_even_and_keeps_the_least():
    assert hp.trim_candidates(["ACACAC"], 6) == (0, 0, ["ACACAC"])
    assert hp.trim_candidates(["TTTTTACACGGGGG", "TTTTTACACACGGGGG"], 6) == (4, 4, ["TACACG", "TACACACG"])
    assert hp.trim_candidates(["TTTTTACACGGGGG", "TTTTTACACACGGGGG"], 5) == (5, 4, ["ACACG", "ACACACG"])
    assert hp.trim_candidates(["TACACACACGGGGG", "AACACACACACGGGGG"], 4)[:2] == (0, 5)


def test_genotypes_of_known_alleles(spark):
    from strandmill.operators import genotyping as gt

    rng = random.Random(11)
    left, right = ("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2))
    ref = left + "CAG" * 8 + right
    rows = []
    for sample, units in (("a", (8, 8)), ("b", (8, 10)), ("c", (6, 10))):
        for i in range(24):
            n = units[i % 2]
            change = 3 * (n - 8)
            bases = left[25:] + "CAG" * n + right[:30]
            cigar = "35M" + (f"{change}I" if change > 0 else f"{-change}D" if change else "") + f"{24 + min(change, 0) + 30}M"
            rows.append((1, sample, i, 25, 25 + 35 + 24 + 30, cigar, bases, "I" * len(bases), 0, ref))
    reads = spark.createDataFrame(rows, "locus long, sample string, rname long, pos long, end_pos long, cigar string, bases string, quals string, ref_start long, ref string")
    loci = spark.createDataFrame([(1, 60, 84, 3, 0, ref), (2, 60, 84, 3, 0, ref)], "locus long, start long, stop long, period int, ref_start long, ref string")
    blocks = gt.haplotype_blocks(reads, loci)
    made = blocks.collect()
    assert [r.locus for r in made] == [1]
    repeats = [b for b in made[0].blocks if b.repeat]
    assert len(repeats) == 1 and [s.count("CAG") for s in repeats[0].seqs] == [8, 6, 10]
    out = {r.sample: (r.gt_a, r.gt_b, r.n) for r in gt.genotypes(gt.haplotype_likelihoods(reads, blocks)).collect()}
    assert out == {"a": (0, 0, 24), "b": (0, 2, 24), "c": (1, 2, 24)}
    assert gt.genotypes(gt.haplotype_likelihoods(reads.limit(0), blocks)).count() == 0
