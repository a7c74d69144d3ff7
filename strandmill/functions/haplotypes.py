"""Haplotypes made of blocks, and the likelihood of a read given each of them.

A haplotype is a choice of one sequence for every block; blocks alternate between flanks, which a read may leave by
sequencing errors and rare indels, and repeats, which it may leave by stutter: whole units gained or lost anywhere.
A read is cut at a seed base that is far from repeats and indels; what is before and behind the seed is aligned on its
own, outwards in, and the seed is summed over all flank bases.
"""

from __future__ import annotations

import itertools
import math
import operator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from . import kernels as k

# The chance of an indel after a run of 1 to 10 equal bases, its growth beyond, the longest run told
# apart, the price of going on with an indel and of opening one, and how many units stutter adds or removes at most.
RUN_INDEL = (2.9e-5, 2.9e-5, 2.9e-5, 2.9e-5, 4.3e-5, 1.1e-4, 2.4e-4, 5.7e-4, 1.0e-3, 1.4e-3)
RUN_SLOPE, RUN_MOST = 4.3e-4, 15
GO_ON, OPEN = -1.0, math.log(1 - math.exp(-1))
UNITS = 6
# Padding of a repeat, longest flank, least distance of two repeats, least distance of a seed.
PAD, FLANK, SPACING, SEED_LEAST = 5, 35, 10, 5
LOW = -1e9


@dataclass(frozen=True)
class Block:
    start: int
    end: int  # exclusive
    seqs: tuple[str, ...]  # the reference's first
    repeat: bool = False

    def reversed(self) -> Block:
        return Block(self.start, self.end, tuple(s[::-1] for s in self.seqs), self.repeat)


def reverse_blocks(blocks: list[Block]) -> list[Block]:
    return [b.reversed() for b in reversed(blocks)]


def haplotypes(blocks: list[Block]) -> list[tuple[int, ...]]:
    """All choices of sequences, the first block changing fastest; neighbours differ in one block (each block runs
    through its sequences to and fro)."""
    out: list[tuple[int, ...]] = [()]
    for b in reversed(blocks):
        n = len(b.seqs)
        out = [(x, *h) for i, h in enumerate(out) for x in (range(n) if i % 2 == 0 else range(n - 1, -1, -1))]
    return out


@lru_cache(maxsize=1)
def run_transitions() -> tuple[np.ndarray, np.ndarray]:
    """By length of the run of equal bases (0 is not used): log chance of an indel of either kind, and of none."""
    indel = np.zeros(RUN_MOST + 1)
    for n in range(1, RUN_MOST + 1):
        indel[n] = math.log(RUN_INDEL[n - 1]) if n <= len(RUN_INDEL) else math.log(RUN_INDEL[-1] + RUN_SLOPE * (n - len(RUN_INDEL)))
    stay = np.zeros(RUN_MOST + 1)
    stay[1:] = np.log(1 - 2 * np.exp(indel[1:]))
    return indel, stay


def run_lengths(parts: list[str]) -> list[list[int]]:
    """For each base of each part, the length of the run of equal bases it is in; a run that reaches the end of its
    part goes on into the next part that is not empty, but not beyond that."""
    ends = [(len(p) - len(p.lstrip(p[0])), len(p) - len(p.rstrip(p[-1]))) if p else (0, 0) for p in parts]
    out = []
    for b, part in enumerate(parts):
        left = next((x for x in range(b - 1, -1, -1) if parts[x]), None)
        right = next((x for x in range(b + 1, len(parts)) if parts[x]), None)
        lengths, i = [], 0
        while i < len(part):
            j = i
            while j < len(part) and part[j] == part[i]:
                j += 1
            n = j - i
            if i == 0 and left is not None and parts[left][-1] == part[0]:
                n += ends[left][1]
            if j == len(part) and right is not None and parts[right][0] == part[-1]:
                n += ends[right][0]
            lengths += [n] * (j - i)
            i = j
        out.append(lengths)
    return out


def lse_rows(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


class Emissions:
    """Sums of a read's base likelihoods along diagonals of a repeat, both read from their right ends."""

    def __init__(self, bases: np.ndarray, right: np.ndarray, wrong: np.ndarray, block: np.ndarray, period: int):
        n, length = len(bases), len(block)
        self.n, self.length, self.period, self.right = n, length, period, right
        flipped = block[::-1]
        self.at = np.where(bases[:, None] == flipped[None], right[:, None], wrong[:, None])
        self._sums: dict[int, np.ndarray] = {}
        self._unit: np.ndarray | None = None

    def diagonal(self, shift: int) -> np.ndarray:
        """[j, t]: bases j, j - 1, ... of the read, t of them, on the block's bases from `shift` on, counted from its
        right end; bases before the read's first count nothing."""
        if shift not in self._sums:
            t = self.length - shift
            out = np.zeros((self.n, t + 1))
            for r in range(t):
                out[:, r + 1] = out[:, r]
                out[r:, r + 1] += self.at[: max(0, self.n - r), r + shift]
            self._sums[shift] = out
        return self._sums[shift]

    def unit(self) -> np.ndarray:
        """[x, q]: one unit whose last base is x, against the block's bases from q on; where the block has none, a
        base counts as right."""
        if self._unit is None:
            out = np.zeros((self.n, max(self.length, 1)))
            for v in range(self.period):
                piece = np.repeat(self.right[:, None], out.shape[1], axis=1)
                if self.length > v:
                    piece[:, : self.length - v] = self.at[:, v:]
                out[v:] += piece[: max(0, self.n - v)]
            self._unit = out
        return self._unit


def stutter_rows(bases: np.ndarray, right: np.ndarray, wrong: np.ndarray, block: np.ndarray, period: int, units: int = UNITS) -> dict[int, np.ndarray]:
    """{step: for each base j, log likelihood of what ends at j and is as long as the block with that step, or reaches
    the read's start}; steps are in bases, and the place of the gained or lost units is summed over evenly."""
    e = Emissions(bases, right, wrong, block, period)
    n, length = e.n, e.length
    j = np.arange(n)
    plain = e.diagonal(0)
    out = {0: plain[j, np.minimum(length, j + 1)]}
    for lost in range(period, min(units * period, length) + 1, period):
        keep = length - lost
        moved, seen = e.diagonal(lost), np.minimum(keep, j + 1)
        place = np.minimum(np.arange(keep + 1)[None], seen[:, None])
        row = j[:, None]
        out[-lost] = lse_rows(plain[row, place] + moved[row, seen[:, None]] - moved[row, place]) - math.log(keep + 1)
    unit, place = e.unit(), np.arange(length + 1)
    most = max(0, length - period)
    for gained in range(period, units * period + 1, period):
        seen = np.minimum(length + gained, j + 1)
        at = np.minimum(place[None], np.minimum(np.maximum(0, seen - gained), most)[:, None])
        new = np.zeros(at.shape)
        for u in range(gained // period):
            x = j[:, None] - at - u * period
            new += np.where(x >= 0, unit[np.maximum(x, 0), np.minimum(at, unit.shape[1] - 1)], 0.0)
        before = j - gained
        rest = np.where(seen > gained, plain[np.maximum(before, 0), np.maximum(seen - gained, 0)], 0.0)[:, None]
        skipped = np.where((seen > gained)[:, None], plain[np.maximum(before, 0)[:, None], at], 0.0)
        out[gained] = lse_rows(plain[j[:, None], at] + new + rest - skipped) - math.log(length + 1)
    return out


def forward(parts: list[str], repeat: list[bool], bases: np.ndarray, right: np.ndarray, wrong: np.ndarray, period: int, model: dict[str, float]) -> np.ndarray:
    """For each base of the haplotype, log likelihood of the whole read with its last base there (best path in flanks,
    summed over stutter); within a repeat only its last base has one."""
    n, (indel, stay) = len(bases), run_transitions()
    total = np.cumsum(right)
    runs, slope = run_lengths(parts), total + GO_ON * np.arange(n)
    letters = [np.frombuffer(p.encode(), np.uint8) for p in parts]
    out = np.full(sum(map(len, parts)), LOW)
    emit = {int(c): np.where(bases == c, right, wrong) for p in letters for c in np.unique(p)}
    match = emit[int(letters[0][0])] + total - right
    gone = np.full(n, LOW)
    out[0], row, after_repeat = match[-1], 1, False
    for b, part in enumerate(letters):
        if repeat[b]:
            size, options = len(part), []
            for step, fit in stutter_rows(bases, right, wrong, part, period).items():
                seen = np.minimum(size + step, np.arange(n) + 1)
                before = np.arange(n) - seen
                start = np.where(before < 0, 0.0, match[np.maximum(before, 0)])
                options.append(fit + start + float(k.log_stutter(np.array(step), period, model)))
            match = lse_rows(np.stack(options, axis=1))
            gone = np.full(n, LOW)
            row += size
            out[row - 1] = match[-1]
            after_repeat = True
            continue
        for x in range(1 if b == 0 else 0, len(part)):
            here = emit[int(part[x])]
            now = here.copy()
            if after_repeat:  # a repeat is followed by a match
                now[1:] += match[:-1]
                lost, gained = np.full(n, LOW), None
                after_repeat = False
            else:
                h = min(RUN_MOST, max(runs[b][x], runs[b][max(0, x - 1)]))
                lost = np.maximum(match + OPEN, gone + GO_ON)
                opened = np.zeros(n)
                opened[1:] = match[:-1] + OPEN + right[1:] - slope[1:]
                gained = np.maximum.accumulate(opened) + slope
                now[1:] += np.maximum(np.maximum(gained[:-1] + indel[h], gone[:-1] + indel[h]), match[:-1] + stay[h])
            match, gone = now, lost
            out[row] = match[-1]
            row += 1
    return out


def quality_logs(quals: str) -> tuple[np.ndarray, np.ndarray]:
    q = np.frombuffer(quals.encode(), np.uint8).astype(float) - 33
    return np.log(1 - 10 ** (-np.clip(q, 1, 41) / 10)), np.log(10 ** (-np.clip(q, 0, 41) / 10) / 3)


def read_likelihoods(bases: str, quals: str, seed: int, blocks: list[Block], period: int, model: dict[str, float]) -> list[float]:
    """Log likelihood of a read given each haplotype, in the order of `haplotypes`. The seed is neither the first nor
    the last base; it lies on any flank base with equal chance, and on the outermost ones the rest hangs over."""
    letters = np.frombuffer(bases.upper().encode(), np.uint8)
    right, wrong = quality_logs(quals)
    repeat = [b.repeat for b in blocks]
    out = []
    before, behind = slice(0, seed), slice(len(bases) - 1, seed, -1)
    for choice in haplotypes(blocks):
        parts = [b.seqs[c] for b, c in zip(blocks, choice, strict=True)]
        left = forward(parts, repeat, letters[before], right[before], wrong[before], period, model)
        tail = forward([p[::-1] for p in reversed(parts)], repeat[::-1], letters[behind], right[behind], wrong[behind], period, model)[::-1]
        hap = np.frombuffer("".join(parts).encode(), np.uint8)
        flank = np.concatenate([np.full(len(p), not r) for p, r in zip(parts, repeat, strict=True)])
        seeded = np.where(hap == letters[seed], right[seed], wrong[seed])
        fit = np.full(len(hap), LOW)
        fit[1:-1] = left[:-2] + tail[2:]
        fit[0] = right[before].sum() + tail[1]
        fit[-1] = right[behind].sum() + left[-2]
        out.append(k.lse((seeded + fit)[flank]) - math.log(int(flank.sum())))
    return out


def best_seed(pos: int, cigar: list[tuple[str, int]], blocks: list[Block], n: int) -> int | None:
    """The base of the read that is farthest from indels, mismatches (cigar of =, X, I, D), repeats and the ends of the
    haplotypes, the last of equal ones; None if none is SEED_LEAST away, or if it is the first or last base."""
    free = [(b.start, b.end) for b in blocks if not b.repeat]
    best, least, base = None, SEED_LEAST, 0
    for op, m in cigar:
        if op == "=":
            for low, high in ((max(pos, a), min(pos + m, z)) for a, z in free):
                away = 1 + (high - 1 - low) // 2
                if low < high and away >= least:
                    best, least = base + low + away - 1 - pos, away
        if op in "=XI":
            base += m
        if op in "=XD":
            pos += m
    return best if best is not None and 0 < best < n - 1 else None


def matching_cigar(cigar: list[tuple[str, int]], bases: str, pos: int, ref: str, ref_start: int) -> tuple[str, list[tuple[str, int]]]:
    """The read without clipped bases, and its CIGAR with = and X for M; ref covers the alignment."""
    kept, at, base = [], pos - ref_start, 0
    out: list[tuple[str, int]] = []

    def put(op: str, n: int) -> None:
        if out and out[-1][0] == op:
            out[-1] = op, out[-1][1] + n
        elif n:
            out.append((op, n))

    for op, m in cigar:
        if op in "M=X":
            own, other = bases[base : base + m].upper(), ref[at : at + m].upper()
            if len(own) != len(other):
                raise ValueError("the reference does not cover the alignment")
            if own == other:
                put("=", len(own))
            else:
                for same, run in itertools.groupby(map(operator.eq, own, other)):
                    put("=" if same else "X", sum(1 for _ in run))
        elif op in "ID":
            put(op, m)
        if op in "M=XI":
            kept.append(bases[base : base + m])
        at += m if op in "M=XDN" else 0
        base += m if op in "M=XIS" else 0
    return "".join(kept), out


def trim_candidates(seqs: list[str], least: int, pad: int = PAD) -> tuple[int, int, list[str]]:
    """(left, right, rest): what all candidates share at their ends goes, up to the padding and as evenly as possible,
    but the shortest keeps `least` bases."""
    short = min(map(len, seqs))
    spare = short - least
    if spare <= 0:
        return 0, 0, list(seqs)

    def common(texts: list[str]) -> int:
        n = next((i for i, col in enumerate(zip(*texts)) if len(set(col)) > 1), short)
        return max(0, min(n, spare, pad, short - pad))

    left, right = common(seqs), common([s[::-1] for s in seqs])
    over = left + right - spare
    if over > 0:
        even = min(left, right)
        if 2 * even >= spare:  # both can give half; the right one gives less of an odd number
            left, right = spare - spare // 2, spare // 2
        else:
            left, right = (spare - right, right) if left > right else (left, spare - left)
    return left, right, [s[left : len(s) - right] for s in seqs]


def repeat_block(start: int, stop: int, period: int, ref: str, ref_start: int, alleles: list[str]) -> Block:
    """The block of a repeat from candidates that cover it and PAD bases on each side; the reference's comes first, the
    others by length and letters."""
    low, high = start - PAD, stop + PAD
    own = ref[low - ref_start : high - ref_start].upper()
    seqs = [own, *sorted({a.upper() for a in alleles} - {own}, key=lambda s: (len(s), s))]
    left, right, rest = trim_candidates(seqs, 3 * period)
    return Block(low + left, high - right, tuple(rest), True)


def fuse_blocks(repeats: list[Block], ref: str, ref_start: int, first: int, last: int) -> list[Block] | None:
    """Repeats with flanks between and around them, these from 10 to FLANK bases as far as reads (first to last) reach;
    None where two repeats are too near to one another or the reference is too short."""
    if any(b.start < a.end + SPACING for a, b in zip(repeats, repeats[1:])):
        return None
    low = min(repeats[0].start - 10, max(repeats[0].start - FLANK, first))
    high = max(repeats[-1].end + 10, min(repeats[-1].end + FLANK, last))
    if low < ref_start or high > ref_start + len(ref):
        return None
    out, at = [], low
    for b in [*repeats, Block(high, high, ("",))]:
        out.append(Block(at, b.start, (ref[at - ref_start : b.start - ref_start].upper(),)))
        if b.repeat:
            out.append(b)
        at = b.end
    return out
