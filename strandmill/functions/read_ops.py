"""Operations on one read: positions along its CIGAR, trimming, adapters, ends against the reference.

A CIGAR is a list of (op, length); = and X count as M. Positions are 0-based on the reference.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# The first bases of common adapters, and how they are found.
ADAPTERS = {1: ("AGATCGGAAGAGCAC", "CTGTCTCTTATACAC"), 2: ("AGATCGGAAGAGCGT", "CTGTCTCTTATACAC")}
ADAPTER_OVERLAP, ADAPTER_ERRORS = 5, 0.15

MATCH, ON_READ, ON_REF = "M=X", "M=XIS", "M=XDN"


@dataclass(frozen=True)
class Read:
    pos: int
    cigar: tuple[tuple[str, int], ...]
    bases: str
    quals: str

    @property
    def end(self) -> int:
        return self.pos + sum(n for op, n in self.cigar if op in ON_REF)


def length_change(read: Read, start: int, end: int) -> int | None:
    """Inserted less deleted bases between the matches that bracket [start, end]; None where the read doesn't."""
    if start < read.pos or end >= read.end:
        return None
    at, blocks, indels = read.pos, [], []
    for op, n in read.cigar:
        if op in MATCH:
            blocks.append((at, at + n))
        elif op in "ID":
            indels.append((at, at + (n if op == "D" else 0), n if op == "I" else -n))
        if op in ON_REF:
            at += n
    left = [b for b in blocks if b[0] < start or b[0] == read.pos == start]
    right = [b for b in blocks if b[1] > end]
    if not left or not right:
        return None
    return sum(d for a, b, d in indels if a >= left[-1][1] and b <= right[0][0])


def distance_to_indel(cigar) -> tuple[int, int]:
    """Matched bases before the first indel from either end; -1 where there is none."""

    def walk(ops) -> int:
        n = 0
        for op, k in ops:
            if op in "ID":
                return n
            if op in MATCH:
                n += k
        return -1

    return walk(cigar), walk(reversed(cigar))


def _drop_left(cigar, n: int) -> tuple[list, int, int]:
    """The CIGAR without n bases of the read (and deletions then in front), reference bases and clipped ones gone."""
    ops, moved, left = [list(x) for x in cigar], 0, n
    while ops and (left > 0 or ops[0][0] in "DN" or ops[0][0] == "H"):
        op, k = ops[0]
        if op in ON_READ:
            used = min(left, k)
            if op in ON_REF:
                moved += used
            left -= used
            ops[0][1] -= used
            if ops[0][1]:
                break
        elif op in ON_REF:
            moved += k
        ops.pop(0)
    return ops, moved, n - left


def trim(read: Read, left: int, right: int) -> Read:
    """Without so many bases at each end; a deletion laid bare goes too. Nothing is left of a read trimmed whole."""
    if left + right >= len(read.bases):
        return Read(read.pos, (), "", "")
    ops, moved, _ = _drop_left(read.cigar, left) if left else (list(read.cigar), 0, 0)
    if right:
        ops = _drop_left(list(reversed(ops)), right)[0][::-1]
    stop = len(read.bases) - right
    return Read(read.pos + moved, tuple((op, n) for op, n in ops), read.bases[left:stop], read.quals[left:stop])


def ends_beyond(read: Read, low: int, high: int) -> tuple[int, int]:
    """How many bases at each end lie beyond [low, high] of the reference."""
    at, seen, left, right = read.pos, 0, 0, 0
    for op, n in read.cigar:
        if op in ON_READ and op in ON_REF:
            left = max(left, seen + min(n, max(0, low - at)) if at < low else left)
            if at + n - 1 > high:
                right = max(right, len(read.bases) - seen - max(0, high + 1 - at))
        elif op in ON_READ:
            if at <= low and at > read.pos:
                left = max(left, seen + n)
            if at > high:
                right = max(right, len(read.bases) - seen)
        if op in ON_READ:
            seen += n
        if op in ON_REF:
            at += n
    return left, right


def trim_to(read: Read, low: int, high: int) -> Read:
    """The part of the read that lies on [low, high] of the reference."""
    return trim(read, *ends_beyond(read, low, high))


def adapter_start(bases: str, adapters=ADAPTERS[1], overlap: int = ADAPTER_OVERLAP, errors: float = ADAPTER_ERRORS) -> int | None:
    """Where the read runs into an adapter: the first place from which its bases agree with the adapter's start, with
    one mismatch at most where that is a small enough share."""
    for at in range(len(bases) - overlap + 1):
        for adapter in adapters:
            n = min(len(adapter), len(bases) - at)
            wrong = sum(a != b for a, b in zip(bases[at : at + n], adapter, strict=False))
            if wrong == 0 or (wrong == 1 and wrong / n < errors):
                return at
    return None


#: Of each mate's adapters by length: how many mismatches may be, and both halves, of which one agrees if one base differs.
_HALVES = {m: [(a, [(n, 1 / n < ADAPTER_ERRORS, a[: n // 2], a[n // 2 : n], a[:n]) for n in range(len(a) - 1, ADAPTER_OVERLAP - 1, -1)]) for a in own] for m, own in ADAPTERS.items()}


def first_adapter(bases: str, mate: int) -> int | None:
    """As `adapter_start` for the mate's adapters, by looking for halves of an adapter first."""
    best = None
    for adapter, ends in _HALVES[mate]:
        size = len(adapter)
        for from_, half in ((0, adapter[: size // 2]), (size // 2, adapter[size // 2 :])):
            found = bases.find(half, from_)
            while found >= 0 and (best is None or found - from_ < best):
                at = found - from_
                if at + size <= len(bases) and sum(a != b for a, b in zip(bases[at : at + size], adapter, strict=True)) <= 1:
                    best = at
                    break
                found = bases.find(half, found + 1)
        for n, loose, head, tail, whole in ends:
            at = len(bases) - n
            if at < 0:
                continue
            if best is not None and at >= best:
                break
            if bases.endswith(whole) or (loose and (bases.startswith(head, at) or bases.endswith(tail)) and sum(a != b for a, b in zip(bases[at:], whole, strict=True)) <= 1):
                best = at
                break
    return best


def complement(seq: str) -> str:
    return seq.translate(str.maketrans("ACGTacgt", "TGCATGCA"))[::-1]


def trim_adapter(read: Read, mate: int, reverse: bool) -> Read:
    """Cuts an adapter off the end that was sequenced last: the left one of reads on the reverse strand."""
    seq = complement(read.bases) if reverse else read.bases
    at = adapter_start(seq, ADAPTERS[mate])
    if at is None:
        return read
    cut = len(seq) - at
    return trim(read, cut, 0) if reverse else trim(read, 0, cut)


def matches_at_ends(read: Read, ref: str, ref_start: int) -> tuple[int, int]:
    """Bases from either end that agree with the reference without a gap; clipped ends count as zero."""

    def walk(r: Read, window: str, start: int) -> int:
        if not r.cigar or r.cigar[0][0] not in MATCH:
            return 0
        n = 0
        for a, b in zip(r.bases[: r.cigar[0][1]], window[r.pos - start :], strict=False):
            if a.upper() != b.upper():
                break
            n += 1
        return n

    turned = replace(read, pos=0, cigar=read.cigar[::-1], bases=read.bases[::-1])
    tail = ref[: read.end - ref_start][::-1]
    return walk(read, ref, ref_start), walk(turned, tail, 0)


def largest_end_matches(read: Read, ref: str, ref_start: int, reach: int = 15) -> bool:
    """Whether no shift of either end by up to reach bases agrees with the reference further than its place does."""
    left, right = matches_at_ends(read, ref, ref_start)

    def agree(a: str, b: str) -> int:
        n = 0
        while n < min(len(a), len(b)) and a[n].upper() == b[n].upper():
            n += 1
        return n

    for shift in range(-reach, reach + 1):
        if shift:
            a = read.pos - ref_start + shift
            if 0 <= a < len(ref) and agree(read.bases, ref[a:]) > left:
                return False
            b = read.end - ref_start + shift
            if 0 < b <= len(ref) and agree(read.bases[::-1], ref[:b][::-1]) > right:
                return False
    return True


def unclipped(read: Read) -> tuple[int, int, str]:
    """Start, end and bases without soft clips."""
    left = read.cigar[0][1] if read.cigar and read.cigar[0][0] == "S" else 0
    right = read.cigar[-1][1] if len(read.cigar) > 1 and read.cigar[-1][0] == "S" else 0
    return read.pos, read.end, read.bases[left : len(read.bases) - right]


def sequence_between(read: Read, start: int, end: int) -> str | None:
    """Bases of the read on [start, end), with insertions at its end; None where the read doesn't reach both sides."""
    if read.pos > start or read.end < end:
        return None
    at, seen, out = read.pos, 0, []
    for op, n in read.cigar:
        if op in MATCH:
            a, b = max(at, start), min(at + n, end)
            if a < b:
                out.append(read.bases[seen + a - at : seen + b - at])
        elif op == "I" and start < at <= end:
            out.append(read.bases[seen : seen + n])
        if op in ON_READ:
            seen += n
        if op in ON_REF:
            at += n
    return "".join(out)
