"""Numpy kernels for what has no relational form: they see one locus or one read at a time."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np

# The stutter EM's start, its pseudocounts and when it stops.
EM_START = {"in_geom": 0.9, "in_up": 0.1, "in_down": 0.1, "out_geom": 0.8, "out_up": 0.01, "out_down": 0.01}
EM_ROUNDS, EM_ABS, EM_FRACTION, EM_STEP = 100, 0.01, 0.001, 1e-4


def lse(x: np.ndarray, axis=None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    out = top + np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True))
    return np.squeeze(out, axis=axis) if axis is not None else float(out.ravel()[0])


def log_stutter(diff: np.ndarray, period: int, m: dict[str, float]) -> np.ndarray:
    diff = np.asarray(diff)
    whole = np.trunc(diff / period).astype(int)
    frame = diff - whole * period == 0

    def part(kind: str, steps: np.ndarray) -> np.ndarray:
        side = np.where(diff > 0, math.log(m[f"{kind}_up"]), math.log(m[f"{kind}_down"]))
        return side + math.log(m[f"{kind}_geom"]) + (steps - 1) * math.log(1 - m[f"{kind}_geom"])

    same = math.log(1 - m["in_up"] - m["in_down"] - m["out_up"] - m["out_down"])
    return np.where(diff == 0, same, np.where(frame, part("in", np.abs(whole)), part("out", np.abs(diff - whole))))


def learn_stutter(diffs: np.ndarray, sample: np.ndarray, period: int, p1: np.ndarray | None = None, p2: np.ndarray | None = None, haploid: bool = False, n: np.ndarray | None = None) -> dict | None:
    """EM over reads' length differences from the reference; None where it does not settle. n: how many equal reads a
    row stands for.

    Where the likelihood falls, the model that it was measured with holds; where it or the model settles, the last
    one estimated.

    The likelihood of reads given genotypes mixes both haplotypes by the reads' phase likelihoods; the model is
    re-estimated from the expected numbers and sizes of in-frame and out-of-frame steps.
    """
    diffs, (names, sample) = np.asarray(diffs, int), np.unique(sample, return_inverse=True)
    times = np.ones(len(diffs)) if n is None else np.asarray(n, float)
    half = math.log(0.5)
    p1 = np.zeros(len(diffs)) if p1 is None else np.asarray(p1)
    p2 = np.zeros(len(diffs)) if p2 is None else np.asarray(p2)
    alleles = np.array([0, *sorted(set(diffs.tolist()) - {0})])
    number = {a: k for k, a in enumerate(alleles)}
    weight = np.ones(len(alleles))
    per_sample = np.bincount(sample, times)
    np.add.at(weight, [number[d] for d in diffs.tolist()], times / per_sample[sample])
    prior, model, last = np.log(weight / weight.sum()), dict(EM_START), -np.inf
    step = diffs[:, None] - alleles[None]
    whole = np.trunc(step / period).astype(int)
    frame = step - whole * period == 0
    for _ in range(EM_ROUNDS):
        like = log_stutter(step, period, model)
        first, second = half + p1[:, None] + like, half + p2[:, None] + like
        both = np.logaddexp(first[:, :, None], second[:, None, :])
        joint = prior[:, None] + prior[None] + np.zeros((len(names), 1, 1))
        np.add.at(joint, sample, both * times[:, None, None])
        if haploid:
            joint[:, ~np.eye(len(alleles), dtype=bool)] = -1e300
        total = lse(joint.reshape(len(names), -1), axis=1)
        post, now = joint - total[:, None, None], float(total.sum())
        mass = np.exp(post).sum(0)
        prior = np.log(np.maximum((mass.sum(0) + mass.sum(1)) / (2 * len(names)), 1e-300))
        w1 = np.exp(post[sample] + first[:, :, None] - both).sum(2)
        w2 = np.exp(post[sample] + second[:, None, :] - both).sum(1)
        w = (w1 + w2) * times[:, None]
        up, down = step > 0, step < 0
        in_up, in_down = w[frame & up].sum() + 1, w[frame & down].sum() + 1
        out_up, out_down = w[~frame & up].sum() + 1, w[~frame & down].sum() + 1
        in_eq = w[step == 0].sum() + 1
        in_size = (w * np.abs(whole))[frame].sum() + 2.1
        out_size = (w * np.abs(step - whole))[~frame].sum() + 2.1
        seen = in_up + in_down + in_eq + out_up + out_down
        new = {
            "in_geom": min(0.999, (in_up + in_down) / in_size), "in_up": in_up / seen, "in_down": in_down / seen,
            "out_geom": min(0.999, (out_up + out_down) / out_size), "out_up": out_up / seen, "out_down": out_down / seen,
        }
        if now < last + 1e-10:
            return model
        if (now - last < EM_ABS and (last - now) / last < EM_FRACTION) or all(abs(new[k] - model[k]) < EM_STEP for k in new):
            return new
        model, last = new, now
    return None


def learn_stutter_many(alleles: np.ndarray, counts: np.ndarray, present: np.ndarray, period: np.ndarray) -> list[dict | None]:
    """`learn_stutter` without phases for many loci that have equally many alleles, all rounds of all loci together;
    a locus that has settled leaves.

    alleles: [locus, allele], the length difference of each, 0 first, none twice. counts: [locus, sample, allele], how
    many reads of the sample have it. present: [locus, sample], whether there is such a sample.
    """
    n_loci, n = alleles.shape
    out: list[dict | None] = [None] * n_loci
    keys = ("in_geom", "in_up", "in_down", "out_geom", "out_up", "out_down")
    counts, people = np.asarray(counts, float), present.sum(1)
    depth = counts.sum(2)
    weight = 1 + (counts / np.where(depth > 0, depth, 1)[:, :, None]).sum(1)
    prior = np.log(weight / weight.sum(1, keepdims=True))
    step = alleles[:, :, None] - alleles[:, None, :]  # [locus, difference read, allele]
    whole = np.trunc(step / period[:, None, None]).astype(int)
    frame, up = step - whole * period[:, None, None] == 0, step > 0
    kind = np.where(step == 0, 0, np.where(frame, np.where(up, 1, 2), np.where(up, 3, 4)))
    size = np.where(frame, np.abs(whole), np.abs(step - whole)).astype(float)
    of_kind = (kind[:, None] == np.arange(5)[None, :, None, None]).reshape(n_loci, 5, n * n).astype(float)
    flat, size = kind.reshape(n_loci, -1), size.reshape(n_loci, -1)
    model, last, at = np.tile([EM_START[c] for c in keys], (n_loci, 1)), np.full(n_loci, -np.inf), np.arange(n_loci)
    # Genotypes are unordered here: post is that of either order, `ways` how many there are, `within` their alleles.
    one, two = np.triu_indices(n)
    ways, within = np.where(one == two, 1.0, 2.0), np.zeros((len(one), n))
    within[np.arange(len(one)), one] = within[np.arange(len(one)), two] = 1
    # beyond so many steps, chances of the least likely ones would vanish before they are added
    spread = size.max() > 80

    def give(done: np.ndarray, values: np.ndarray) -> None:
        for i in np.flatnonzero(done):
            out[at[i]] = dict(zip(keys, values[i].tolist(), strict=True))

    for _ in range(EM_ROUNDS):
        in_geom, in_up, in_down, out_geom, out_up, out_down = model.T
        same = np.log(1 - in_up - in_down - out_up - out_down)
        first = np.stack([same, *(np.log(x) + np.log(g) for x, g in ((in_up, in_geom), (in_down, in_geom), (out_up, out_geom), (out_down, out_geom)))], axis=1)
        more = np.stack([np.zeros(len(at)), *(np.log(1 - g) for g in (in_geom, in_geom, out_geom, out_geom))], axis=1)
        like = (np.take_along_axis(first, flat, 1) + (size - 1) * np.take_along_axis(more, flat, 1)).reshape(-1, n, n)
        if spread:
            both = np.logaddexp(like[:, :, one], like[:, :, two])
        else:
            top = like.max(2)
            chance = np.exp(like - top[:, :, None])
            pair = chance[:, :, one] + chance[:, :, two]
            both = np.log(pair)
            both += top[:, :, None]
        joint = (prior[:, one] + prior[:, two])[:, None] + counts @ both + math.log(0.5) * counts.sum(2, keepdims=True)
        most = joint.max(2, keepdims=True)
        post = np.exp(joint - most)
        total = (post @ ways)[:, :, None]
        now = ((np.log(total) + most)[:, :, 0] * present).sum(1)
        post *= present[:, :, None] / total
        prior = np.log(np.maximum(post.sum(1) @ within / people[:, None], 1e-300))
        held = counts.transpose(0, 2, 1) @ post
        if spread:
            w = np.zeros(like.shape)
            for x in range(n):
                with_x = np.flatnonzero(within[:, x])
                w[:, :, x] = (held[:, :, with_x] * np.exp(like[:, :, x, None] - both[:, :, with_x])).sum(2)
        else:
            w = chance * ((held / pair) @ within)
        w = 2 * w.reshape(-1, n * n)
        by_kind = (of_kind @ w[:, :, None])[:, :, 0]
        sized = (of_kind @ (w * size)[:, :, None])[:, :, 0]
        in_eq, in_up, in_down, out_up, out_down = by_kind.T + 1
        seen = in_up + in_down + in_eq + out_up + out_down
        new = np.stack([np.minimum(0.999, (in_up + in_down) / (sized[:, 1] + sized[:, 2] + 2.1)), in_up / seen, in_down / seen, np.minimum(0.999, (out_up + out_down) / (sized[:, 3] + sized[:, 4] + 2.1)), out_up / seen, out_down / seen], axis=1)
        fell = now < last + 1e-10
        with np.errstate(invalid="ignore"):
            settled = ~fell & (((now - last < EM_ABS) & ((last - now) / last < EM_FRACTION)) | (np.abs(new - model) < EM_STEP).all(1))
        give(fell, model)
        give(settled, new)
        stay = ~(fell | settled)
        if not stay.any():
            break
        model, last = new, now
        if not stay.all():
            at, model, last, prior, counts, present, people, flat, size, of_kind = (x[stay] for x in (at, model, last, prior, counts, present, people, flat, size, of_kind))
    return out


def align(read: str, ref: str, match: float = 2.0, mismatch: float = -2.0, gap_open: float = 5.0, gap_extend: float = 0.125, free_ref_ends: bool = True) -> tuple[float, str]:
    """Affine-gap alignment of the whole read to the reference: score and a CIGAR of =, X, I and D.

    N matches any base. With free_ref_ends what the reference has before and after the read costs nothing and is
    not in the CIGAR; the leftmost of equal ends is taken, and a match before a gap.
    """
    n, m = len(read), len(ref)
    a, b = np.frombuffer(read.upper().encode(), np.uint8), np.frombuffer(ref.upper().encode(), np.uint8)
    low = -1e30
    best = np.full((3, n + 1, m + 1), low)  # match, insertion (read only), deletion (reference only)
    come = np.zeros((3, n + 1, m + 1), np.int8)
    best[0, 0, 0] = 0
    if free_ref_ends:
        best[0, 0, :] = 0
    else:
        best[2, 0, 1:] = -gap_open - gap_extend * np.arange(m)
        come[2, 0, 2:] = 2
    slope = gap_extend * np.arange(m)
    for i in range(1, n + 1):
        gain = np.where((b == a[i - 1]) | (a[i - 1] == 78) | (b == 78), match, mismatch)
        stack = best[:, i - 1, :-1]
        come[0, i, 1:] = stack.argmax(0)
        best[0, i, 1:] = stack.max(0) + gain
        up = np.stack([best[0, i - 1] - gap_open, best[1, i - 1] - gap_extend, best[2, i - 1] - gap_open])
        come[1, i] = up.argmax(0)
        best[1, i] = up.max(0)
        opened = best[:2, i, :-1].max(0) - gap_open
        best[2, i, 1:] = np.maximum.accumulate(opened + slope) - slope
        come[2, i, 1:] = np.stack([best[0, i, :-1] - gap_open, best[1, i, :-1] - gap_open, best[2, i, :-1] - gap_extend]).argmax(0)
    j = int(best[:2, n].max(0).argmax()) if free_ref_ends else m
    state = int(best[:, n, j].argmax()) if not free_ref_ends else int(best[:2, n, j].argmax())
    score, i, ops = float(best[state, n, j]), n, []
    while i > 0 or (j > 0 and not free_ref_ends):
        before = int(come[state, i, j])
        if state == 0:
            ops.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
        elif state == 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
        state = before
    return score, run_lengths(reversed(ops))


def align_on_diagonals(reads: list[str], refs: list[str], match: float = 2.0, mismatch: float = -2.0, gap_open: float = 5.0, gap_extend: float = 0.125, rows: int = 2048) -> list[tuple[float, str] | None]:
    """`align` (with free ends of the reference) of the pairs whose best alignment lies on one diagonal, or on two that
    one deletion links with every base equal; None for all others, which `align` has to settle.

    Both kinds are scored in full. A pair counts as settled only if its best score is above what any other alignment
    could have (a gap and a mismatch, an inserted base, two gaps) and only one kind has it. Of equal ends the leftmost
    is taken and the deletion stands as far left as it can, as there.
    """
    out: list[tuple[float, str] | None] = [None] * len(reads)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(reads, refs, strict=True)):
        if 0 < len(a) <= len(b) and a.isascii() and b.isascii() and gap_extend > 0 and match > mismatch:
            groups.setdefault((len(a), len(b)), []).append(i)
    for (n, m), members in groups.items():
        least = max(n * match - gap_open - (match - mismatch), (n - 1) * match - gap_open, n * match - 2 * gap_open)
        for low in range(0, len(members), rows):
            own = members[low : low + rows]
            a = np.frombuffer("".join(reads[i] for i in own).upper().encode(), np.uint8).reshape(-1, n)
            b = np.frombuffer("".join(refs[i] for i in own).upper().encode(), np.uint8).reshape(-1, m)
            equal = np.lib.stride_tricks.sliding_window_view(b, n, axis=1) == a[:, None]  # [pair, diagonal, base]
            wrong = n - equal.sum(2)
            at = wrong.argmin(1)
            k = wrong[np.arange(len(own)), at]
            plain = n * match - (match - mismatch) * k
            before = np.where(wrong > 0, equal.argmin(2), n)
            behind = np.where(wrong > 0, equal[:, :, ::-1].argmin(2), n)
            gap, to = np.zeros(len(own), int), np.zeros(len(own), int)
            for d in range(1, m - n + 1):
                if n * match - gap_open - gap_extend * (d - 1) <= least:
                    break
                fits = before[:, :-d] + behind[:, d:] >= n
                new = (gap == 0) & (k > 0) & fits.any(1)
                gap[new], to[new] = d, fits[new].argmax(1) + d
            linked = np.where(gap > 0, n * match - gap_open - gap_extend * (gap - 1), -np.inf)
            known = (np.maximum(plain, linked) > least) & (plain != linked) & ~((a == 78).any(1) | (b == 78).any(1))
            for r in np.flatnonzero(known).tolist():
                if linked[r] > plain[r]:
                    s = n - int(behind[r, to[r]])
                    out[own[r]] = float(linked[r]), f"{s}={gap[r]}D{n - s}="
                else:
                    runs = "".join("=" if x else "X" for x in equal[r, at[r]].tolist()) if k[r] else None
                    out[own[r]] = float(plain[r]), run_lengths(runs) if runs else f"{n}="
    return out


def run_lengths(ops) -> str:
    out: list[list] = []
    for op in ops:
        if out and out[-1][1] == op:
            out[-1][0] += 1
        else:
            out.append([1, op])
    return "".join(f"{n}{op}" for n, op in out)


def unordered(a: int, b: int) -> int:
    a, b = min(a, b), max(a, b)
    return b * (b + 1) // 2 + a


@lru_cache(maxsize=8)
def inheritance(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a child's genotype comes from its parents' (each by pair number): without a mutation [mother, father, child],
    and with one to allele k that the parents lack, or have [mother, father, k, child].

    Four inheritance patterns of equal chance; a mutation turns one inherited allele to any other with equal chance.
    """
    pairs = [(a, b) for b in range(n) for a in range(b + 1)]
    none = np.zeros((len(pairs),) * 3)
    new, known = (np.zeros((len(pairs), len(pairs), n, len(pairs))) for _ in range(2))
    mutation = 0.5 / (n - 1) / 4 if n > 1 else 0.0
    for i, mother in enumerate(pairs):
        for j, father in enumerate(pairs):
            for x in mother:
                for y in father:
                    none[i, j, unordered(x, y)] += 0.25
                    for k in range(n):
                        to = known if k in mother + father else new
                        if k != x:
                            to[i, j, k, unordered(k, y)] += mutation
                        if k != y:
                            to[i, j, k, unordered(x, k)] += mutation
    return none, new, known


def de_novo_trios(mother: np.ndarray, father: np.ndarray, child: np.ndarray, log_freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 likelihoods of trios, a row each: without a mutation, and by allele with one that is new to the family or
    not. Genotype likelihoods are log10, unordered (index b (b + 1) / 2 + a); parents by Hardy-Weinberg."""
    n = log_freq.shape[1]
    b, a = np.array([(b, a) for b in range(n) for a in range(b + 1)]).T
    chance = 10 ** (log_freq[:, a] + log_freq[:, b]) * np.where(a == b, 1, 2)
    top = [x.max(axis=1, keepdims=True) for x in (mother, father, child)]
    m, f, c = (10 ** (x - t) for x, t in zip((mother, father, child), top, strict=True))
    m, f = m * chance, f * chance
    base = sum(top)
    with np.errstate(divide="ignore"):
        return tuple(np.log10(np.einsum(how, m, f, t, c, optimize=True).reshape(len(m), -1)) + base for how, t in zip(("rm,rf,mfc,rc->r", "rm,rf,mfkc,rc->rk", "rm,rf,mfkc,rc->rk"), inheritance(n), strict=True))


def de_novo_trio(mother: np.ndarray, father: np.ndarray, child: np.ndarray, log_freq: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """One trio of `de_novo_trios`."""
    none, new, other = de_novo_trios(*(np.asarray(x, float)[None] for x in (mother, father, child, log_freq)))
    return float(none[0, 0]), new[0], other[0]


def trim_by_quality(bases: str, quals: str, least: str = "5") -> tuple[int, int]:
    """How many bases of quality below `least` stand at the read's start and end."""
    left = 0
    while left < len(quals) and quals[left] < least:
        left += 1
    right = 0
    while right < len(quals) - left and quals[len(quals) - 1 - right] < least:
        right += 1
    return left, right


def end_matches(bases: str, ref: str) -> tuple[int, int]:
    """Lengths of the common prefix and suffix, whatever the case."""
    a, b = bases.upper(), ref.upper()
    n = min(len(a), len(b))
    left = next((k for k in range(n) if a[k] != b[k]), n)
    right = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    return left, right


def z_array(text: str) -> list[int]:
    """For each position, how long what follows agrees with the text's start."""
    z, left, right = [0] * len(text), 0, 0
    if text:
        z[0] = len(text)
    for i in range(1, len(text)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(text) and text[k] == text[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def prefix_matches(pattern: str, text: str) -> list[int]:
    """For each position of text, how long what follows agrees with pattern, whatever the case."""
    return z_array(pattern.upper() + "\0" + text.upper())[len(pattern) + 1 :]


def suffix_matches(pattern: str, text: str) -> list[int]:
    return prefix_matches(pattern[::-1], text[::-1])[::-1]


def bases_at(cigar: list[tuple[str, int]], bases: str, quals: str, pos: int, at: list[int]) -> list[tuple[str, str]]:
    """(base, quality) of the read at reference positions; '-' where it has a deletion there or does not reach."""
    found: dict[int, int] = {}
    ref, read = pos, 0
    for op, n in cigar:
        if op in "M=X":
            for k in range(n):
                found[ref + k] = read + k
        if op in "M=XDN":
            ref += n
        if op in "M=XIS":
            read += n
    return [(bases[found[p]], quals[found[p]]) if p in found else ("-", "-") for p in at]


class DeBruijn:
    """k-mers as nodes, (k + 1)-mers as weighted edges."""

    def __init__(self, k: int, ref: str):
        self.k, self.edges = k, Counter()
        self.source, self.sink = ref[:k], ref[-k:]
        self.add(ref)

    def add(self, seq: str, weight: int = 1) -> None:
        n = self.k + 1
        new = [seq[i : i + n] for i in range(len(seq) - self.k)]
        if weight == 1:
            self.edges.update(new)
        else:
            for e in new:
                self.edges[e] += weight

    def prune(self, least: float) -> None:
        self.edges = Counter({e: w for e, w in self.edges.items() if w >= least})

    @classmethod
    def pruned(cls, k: int, ref: str, seqs: list[str], weights: list[int], least: float) -> DeBruijn:
        """The graph of ref and all sequences after prune(least)."""
        graph = cls(k, ref)
        edges = heavy_windows([ref, *seqs], [1, *weights], k + 1, least)
        if edges is None:
            for seq, w in zip(seqs, weights, strict=True):
                graph.add(seq, w)
            graph.prune(least)
        else:
            graph.edges = Counter(edges)
        return graph

    def after(self) -> dict[str, list[tuple[str, int]]]:
        out: dict[str, list] = {}
        for e in sorted(self.edges):
            out.setdefault(e[:-1], []).append((e[1:], self.edges[e]))
        return out

    def is_cyclic(self) -> bool:
        degree: dict[str, int] = {}
        after: dict[str, list[str]] = {}
        for e in self.edges:
            a, b = e[:-1], e[1:]
            after.setdefault(a, []).append(b)
            degree[b] = degree.get(b, 0) + 1
            degree.setdefault(a, 0)
        free, seen = [n for n, d in degree.items() if not d], 0
        while free:
            n = free.pop()
            seen += 1
            for b in after.get(n, ()):
                degree[b] -= 1
                if not degree[b]:
                    free.append(b)
        return seen < len(degree)

    def to_sink(self) -> set[str]:
        """The nodes from which the sink can be reached."""
        before: dict[str, list[str]] = {}
        for e in self.edges:
            before.setdefault(e[1:], []).append(e[:-1])
        found, open_ = {self.sink}, [self.sink]
        while open_:
            new = [a for a in before.get(open_.pop(), ()) if a not in found]
            found.update(new)
            open_ += new
        return found

    def paths(self, most: int = 10) -> list[tuple[str, int]]:
        """Up to `most` paths from source to sink, those of the largest smallest edge first: (sequence, that edge).
        What does not lead to the sink is not followed."""
        import heapq

        live = self.to_sink()
        if self.source not in live:
            return []
        after, out, order = self.after(), [], 0
        heap = [(-(1 << 60), 0, self.source, self.source)]
        while heap and len(out) < most:
            low, _, node, seq = heapq.heappop(heap)
            if node == self.sink:
                out.append((seq, -low))
                continue
            for b, w in after.get(node, ()):
                if b in live:
                    order += 1
                    heapq.heappush(heap, (max(low, -w), order, b, seq + b[-1]))
        return out


def heavy_windows(seqs: list[str], weights: list[int], n: int, least: float) -> dict[str, int] | None:
    """Substrings of length n whose weights sum to `least` at least; None if they don't fit 63 bits each."""
    text = "".join(seqs)
    if not text.isascii():
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    code = np.cumsum(np.bincount(raw, minlength=128) > 0) - 1
    bits = max(1, int(code[-1]).bit_length())
    if n * bits > 63:
        return None
    m = len(raw) - n + 1
    if m <= 0:
        return {}
    letters, h = code[raw], np.zeros(m, np.int64)
    for j in range(n):
        h = h << bits | letters[j : j + m]
    sizes = np.array([len(s) for s in seqs])
    at = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes)[:m] >= np.arange(m) + n)
    _, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
    total = np.bincount(inverse, np.repeat(weights, sizes)[at])
    kept = np.flatnonzero(total >= least)
    return {text[i : i + n]: int(w) for i, w in zip(at[first[kept]].tolist(), total[kept].tolist(), strict=True)}


def smallest_acyclic_k(ref: str, low: int = 10, high: int = 15) -> int | None:
    """The graph of one sequence is acyclic where no k-mer occurs twice."""
    for k in range(low, min(high, len(ref) - 1) + 1):
        n = len(ref) - k + 1
        if len({ref[i : i + k] for i in range(n)}) == n:
            return k
    return None
