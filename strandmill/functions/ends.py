"""Shifts of reads' ends against the reference, for a batch of reads at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from . import read_ops as ro

#: Letters compared at once; reads are dealt by length, so a long one does not widen the others.
_LETTERS = 1 << 20
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in upper case, and where each string begins (one more: where the last one ends)."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return _UPPER[data[at[0] : at[-1]]], at - at[0]


def _windows(data: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, step: int, blank: int) -> np.ndarray:
    """Row by row the bytes at first, first + step, ...; blank outside [low, high)."""
    at = first[:, None] + step * np.arange(width)
    out = data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where((at >= low[:, None]) & (at < high[:, None]), out, np.uint8(blank))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters agree from the left, row by row; there is a column that never does."""
    return (a != b).argmax(axis=1)


def largest_end_matches(batch: pa.RecordBatch, elements: Callable[[str], tuple], reach: int = 15) -> pa.Array:
    """As `read_ops.largest_end_matches` for each row of (pos, cigar, bases, ref, ref_start); null without a cigar."""
    cigars = batch["cigar"].to_pylist()
    out = np.zeros(len(cigars), bool)
    known = np.array([bool(c) for c in cigars], bool)
    rows = np.flatnonzero(known)
    if not len(rows):
        return pa.array([None] * len(cigars), pa.bool_())
    own = batch.take(pa.array(rows))
    bases, b_at = _letters(own["bases"])
    ref, r_at = _letters(own["ref"])
    ends = [_ends(elements(cigars[i])) for i in rows]
    head, tail, span = (np.array([e[k] for e in ends], np.int64) for k in range(3))
    pos = own["pos"].to_numpy(zero_copy_only=False).astype(np.int64) - own["ref_start"].to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(b_at)
    # The bytes of other letters are not letters, and a read beyond its reference has no place there.
    plain = (pos >= 0) & (pos + span <= np.diff(r_at)) & ((bases.max(initial=0) < 128) & (ref.max(initial=0) < 128))
    ok = np.ones(len(rows), bool)
    for i in np.flatnonzero(~plain):
        r = own.slice(i, 1).to_pylist()[0]
        ok[i] = ro.largest_end_matches(ro.Read(r["pos"], elements(r["cigar"]), r["bases"], ""), r["ref"], r["ref_start"], reach)
    order = np.flatnonzero(plain)
    order = order[np.argsort(size[order], kind="stable")]
    while len(order):
        width = int(size[order[: max(1, _LETTERS // (int(size[order[0]]) + 1))][-1]]) + 1
        n = max(1, _LETTERS // width)
        part, order = order[:n], order[n:]
        part_width = int(size[part[-1]]) + 1
        low, high, r_low, r_high = b_at[part], b_at[part + 1], r_at[part], r_at[part + 1]
        for first, step, place, least in ((low, 1, r_low + pos[part], head[part]), (high - 1, -1, r_low + pos[part] + span[part] - 1, tail[part])):
            read = _windows(bases, first, low, high, part_width, step, 1)
            around = _windows(ref, place - step * reach, r_low, r_high, part_width + 2 * reach, step, 2)
            most = np.minimum(_agree(read, around[:, reach : reach + part_width]), least)
            for shift in range(2 * reach + 1):
                if shift != reach:
                    ok[part] &= _agree(read, around[:, shift : shift + part_width]) <= most
    out[rows] = ok
    return pa.array(out, pa.bool_(), mask=~known)


def _ends(cigar) -> tuple[int, int, int]:
    """Matched bases at both ends of a CIGAR (0: none), and its bases of the reference."""
    if not cigar:
        return 0, 0, 0
    (a, n), (b, m) = cigar[0], cigar[-1]
    return n if a in ro.MATCH else 0, m if b in ro.MATCH else 0, sum(k for op, k in cigar if op in ro.ON_REF)
