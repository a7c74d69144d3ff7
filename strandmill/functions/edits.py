"""Edit distances of many pairs of texts at once, 64 rows of the table to a machine word."""

from __future__ import annotations

import numpy as np

#: Pairs worked on together.
LANES = 1 << 13


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of character codes for each text, 0 behind its end."""
    out = np.zeros((len(texts), width), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(width)[None] < sizes[:, None]] = flat + 1
    return out


def distances(seqs: list[str], others: list[str], which: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The edit distance of seqs[which[i]] and others[other[i]] for each i."""
    which, other = np.asarray(which, np.int64), np.asarray(other, np.int64)
    m, n = (np.array([len(t) for t in x], np.int64)[at] for x, at in ((seqs, which), (others, other)))
    depth = np.maximum(-(-m // 64), 1)
    # Sequences of as many words together; of these, pairs whose other text is long first, so those at work lead.
    order = np.lexsort((-n, depth))
    out, low = np.empty(len(which), np.int64), 0
    while low < len(order):
        first = order[low]
        some = order[low : low + max(1, LANES // int(max(depth[first], n[first] // 64)))]
        some = some[depth[some] == depth[first]]
        low += len(some)
        (rows, row), (columns, column) = (np.unique(x[some], return_inverse=True) for x in (which, other))
        match, texts = _matching([seqs[i] for i in rows], [others[i] for i in columns], int(depth[first]))
        out[some] = _lanes(match, len(rows), texts, row, column, m[some], n[some], int(depth[first]))
    return out


def _matching(seqs: list[str], others: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the places of each character in each sequence, and the others by column as numbers of characters."""
    rows, columns = _codes(seqs, 64 * words), _codes(others, max(1, max(map(len, others))))
    # A character that no sequence has is number 0, as are ends: it matches nothing.
    there = np.zeros(int(max(rows.max(), columns.max())) + 1, bool)
    there[rows.reshape(-1)] = True
    there[0] = False
    number = np.where(there, np.cumsum(there), 0)
    cut, bits = number[rows].reshape(len(seqs), words, 64), np.uint64(1) << np.arange(64, dtype=np.uint64)
    match = np.zeros((int(there.sum()) + 1, words, len(seqs)), np.uint64)
    for c in range(1, len(match)):
        match[c] = np.where(cut == c, bits, np.uint64(0)).sum(2, dtype=np.uint64).T
    return match.reshape(-1), np.ascontiguousarray(number[columns].T)


def _lanes(match: np.ndarray, texts: int, columns: np.ndarray, which: np.ndarray, other: np.ndarray, m: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Pairs in falling order of n, all of `depth` words: differences between rows of a column as bits, up and down apart."""
    one, score = np.uint64(1), m.copy()
    up = np.full((depth, len(which)), ~np.uint64(0))
    down = np.zeros_like(up)
    last = ((m - 1) % 64).astype(np.uint64)
    working = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
    for j, k in enumerate(working):
        base = columns[j][other[:k]] * (depth * texts) + which[:k]
        # Into the first word comes the first row, which rises by one a column.
        more, less = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for w in range(depth):
            pv, mv = up[w, :k], down[w, :k]
            eq = match[base + w * texts]
            xv = eq | mv
            eq |= less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            high = np.uint64(63) if w < depth - 1 else last[:k]
            out_more, out_less = ph >> high & one, mh >> high & one
            ph, mh = ph << one | more, mh << one | less
            up[w, :k], down[w, :k] = mh | ~(xv | ph), ph & xv
            more, less = out_more, out_less
        score[:k] += more.astype(np.int64) - less.astype(np.int64)
    return np.where(m == 0, n, score)
