"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each, mean m and deviation s are kept, times the root of the segment's length. The
Euclidean distance of two vectors is at least that of their statistics (per segment, l (m - m')^2 + l (s - s')^2), and
since the statistics of a vector have its norm, an inner product is at most that of the statistics. Resolutions go from
coarse to fine; a pair goes on while its bound reaches the query's present k-th score, and survivors are scored exactly.
Blocks and their pairs are those of `blocks`.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CANDIDATES, QUERIES, Best, Block, others, packed, products, ranked, safe, search, usable

#: Segments of a vector at each resolution.
RESOLUTIONS = (2, 8, 16)
#: Below this share of survivors, pairs are followed one by one instead of as a matrix.
SPARSE = 0.05


def statistics(x: np.ndarray, resolutions: tuple[int, ...] = RESOLUTIONS) -> np.ndarray:
    """For each resolution and segment the mean and the deviation, times the root of the length: one row a vector."""
    x = x.astype(np.float64)
    out = []
    for count in resolutions:
        edges = np.linspace(0, x.shape[1], count + 1).astype(int)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part, n = x[:, lo:hi], max(hi - lo, 1)
            mean = part.sum(1) / n
            rest = part - mean[:, None]
            out += [mean * np.sqrt(n), np.sqrt((rest * rest).sum(1))]
    return np.stack(out, 1)


def surviving(q: Block, c: Block, least: np.ndarray, alive: np.ndarray, resolutions: tuple[int, ...] = RESOLUTIONS) -> tuple:
    """Pairs whose score may reach `least`: a matrix, or rows and columns once they are few."""
    pairs, at = None, 0
    slack = 1e-9 * float(q.norms.max(initial=0)) * float(c.norms.max(initial=0)) + 1
    for count in resolutions:
        own = slice(at, at + 2 * count)
        at += 2 * count
        if pairs is None:
            alive = alive & (q.index[:, own] @ c.index[:, own].T + slack >= least[:, None])
            if np.count_nonzero(alive) < SPARSE * alive.size:
                pairs = np.nonzero(alive)
        else:
            rows, columns = pairs
            keep = np.einsum("pd,pd->p", q.index[rows, own], c.index[columns, own]) + slack >= least[rows]
            pairs = rows[keep], columns[keep]
    return alive, pairs


def scan(q: Block, c: Block, best: Best) -> None:
    if not safe(q, c):
        best.offer_all(c, products(q, c), others(q, c))
        return
    alive, pairs = surviving(q, c, best.least, others(q, c))
    if pairs is None:
        best.offer_all(c, products(q, c), alive)
    else:
        rows, columns = pairs
        best.offer(rows, c.ids[columns], np.einsum("pd,pd->p", q.floats[rows], c.floats[columns]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", blocks: tuple[int, int] = (QUERIES, CANDIDATES)) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x), ties to the smaller id.

    Exact. Rows with a null id, a null vector or a null or non-finite component take no part, on either side; zero and
    empty vectors do. Vectors are compared with those of their own dimension. A query's own id is no candidate for it.
    Equal rows count once; an id with several vectors counts as a candidate at its best score, and as a query with the
    first of them in order of their components. Scores beyond 63 bits wrap as Spark's sums of longs do, components stop
    at 62 bits. No usable vector or query gives no rows. Other columns are not read.
    """
    ask = usable(queries, id_col, vector_col).groupBy("id").agg(F.min(F.struct("v", "extra")).alias("one")).select("id", "one.extra", "one.v")
    asked = packed(ask, scale, blocks[0], statistics, "asked")
    coded = packed(usable(vectors, id_col, vector_col), scale, blocks[1], statistics, "coded")
    found = search(asked, coded, k, [], functools.partial(scan))
    return ranked(found, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
