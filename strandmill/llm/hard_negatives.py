"""Hard negatives by a pivot table.

With one coordinate more, sqrt(M^2 - |x|^2) for candidates and 0 for queries, M being the largest norm of a block, the
inner product becomes a Euclidean distance: |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>. A block of candidates keeps the
distances of its vectors to a few pivots; by the triangle inequality, a query's distances to the same pivots bracket
every score from both sides. Only pairs whose bracket may matter are held against exact scores: for positives, those
that may reach the present k-th score; for negatives, those that may lie in the window that the positive opens.

Pivots are chosen far apart among at most `SAMPLE` vectors (smallest hashes); brackets hold for any pivots, so the
sample bears on speed alone. Blocks and their pairs are those of `blocks`.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import CANDIDATES, QUERIES, Best, Block, others, packed, products, ranked, safe, scaled, search, usable
from .common import discard, written

SAMPLE, PIVOTS = 2048, 12


def far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` rows, each the farthest from those before it."""
    at = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(at) < min(count, len(x)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def pivots_of(rows: DataFrame, scale: int, count: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension that the sample meets."""
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").select("v").limit(SAMPLE).toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(scaled(np.asarray(v, np.float64), scale))
    return {d: far_apart(np.stack(x).astype(np.float64), count) for d, x in by_dim.items()}


def _pivots(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """The origin serves where the sample had no vector of the dimension."""
    return pivots.get(dim, np.zeros((1, dim)))


def _lifted(pivots: np.ndarray, most: float) -> np.ndarray:
    """The pivots' further coordinate."""
    return np.sqrt(np.maximum(most * most - (pivots * pivots).sum(1), 0))


def table(pivots: dict[int, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Distances of a block's lifted vectors to the lifted pivots; the last column holds M."""
    x, p = x.astype(np.float64), _pivots(pivots, x.shape[1])
    squares = (x * x).sum(1)
    most = float(np.sqrt(squares.max(initial=0)))
    up, high = np.sqrt(np.maximum(most * most - squares, 0)), _lifted(p, most)
    apart = most * most + (p * p).sum(1) + high * high - 2 * (x @ p.T + up[:, None] * high)
    return np.concatenate([np.sqrt(np.maximum(apart, 0)), np.full((len(x), 1), most)], axis=1)


def brackets(pivots: dict[int, np.ndarray], q: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores that the pivots leave to each pair of a query and a vector of a block."""
    p, most = _pivots(pivots, q.shape[1]), float(index[0, -1])
    high, squares = _lifted(p, most), (q * q).sum(1)
    own = np.sqrt(np.maximum(squares[:, None] + (p * p).sum(1) + high * high - 2 * q @ p.T, 0))
    near, far = np.zeros((len(q), len(index))), np.full((len(q), len(index)), np.inf)
    for k in range(len(p)):
        np.maximum(near, np.abs(own[:, k, None] - index[None, :, k]), out=near)
        np.minimum(far, own[:, k, None] + index[None, :, k], out=far)
    whole = squares[:, None] + most * most
    # Roots of cancelled sums are off by the root of the rounding error: 1e-7 of the longest distance, squared with it.
    longest = squares.max(initial=0) + most * most + ((p * p).sum(1) + high * high).max(initial=0)
    slack = 1e-6 * longest + 1
    return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack


def _scan_positives(pivots: dict, q: Block, c: Block, best: Best) -> None:
    alive = others(q, c) & (q.extra[:, 0, None] == c.extra[None, :, 0])
    if safe(q, c):
        alive &= brackets(pivots, q.floats, c.index)[1] >= best.least[:, None]
    if alive.any():
        best.offer_all(c, products(q, c), alive)


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole scores s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _scan_negatives(pivots: dict, share: tuple[int, int], q: Block, c: Block, best: Best) -> None:
    """`q.extra`: label, positive, positive's score. Rows of one anchor share brackets and scores."""
    least, most = window(q.extra[:, 2], *share)
    floor = np.maximum(least, best.least)
    alive = others(q, c) & (q.extra[:, 0, None] != c.extra[None, :, 0])
    _, first, own = np.unique(q.ids, return_index=True, return_inverse=True)
    one = Block(q.ids[first], q.extra[first], q.ints[first], q.index[first])
    if safe(one, c):
        low, high = brackets(pivots, one.floats, c.index)
        alive &= (high[own] >= floor[:, None]) & (low[own] <= most[:, None])
    if alive.any():
        scores = products(one, c)[own]
        best.offer_all(c, scores, alive & (scores >= least[:, None]) & (scores <= most[:, None]))


def mine(
    vectors: DataFrame,
    anchors: Callable[[Column], Column],
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    share: tuple[int, int] = (30, 90),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    blocks: tuple[int, int] = (QUERIES, CANDIDATES),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): exact.

    Scores are inner products of floor(scale * x), higher first, ties to the smaller id. An anchor (a row whose id
    `anchors` takes) has as positives its first `positives` other rows of its label; for each of them, negatives are the
    first rows of other labels whose score lies within `share` per cent of the positive's. Rows with a null label, id or
    vector, or a null or non-finite component, take no part; vectors are compared with those of their own dimension.
    Equal rows count once; an id with several vectors or labels is a candidate with each of them, at its best score, and
    an anchor with the first in order of label and components. An anchor without positives, or with positives of a
    negative score only, has no rows. Scores beyond 63 bits wrap as Spark's sums of longs do, components stop at 62
    bits. An empty table gives no rows. Other columns are not read.
    """
    rows = usable(vectors.where(label.isNotNull()), id_col, vector_col, [label])
    pivots = pivots_of(rows, scale, PIVOTS)
    no_index = lambda x: np.zeros((len(x), 1))
    coded = packed(rows, scale, blocks[1], functools.partial(table, pivots), "pivoted")
    ask = rows.where(anchors(F.col("id"))).groupBy("id").agg(F.min(F.struct("extra", "v")).alias("one")).select("id", "one.extra", "one.v")
    ask = written(ask, "anchors")
    asked = packed(ask, scale, blocks[0], no_index, "asked")
    near = ranked(search(asked, coded, positives, [], functools.partial(_scan_positives, pivots)), ["query_id"], positives)
    chosen = near.select(F.col("query_id").alias("id"), "vec_id", "score")
    pairs = chosen.join(ask, "id").select("id", F.concat("extra", F.array("vec_id", "score")).alias("extra"), "v")
    paired = packed(written(pairs, "pairs"), scale, blocks[0], no_index, "asked")
    discard(asked)
    found = search(paired, coded, negatives, ["label", "positive_id", "positive_score"], functools.partial(_scan_negatives, pivots, share))
    best = ranked(found, ["query_id", "positive_id", "positive_score"], negatives)
    return best.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
