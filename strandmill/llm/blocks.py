"""Vectors of whole numbers packed into blocks, and every block of queries paired with every block of candidates.

Rows are dealt to blocks by a hash of id and vector, so no block depends on how the table lies and no id or vector
makes a block large; a block holds about `size` vectors of one dimension, in order of their ids, with an index that the
search keeps beside them. Blocks of candidates are dealt to shards, as many as there are shuffle partitions at most;
blocks of queries are sent to every shard of their dimension and joined there. Nothing passes through the driver.

A merge join yields the pairs of one query block in a shard one after the other, so a task keeps the best of one query
block at a time and sends k rows for each query and shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, written

CANDIDATES, QUERIES = 4096, 512
#: Whole numbers below this are exact in double precision.
EXACT = float(1 << 53)
_PACKED = "dim int, block int, n int, ids binary, extra binary, ints binary, index binary"
_PACKED_ARROW = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "extra", "ints", "index"))])
LOWEST = np.iinfo(np.int64).min


def usable(rows: DataFrame, id_col: str, vector_col: str, extra: list[Column] | None = None) -> DataFrame:
    """(id, extra, v), equal rows once. Rows with a null id or vector, or with a null or non-finite component, are left out."""
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.array(*(extra or [])).cast("array<long>").alias("extra"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return plain.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite).dropDuplicates(["id", "extra", "v"])


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), within 62 bits."""
    return np.clip(np.floor(values * scale), -(2.0**62), 2.0**62).astype(np.int64)


def packed(rows: DataFrame, scale: int, size: int, index: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """Blocks of (id, extra, v) rows, written to the shared folder. `index` makes numbers of the vectors of a block."""
    bounded_batches(rows.sparkSession)
    blocks = -(-rows.count() // size) or 1

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        dim, block, n = key[0].as_py(), key[1].as_py(), group.num_rows
        flat = group.column("v").combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        ids, ints = group.column("id").to_numpy(), scaled(flat.reshape(n, dim), scale)
        extra = group.column("extra").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
        order = np.lexsort((*extra.T, ids))
        ids, ints, extra = ids[order], ints[order], extra[order]
        kept = ints.astype(np.int32) if not ints.size or np.abs(ints).max() < 1 << 31 else ints
        row = (dim, block, n, ids.tobytes(), extra.tobytes(), kept.tobytes(), index(ints).astype(np.float64).tobytes())
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED_ARROW, strict=True)], schema=_PACKED_ARROW)

    dealt = rows.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("dim", "block").applyInArrow(pack, _PACKED), name)


@dataclass
class Block:
    ids: np.ndarray
    extra: np.ndarray
    ints: np.ndarray
    index: np.ndarray

    def __post_init__(self) -> None:
        self.floats = self.ints.astype(np.float64)
        self.norms = np.sqrt((self.floats * self.floats).sum(1))
        self.repeated = bool((self.ids[1:] == self.ids[:-1]).any())

    @classmethod
    def of(cls, row: dict, side: str) -> Block:
        n, dim = row[f"{side}_n"], row["dim"]
        ints = np.frombuffer(row[f"{side}_ints"], np.int32 if len(row[f"{side}_ints"]) == 4 * n * dim else np.int64)
        return cls(np.frombuffer(row[f"{side}_ids"], np.int64), np.frombuffer(row[f"{side}_extra"], np.int64).reshape(n, -1), ints.astype(np.int64).reshape(n, dim), np.frombuffer(row[f"{side}_index"], np.float64).reshape(n, -1))


def safe(q: Block, c: Block) -> bool:
    """Whether all inner products and what bounds are made of are exact in double precision."""
    return float(q.norms.max(initial=0)) * float(c.norms.max(initial=0)) < EXACT / 4


def products(q: Block, c: Block) -> np.ndarray:
    """Inner products of all pairs: exact doubles where they fit, else 64-bit words, which wrap as Spark's do."""
    return q.floats @ c.floats.T if safe(q, c) else q.ints @ c.ints.T


def others(q: Block, c: Block) -> np.ndarray:
    """Pairs that are not of one id."""
    out = np.ones((len(q.ids), len(c.ids)), bool)
    lo, hi = np.searchsorted(c.ids, q.ids, "left"), np.searchsorted(c.ids, q.ids, "right")
    for k in np.flatnonzero(hi > lo).tolist():
        out[k, lo[k] : hi[k]] = False
    return out


class Best:
    """The k best of each of n queries: higher scores first, ties to smaller ids, each id once at its best score."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(n, LOWEST)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least[rows]
        rows, ids, scores = (np.concatenate([a, b[keep]]) for a, b in ((self.rows, rows), (self.ids, ids), (self.scores, scores.astype(np.int64))))
        order = np.lexsort((-scores, ids, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
        rows, ids, scores = rows[new], ids[new], scores[new]
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(self.least)))
        rank = np.arange(len(rows)) - first[rows]
        self.least[rows[rank == self.k - 1]] = scores[rank == self.k - 1]
        self.rows, self.ids, self.scores = rows[rank < self.k], ids[rank < self.k], scores[rank < self.k]

    def offer_all(self, c: Block, scores: np.ndarray, alive: np.ndarray) -> None:
        """The living pairs of a whole matrix: a row of it sends on its k best only, however many are equal."""
        ids, low = c.ids, -np.inf if scores.dtype == np.float64 else LOWEST
        alive = alive & (scores >= self.least[:, None])
        if np.count_nonzero(alive) > self.k * len(alive):
            scores = np.where(alive, scores, low)
            if c.repeated:
                starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                ids, scores = ids[starts], np.maximum.reduceat(scores, starts, axis=1)
            if len(ids) > self.k:
                kth = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
                level = scores == kth
                alive = (scores > kth) | (level & (np.cumsum(level, axis=1) <= self.k))
                alive &= scores > low
            else:
                alive = scores > low
        rows, at = np.nonzero(alive)
        self.offer(rows, ids[at], scores[rows, at])


def search(queries: DataFrame, candidates: DataFrame, k: int, extra: list[str], scan: Callable[[Block, Block, Best], None]) -> DataFrame:
    """(query_id, the query's extra columns, vec_id, score): of each query the k best of each shard, by `scan` of pairs.

    `queries` and `candidates` are tables of `packed`. `scan` offers to a Best what a pair of blocks yields; it gets the
    pairs of a query block in any order.
    """
    spark = queries.sparkSession
    parts = shuffle_partitions(spark)
    shards = min(parts, candidates.count() or 1)
    names = ("n", "ids", "extra", "ints", "index")
    left = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("block").alias("q_block"), *(F.col(c).alias(f"q_{c}") for c in names))
    right = candidates.select("dim", (F.col("block") % shards).alias("shard"), *(F.col(c).alias(f"c_{c}") for c in names))
    joined = left.repartition(parts, "dim", "shard").hint("merge").join(right.repartition(parts, "dim", "shard"), ["dim", "shard"])
    columns = ["query_id", *extra, "vec_id", "score"]

    def found(block: Block, best: Best) -> Iterator[pa.RecordBatch]:
        if len(best.rows):
            more = [pa.array(block.extra[best.rows, k]) for k in range(len(extra))]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[best.rows]), *more, pa.array(best.ids), pa.array(best.scores)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = block = best = None
        for batch in batches:
            for number in range(batch.num_rows):
                row = batch.slice(number, 1).to_pylist()[0]
                here = row["dim"], row["shard"], row["q_block"]
                if here != at:
                    if best is not None:
                        yield from found(block, best)
                    at, block = here, Block.of(row, "q")
                    best = Best(len(block.ids), k)
                scan(block, Block.of(row, "c"), best)
        if best is not None:
            yield from found(block, best)

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of `search` for each key, ranked from 1, after one shuffle by the key."""
    from pyspark.sql import Window

    once = found.repartition(*keys).groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)
