"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

With the vectors' mean m taken away, |q - x|^2 = |q - m|^2 - 2 |x - m| <q - m, u> + |x - m|^2, u being the direction of
x - m. Directions are quantised, norms are exact. Directions are cut into subspaces of two dimensions with sixteen
centres each (four bits). Centres and codes minimise a loss that weighs the part of the residual along the direction
`parallel` times as much as the rest, since that part shifts high inner products: codes by coordinate descent over the
subspaces, centres by the weighted normal equations.

Mean and codebook come from at most `SAMPLE` vectors (smallest hashes of their ids). On the same sample the run measures
what share of the true k nearest is found among the best `RERANK` by codes, and doubles that number until `RECALL` is
reached; a number as large as a slice is an exact scan. Every vector is coded once, two codes a byte, and kept with its
codes as a table in the shared folder. Queries are sent in blocks of `BLOCK`; each block passes over that table once and
its findings are written, so the plan does not grow with the queries. A task scans its codes through the tables, reranks
the best of each slice exactly in double precision, and keeps k a query, so what is shuffled is k rows for each query
and task, whatever the number of vectors. Equal vectors in a slice are scanned as one, with the k + 1 smallest of their
distinct ids, so ties are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, shared_dir, written

SAMPLE, BLOCK, RERANK, SLICE, CENTRES = 8192, 1024, 256, 8192, 16
#: The share of the true nearest that codes must find in the sample, and how many queries it is measured with.
RECALL, TRIED = 0.97, 64


def _matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and the vectors in double precision."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.zeros((0, dim))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(rows), dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return rows[good], x[good]


def polar(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions of x - mean, with a zero where needed to make the dimension even, and the norms."""
    y = x - mean
    norms = np.sqrt((y * y).sum(1))
    return np.pad(y / np.maximum(norms, 1e-300)[:, None], ((0, 0), (0, y.shape[1] % 2))), norms


class Quantiser:
    def __init__(self, parallel: float = 4.0, rounds: int = 6, seed: int = 5):
        self.parallel, self.rounds, self.seed = parallel, rounds, seed

    def fit(self, x: np.ndarray) -> Quantiser:
        """x: directions, one a row."""
        n, d = x.shape
        m, rng = d // 2, np.random.default_rng(self.seed)
        parts = x.reshape(n, m, 2)
        self.centres = parts[rng.integers(0, n, (CENTRES, m)), np.arange(m)[None]].transpose(1, 0, 2).copy()
        self.centres += rng.normal(0, 1e-6, self.centres.shape)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        for _ in range(self.rounds):
            codes = self.encode(x)
            at = (np.arange(m)[None] * CENTRES + codes).astype(np.int64)
            size = m * CENTRES
            along = np.zeros((n, size * 2), np.float32)
            rows = np.arange(n)[:, None]
            along[rows, at * 2] = unit[:, 0::2]
            along[rows, at * 2 + 1] = unit[:, 1::2]
            gram = (self.parallel - 1) * (along.T @ along).astype(np.float64)
            counts = np.bincount(at.ravel(), minlength=size)
            gram[np.arange(size * 2), np.arange(size * 2)] += np.repeat(counts, 2) + 1e-3
            # (1 + (parallel - 1)) times the sums of what lies at each centre: W x = parallel * x.
            right = np.stack([np.bincount(at.ravel(), parts[:, :, c].ravel(), size) for c in (0, 1)], 1).ravel() * self.parallel
            right += 1e-3 * self.centres.ravel()
            self.centres = np.linalg.solve(gram, right).reshape(m, CENTRES, 2)
        return self

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (n, m) that minimise |r|^2 + (parallel - 1) <r, x / |x|>^2, r being the residual."""
        n, d = x.shape
        m = d // 2
        parts = x.reshape(n, m, 2)
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(n, m, 2)
        codes = np.empty((n, m), np.uint8)
        along = np.zeros(n)
        for s in range(m):
            r = parts[:, s, None] - self.centres[s][None]
            codes[:, s] = (r * r).sum(2).argmin(1)
            along += (r[np.arange(n), codes[:, s]] * unit[:, s]).sum(1)
        for _ in range(sweeps):
            for s in range(m):
                r = parts[:, s, None] - self.centres[s][None]
                p = (r * unit[:, s, None]).sum(2)
                rest = along - p[np.arange(n), codes[:, s]]
                cost = (r * r).sum(2) + (self.parallel - 1) * (rest[:, None] + p) ** 2
                codes[:, s] = cost.argmin(1)
                along = rest + p[np.arange(n), codes[:, s]]
        return codes

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(m, CENTRES, q): inner products of each query's subspaces with the centres; two subspaces are merged later."""
        q = queries.reshape(len(queries), -1, 2)
        return np.einsum("qmc,mkc->mkq", q, self.centres).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, the first one low."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def scan(pairs: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate inner products (n, q) of packed codes: for each byte the sum of its two codes' rows of the tables."""
    out = np.zeros((len(pairs), tables.shape[2]), np.float32)
    for s in range(tables.shape[0]):
        out += tables[s][pairs[:, s // 2] >> 4 if s % 2 else pairs[:, s // 2] & 15]
    return out


def nearness(x: np.ndarray, codes: np.ndarray, mean: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(n, q): larger for nearer vectors, up to what the codes tell of their directions."""
    norms = np.sqrt(((x - mean) ** 2).sum(1))[:, None].astype(np.float32)
    return scan(codes, tables) * norms - norms * norms / 2


def enough(quantiser: Quantiser, mean: np.ndarray, x: np.ndarray, k: int) -> int:
    """How many of a slice to rerank: doubled from RERANK until the sample's own nearest are found among them."""
    _, first = np.unique(x, axis=0, return_index=True)
    x = x[np.sort(first)]
    tried = x[:: max(1, len(x) // TRIED)][:TRIED]
    near = nearness(x, packed(quantiser.encode(polar(x, mean)[0])), mean, quantiser.tables(np.pad(tried - mean, ((0, 0), (0, x.shape[1] % 2)))))
    order = np.argsort(-near, axis=0, kind="stable")
    best = [np.argsort(((x - q) ** 2).sum(1), kind="stable")[: k + 1] for q in tried]
    n = RERANK
    while n < len(x) and np.mean([np.isin(best[c], order[:n, c]).mean() for c in range(len(tried))]) < RECALL:
        n *= 2
    return n if n < len(x) else max(n, SLICE)


def _search_slice(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, mean: np.ndarray, qids: np.ndarray, q: np.ndarray, tables: np.ndarray, k: int, rerank: int) -> tuple:
    """The k nearest distinct ids of a slice for each query: (query, id, distance)."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    # Rows by vector, then id, each id once for a vector.
    order = np.lexsort((ids, group))
    new = np.ones(len(ids), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[new]
    ids, group = ids[order], group[order]
    begin = np.searchsorted(group, np.arange(group[-1] + 2))
    first = order[begin[:-1]]
    near = nearness(x[first], codes[first], mean, tables)
    best = min(rerank, len(first))
    top = np.argpartition(-near, best - 1, axis=0)[:best] if best < len(first) else np.broadcast_to(np.arange(len(first))[:, None], near.shape)
    rows = []
    for c in range(len(q)):
        groups = top[:, c]
        dist = np.sqrt(((x[first[groups]] - q[c]) ** 2).sum(1))
        members = [np.arange(begin[g], min(begin[g + 1], begin[g] + k + 1)) for g in groups.tolist()]
        near_ids = ids[np.concatenate(members)]
        near_d = np.repeat(dist, [len(z) for z in members])
        other = near_ids != qids[c]
        rows.append((np.full(int(other.sum()), qids[c]), near_ids[other], near_d[other]))
    return _best(*(np.concatenate(p) for p in zip(*rows, strict=True)), k)


def _best(q: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple:
    """Of each query the k nearest distinct ids, an id at its smallest distance, ties to the smaller id."""
    order = np.lexsort((d, i, q))
    q, i, d = q[order], i[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    q, i, d = q[new], i[new], d[new]
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    rank = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return q[rank < k], i[rank < k], d[rank < k]


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, whatever their dimension."""
    plain = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return plain.where(F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0))


def _coded(clean: DataFrame, quantiser: Quantiser, mean: np.ndarray, dim: int) -> DataFrame:
    """Every vector with its packed codes, written to the shared folder."""
    shared = clean.sparkSession.sparkContext.broadcast((quantiser, mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column("v"), dim)
            for lo in range(0, len(rows), SLICE):
                quantiser, mean = shared.value
                pairs = packed(quantiser.encode(polar(x[lo : lo + SLICE], mean)[0]))
                own = batch.take(pa.array(rows[lo : lo + SLICE]))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), pa.array([p.tobytes() for p in pairs], pa.binary())], names=["vec_id", "v", "codes"])

    kind = clean.schema["v"].dataType.simpleString()
    return written(clean.mapInArrow(run, f"vec_id long, v {kind}, codes binary"), "codes")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by Euclidean distance, ties to the smaller id.

    Null ids and vectors that are null, zero, of another dimension than most, or that hold null or non-finite
    components take no part, on either side. A query's own id is no candidate for it. An id counts once however often
    it is repeated: as a candidate at the smallest distance of its vectors, as a query with the first of them in
    order of their components. No usable vector or query gives no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    schema = "query_id long, vec_id long, score double"
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = _usable(vectors, id_col, vector_col)
    dims = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return none
    dim = dims["d"]
    clean = clean.where(F.size("v") == dim)
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()["v"]
    x = np.stack([np.asarray(v, np.float64) for v in sample])
    mean = x.mean(0)
    quantiser = Quantiser().fit(polar(x, mean)[0])
    rerank = enough(quantiser, mean, x, k)
    ask = _usable(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    coded, path = None, f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    for qids, q in _blocks(ask, dim):
        coded = coded or _coded(clean, quantiser, mean, dim)
        shared = spark.sparkContext.broadcast((quantiser, mean, rerank, qids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            quantiser, mean, rerank, qids, q = shared.value
            tables = quantiser.tables(np.pad(q - mean, ((0, 0), (0, dim % 2))))
            kept = None
            for batch in batches:
                x = batch.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                ids = batch.column("vec_id").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for lo in range(0, len(ids), SLICE):
                    own = slice(lo, lo + SLICE)
                    new = _search_slice(ids[own], x[own], codes[own], mean, qids, q, tables, k, rerank)
                    kept = new if kept is None else _best(*(np.concatenate(p) for p in zip(kept, new, strict=True)), k)
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=["query_id", "vec_id", "score"])

        best = coded.mapInArrow(run, schema).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    if coded is None:
        return none
    discard(coded)
    return spark.read.schema(none.schema).parquet(path)


def _blocks(ask: DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Query ids with their vectors, BLOCK at a time; the driver holds one block."""
    ids: list[int] = []
    rows: list = []
    for row in ask.toLocalIterator():
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.float64).reshape(-1, dim)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float64).reshape(-1, dim)
