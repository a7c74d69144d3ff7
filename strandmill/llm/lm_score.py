"""Stupid-backoff scores from n-gram count tables that are partitioned by hash.

Documents are dealt to batches by a hash of id and text. A batch becomes one row: its ids, the distinct hashes of its
words, and for each place the number of its word; texts move once and are hashed once. Order by order, a batch counts
its n-grams and sends each distinct one once, with its count, to the bucket of its hash; that combining keeps a
frequent n-gram down to one entry for each batch. A bucket adds the counts up and answers every batch in the order it
was asked, so the join of count tables and exploded n-grams needs neither the n-grams sent back nor a row for each.
The answers to an order are written and its requests deleted before the next order is asked, so the disk holds the
requests of one order, however many there are. The batch, joined with its answers, sums the scores of its documents.
There are as many buckets as batches, a number that follows the words of the corpus: what is sent is a row for each
pair of them, as in any shuffle, so raise `batch_words` with the memory of a worker where the corpus is very large.

A word w after context c scores count(c w) / count(c) if c w occurs, else ALPHA times its score after the context
less its first word; a word of no other count scores as one in all words and one. With `held_out`, a document's own
counts are taken off, so that it is scored as unseen text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, pack, rolling, shuffle_partitions, texts_of, unpack, written

ALPHA = 0.4
BATCH_WORDS, LEAST_WORDS = 600_000, 50_000


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and how many each text has."""
    split = [t.split() for t in texts]
    return hash_words([w for s in split for w in s]), np.array([len(s) for s in split], np.int64)


def grams(words: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n-gram that ends at each word, 0 where the text is too short."""
    h = np.zeros(len(words), np.uint64)
    if len(words) >= n:
        h[n - 1 :] = np.maximum(rolling(words, n), np.uint64(1))
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h[place < n - 1] = 0
    return h


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams by bucket, then hash; their counts; where each bucket begins."""
    unique, count = np.unique(hashes[hashes > 0], return_counts=True)
    home = (unique % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return unique[order], count[order], np.searchsorted(home[order], np.arange(buckets + 1))


def scores(orders: list[np.ndarray], sizes: np.ndarray, counts: list[np.ndarray], total: int, alpha: float, held_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log scores and the number of backoffs of each text; counts: for each order and word the corpus count."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    size = sizes[doc]
    if held_out:
        left = []
        for h, c in zip(orders, counts, strict=True):
            order = np.lexsort((h, doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            group = np.cumsum(new) - 1
            own = np.empty(len(h), np.int64)
            own[order] = np.bincount(group)[group] if len(h) else 0
            left.append(c - own)
        counts, whole = left, total - size
    else:
        whole = np.full(len(doc), total)
    seen = counts[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(seen > 0, np.log(np.maximum(seen, 1) / np.maximum(whole, 1)), -np.log(whole + 1.0))
        backoffs = np.zeros(len(doc), np.int64)
        for k in range(1, len(orders)):
            possible = orders[k] > 0
            context = np.roll(counts[k - 1], 1)
            found = possible & (counts[k] > 0)
            backoffs += possible & ~found
            score = np.where(found, np.log(np.maximum(counts[k], 1) / np.maximum(context, 1)), np.where(possible, score + math.log(alpha), score))
    return np.bincount(doc, score, n), np.bincount(doc, backoffs, n).astype(np.int64)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, alpha: float = ALPHA, held_out: bool = True, batches: int | None = None, batch_words: int = BATCH_WORDS
) -> DataFrame:
    """doc_id, n_words, n_backoffs, log_score (sum over the words) and mean_log_score of every document.

    Words are what stands between white space, unchanged. Null and empty texts score 0 over no words, their mean is
    null. Repeated rows are documents of their own: each counts for the others. Equal results for equal rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count_words(parts):
        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(t.split()) for t in texts_of(part.column("text")))], pa.int64())})

    total = base.select("text").mapInArrow(count_words, "n long").agg(F.sum("n")).first()[0] or 0
    # A batch and a bucket hold BATCH_WORDS words; fewer where the cluster has more partitions than that makes.
    least = min(shuffle_partitions(docs.sparkSession), math.ceil(total / LEAST_WORDS))
    n = batches or max(1, least, math.ceil(total / batch_words))
    dealt = base.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def gather(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].combine_chunks()
        words, sizes = words_of(texts_of(group["text"].combine_chunks()))
        unique, number = np.unique(words, return_inverse=True)
        packed = (pack(sizes), pack(np.diff(unique, prepend=np.uint64(0))), pack(number))
        return pa.table([group["batch"][:1], pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([x], pa.binary()) for x in packed)], names=["batch", "ids", "sizes", "words", "numbers"])

    def spread(sizes: bytes, words: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(unpack(words))[unpack(numbers).astype(np.int64)], unpack(sizes).astype(np.int64)

    asked = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
    answered = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("order", pa.int32()), ("counts", pa.binary())])

    def ask(k: int):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for row in part.to_pylist():
                    unique, count, cut = by_bucket(grams(*spread(row["sizes"], row["words"], row["numbers"]), k), n)
                    rows = []
                    for b in np.flatnonzero(np.diff(cut)).tolist():
                        own = slice(cut[b], cut[b + 1])
                        rows.append((b, row["batch"], pack(np.diff(unique[own], prepend=np.uint64(0))), pack(count[own])))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(asked)], schema=asked)

        return run

    def answer(k: int):
        def run(group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["batch"])
            hashes = [np.cumsum(unpack(r["grams"])) for r in rows]
            _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([unpack(r["counts"]) for r in rows])).astype(np.int64)[inverse]
            ends = np.cumsum([0, *map(len, hashes)])
            out = [(r["batch"], r["bucket"], k, pack(sums[ends[i] : ends[i + 1]])) for i, r in enumerate(rows)]
            return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(answered)], schema=answered)

        return run

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        done = []
        got = {(r["order"], r["bucket"]): r["counts"] for r in answers.to_pylist()}
        for row in group.drop_columns(["ids"]).to_pylist():
            words, sizes = spread(row["sizes"], row["words"], row["numbers"])
            hashes = [grams(words, sizes, k) for k in range(1, order + 1)]
            counts = []
            for k, h in enumerate(hashes, 1):
                unique, _, cut = by_bucket(h, n)
                sums = [unpack(got[k, b]).astype(np.int64) for b in np.flatnonzero(np.diff(cut)).tolist()]
                sums = np.concatenate(sums) if sums else np.zeros(0, np.int64)
                by_hash = np.argsort(unique)
                at = np.searchsorted(unique[by_hash], h)
                counts.append(np.where(h > 0, sums[by_hash][np.minimum(at, len(sums) - 1)], 0) if len(sums) else np.zeros(len(h), np.int64))
            done.append((sizes, *scores(hashes, sizes, counts, total, alpha, held_out)))
        sizes, logs, backoffs = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = pa.array(logs / sizes, mask=sizes == 0) if len(sizes) else pa.array([], pa.float64())
        ids = group["ids"].combine_chunks().flatten()
        return pa.table([ids, pa.array(sizes, pa.int64()), pa.array(backoffs, pa.int64()), pa.array(logs, pa.float64()), mean], names=["doc_id", "n_words", "n_backoffs", "log_score", "mean_log_score"])

    batched = written(dealt.groupBy("batch").applyInArrow(gather, f"batch int, ids array<{kind}>, sizes binary, words binary, numbers binary"), "lm-batches", free=True)
    answers = []
    for k in range(1, order + 1):
        requests = batched.drop("ids").mapInArrow(ask(k), "bucket int, batch int, grams binary, counts binary")
        answers.append(written(requests.groupBy("bucket").applyInArrow(answer(k), "batch int, bucket int, order int, counts binary"), "lm-answers", free=True))
    every = reduce(DataFrame.unionByName, answers)
    return batched.groupBy("batch").cogroup(every.groupBy("batch")).applyInArrow(finish, f"doc_id {kind}, n_words long, n_backoffs long, log_score double, mean_log_score double")
