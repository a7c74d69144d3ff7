"""Substring dedup over word windows, partitioned by minimisers.

Every window of `window` consecutive words has a minimiser: its leftmost run of `seed` words with the smallest hash.
Consecutive windows with the same minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket,
where all equal windows meet; sorting finds each window's smallest document id exactly.

* Skew. Before the shuffle a slice of documents sends each distinct super-k-mer once. Copies of it in the slice with
  a larger id than its first one are answered by that alone and send only where they stand, so a passage that a third
  of all documents share costs a bucket one string for each slice. A seed of three words keeps frequent words from
  being minimisers of many different windows.
* Volume. A super-k-mer of w windows takes w + 12 words for w windows; slices are packed and compressed by bucket.
* The number of buckets follows spark.sql.shuffle.partitions, so a bucket stays in proportion to a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, hash_words, ids_of, mix64, pack, rolling, shuffle_partitions, texts_of, unpack

SLICE_BYTES = 4 << 20
_CODEC = pa.Codec("zstd", 6)

#: strings and places: how many; text: the packed strings; numbers: words of each string, then doc, tag, first word
#: and string of each place.
_SENT = "bucket int, strings int, places int, size long, text binary, numbers binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("strings", pa.int32()), ("places", pa.int32()), ("size", pa.int64()), ("text", pa.binary()), ("numbers", pa.binary())])
_FOUND = "doc long, tag long, starts array<int>, stops array<int>"
_FOUND_ARROW = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return text.encode().split()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts, ids and tags of about SLICE_BYTES of text, however the rows are dealt to batches."""
    texts: list[str] = []
    ids: list[int] = []
    tags: list[int] = []
    size = 0
    for batch in batches:
        for text, i, tag in zip(texts_of(batch.column("text")), ids_of(batch.column("doc")).tolist(), batch.column("tag").to_pylist(), strict=True):
            texts.append(text)
            ids.append(i)
            tags.append(tag)
            size += len(text)
            if size >= SLICE_BYTES:
                yield texts, np.array(ids, np.int64), np.array(tags, np.int64)
                texts, ids, tags, size = [], [], [], 0
    if texts:
        yield texts, np.array(ids, np.int64), np.array(tags, np.int64)


def super_kmers(texts: list[str], window: int, seed: int) -> tuple:
    """Words of all texts, and each text's first; for each super-k-mer its text's number, first word, words, and its minimiser's hash."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        words += w
    none = np.empty(0, np.int64)
    first_word = np.cumsum([0, *sizes])
    n = len(words) - window + 1
    if n <= 0:
        return words, first_word, none, none, none, none.astype(np.uint64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    seeds = rolling(hash_words(words), seed)
    span = window - seed + 1
    lowest = np.arange(n) + np.lib.stride_tricks.sliding_window_view(seeds, span)[:n].argmin(axis=1)
    whole = text_of[:n] == text_of[window - 1 : window - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | ~whole[:-1] | (text_of[1:n] != text_of[: n - 1])
    begin = np.flatnonzero(new & whole)
    stops = np.flatnonzero(new | ~whole)
    stops = np.append(stops, n)
    end = stops[np.searchsorted(stops, begin, side="right")]
    return words, first_word, text_of[begin], begin - first_word[text_of[begin]], end - begin + window - 1, seeds[lowest[begin]]


def _send(texts: list[str], docs: np.ndarray, tags: np.ndarray, buckets: int, window: int, seed: int) -> pa.RecordBatch:
    words, first_word, text, at, size, minimiser = super_kmers(texts, window, seed)
    begin = (first_word[text] + at).tolist()
    strings = [b" ".join(words[b : b + s]) for b, s in zip(begin, size.tolist(), strict=True)]
    number: dict[bytes, int] = {}
    which = np.fromiter([number.setdefault(s, len(number)) for s in strings], np.int64, len(strings))
    unique = list(number)
    home = (minimiser % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((which, home))
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
    rows: list[tuple] = []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=False):
        own = order[lo:hi]
        ids, local = np.unique(which[own], return_inverse=True)
        raw = b"\n".join([unique[i] for i in ids.tolist()])
        first = own[np.unique(local, return_index=True)[1]]
        # Ids as steps from one to the next: they rise with the strings, which are numbered as they were met.
        steps = np.diff(docs[text[own]], prepend=0), tags[text[own]].astype(np.int64), at[own], np.diff(local, prepend=0)
        numbers = np.concatenate([size[first].astype(np.uint64), *(zigzag(x) for x in steps)])
        rows.append((int(home[own[0]]), len(ids), len(own), len(raw), _CODEC.compress(raw, asbytes=True), pack(numbers)))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SENT_ARROW)], schema=_SENT_ARROW)


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones, small ones small."""
    return (x << 1 ^ x >> 63).astype(np.uint64)


def unzigzag(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _answer(group: pa.Table, window: int) -> pa.Table:
    """Stretches of words that are covered by windows of documents with smaller ids."""
    words: list[bytes] = []
    sizes, doc, tag, at, string, local_min = [], [], [], [], [], []
    seen = 0
    for row in group.to_pylist():
        raw = _CODEC.decompress(row["text"], row["size"], asbytes=True)
        words += raw.replace(b"\n", b" ").split(b" ")
        m, n = row["strings"], row["places"]
        numbers = unpack(row["numbers"])
        ids, tags, places, which = (unzigzag(numbers[m + k * n : m + (k + 1) * n]) for k in range(4))
        ids, which = np.cumsum(ids), np.cumsum(which)
        low = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(low, which, ids)
        sizes.append(numbers[:m].astype(np.int64))
        doc.append(ids)
        tag.append(tags)
        at.append(places)
        string.append(which + seen)
        local_min.append(low)
        seen += m
    if not words:
        return _FOUND_ARROW.empty_table()
    size, doc, tag, at, string, low = (np.concatenate(x) for x in (sizes, doc, tag, at, string, local_min))
    codes = _numbered(words)
    del words
    # One source for each string: the smallest id that it has in its slice.
    first = np.cumsum(size) - size
    hashes = rolling(mix64(codes.astype(np.uint64) + np.uint64(1)), window)
    count = size - window + 1
    start = np.repeat(first, count) + _within(count)
    owner = np.repeat(np.arange(len(size)), count)
    order = np.argsort(hashes[start], kind="stable")
    h = hashes[start[order]]
    same = h[1:] == h[:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cand = order[twice]
    least = np.full(len(start), np.iinfo(np.int64).max)
    if len(cand):
        rows = codes[start[cand][:, None] + np.arange(window)].astype(np.int32)
        _, inverse = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * window))).ravel(), return_inverse=True)
        best = np.full(inverse.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, inverse, low[owner[cand]])
        least[cand] = best[inverse]
    alone = np.ones(len(start), bool)
    alone[cand] = False
    least[alone] = low[owner[alone]]
    # Each place of a string: its windows with a smaller id elsewhere.
    spread = count[string]
    place = np.repeat(np.arange(len(string)), spread)
    k = _within(spread)
    offset = np.cumsum(count) - count
    hit = least[offset[string[place]] + k] < doc[place]
    place, k = place[hit], k[hit]
    return _stretches(doc[place], tag[place], at[place] + k, window)


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _numbered(words: list[bytes]) -> np.ndarray:
    import pandas as pd

    values = np.empty(len(words), object)
    values[:] = words
    return pd.factorize(values)[0]


def _stretches(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, window: int) -> pa.Table:
    if not len(doc):
        return _FOUND_ARROW.empty_table()
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    new = new_doc.copy()
    new[1:] |= start[1:] > start[:-1] + window
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1
    edges = np.append(np.flatnonzero(new_doc[heads]), len(heads)).astype(np.int32)
    starts = pa.array(start[heads].astype(np.int32))
    stops = pa.array((start[tails] + window).astype(np.int32))
    at = heads[edges[:-1]]
    return pa.Table.from_arrays(
        [pa.array(doc[at]), pa.array(tag[at]), pa.ListArray.from_arrays(edges, starts), pa.ListArray.from_arrays(edges, stops)], schema=_FOUND_ARROW
    )


def repeated_stretches(docs: DataFrame, window: int = 13, seed: int = 3, buckets: int | None = None) -> DataFrame:
    """From (doc long, tag long, text) rows: for each row and bucket the word stretches that repeat a smaller id."""
    n = buckets or 8 * shuffle_partitions(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, tags in slices(batches):
            yield _send(texts, ids, tags, n, window, seed)

    return docs.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(lambda group: _answer(group, window), _FOUND)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 3, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by one space) of every document.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are judged on the
    input. Null and empty texts have no words. A null id counts as larger than any other. Repeated rows (equal id and
    text) get equal results and never remove each other; rows with one id and different texts are each judged
    against smaller ids only; they are told apart by 64 bits of a hash of the text. Ids are whole numbers. An empty
    table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.col(text_col)).alias("tag"),
        F.col(text_col).alias("text"),
    )
    found = repeated_stretches(base.select("doc", "tag", "text"), window, seed, buckets)
    spans = found.groupBy("doc", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, starts, stops in zip(texts_of(batch.column("text")), batch.column("starts"), batch.column("stops"), strict=True):
                words = words_of(text)
                total.append(len(words))
                if starts.is_valid:
                    mask = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mask, starts.values.to_numpy(), 1)
                    np.add.at(mask, np.minimum(stops.values.to_numpy(), len(words)), -1)
                    covered = (np.cumsum(mask) > 0).tolist()
                    words = [w for w, c in zip(words, covered, strict=False) if not c]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = base.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept string")


def report(docs: DataFrame, **options) -> DataFrame:
    out = dedup(docs, **options)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
