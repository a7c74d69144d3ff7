"""Benchmark decontamination: a generalised suffix automaton over the normalised words of all test items;
documents stream through it, the longest match at each word is tracked, and spans beyond a length limit or a
share of an item are removed.

No row is shuffled: the automaton of a block of items travels to the documents. A benchmark beyond one block
(`BLOCK_WORDS` words) is cut into several, and the documents pass each block in turn and are written in between, so
one automaton is held at a time, however large the benchmark is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, byte_slices, hex256, let_go, texts_of, unused, written

#: Words of items in one automaton.
BLOCK_WORDS = 200_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z only) words of letters, digits and non-ASCII characters."""
    return text.encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Every run of words of every item, and which windows make a hit.

    An item of n words has windows of min(window, ceil(coverage * n)) consecutive words.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = 10, coverage: float = 1.0):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        own: dict[int, set] = {}
        ends: list[tuple[int, int, str | None]] = []
        self.shortest = window
        for item, words in items:
            size = min(window, math.ceil(coverage * len(words)))
            if not words:
                continue
            self.shortest = min(self.shortest, size)
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)))
                own.setdefault(last, set()).add(item)
                if size < window and k + 1 >= size:
                    ends.append((last, size, item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: Items with a run that ends in the state, by way of any longer run.
        items_at: dict[int, set] = own
        for s in reversed(order):
            if s in items_at and self.link[s] > 0 and self.length[self.link[s]] >= window:
                items_at.setdefault(self.link[s], set()).update(items_at[s])
        #: The state that holds the last `window` words of a state's runs.
        self.full = [0] * len(self.link)
        for s in order:
            p = self.link[s]
            self.full[s] = self.full[p] if self.length[p] >= window else s
        self.items_at = {s: frozenset(items_at.get(s, ())) for s in set(self.full[1:]) if self.length[s] >= window}
        #: Windows shorter than `window` that end in a state: (words, items), its own and those of its suffixes.
        marks: dict[int, dict[int, set]] = {}
        for s, size, item in ends:
            while self.length[self.link[s]] >= size:
                s = self.link[s]
            marks.setdefault(s, {}).setdefault(size, set()).add(item)
        self.short: list[tuple] = [()] * len(self.link)
        for s in order:
            mine = tuple((n, frozenset(x)) for n, x in sorted(marks.get(s, {}).items()))
            self.short[s] = self.short[self.link[s]] + mine

    def _clone(self, p: int, q: int, c: int) -> int:
        k = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        k = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = k
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[k] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return k

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans (start, end exclusive, merged) inside occurring windows, and the items they come from."""
        if len(words) < self.shortest or not self.vocab:
            return [], set()
        get = self.vocab.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        starts, stops = edges[::2], edges[1::2]
        wide = np.flatnonzero(stops - starts >= self.shortest)
        spans: list[tuple[int, int]] = []
        items: set = set()
        nxt, link, length, full, short, window = self.next, self.link, self.length, self.full, self.short, self.window
        for r in wide:
            first = int(starts[r])
            state = matched = 0
            for at, c in enumerate(ids[first : stops[r]].tolist(), first):
                while state and c not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    matched += 1
                reach = 0
                if matched >= window:
                    reach = window
                    items |= self.items_at[full[state]]
                for n, found in short[state]:
                    if n <= matched:
                        reach = max(reach, n)
                        items |= found
                if reach:
                    start = at + 1 - reach
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at + 1))
        return spans, items


def automata(
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = 10,
    coverage: float = 1.0,
    block_words: int = BLOCK_WORDS,
) -> Iterator[tuple[SuffixAutomaton, bool]]:
    """One automaton for each block of items, read through the driver a block at a time, and whether it is the last."""
    items: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = words_of(row[1] or "")
        if size + len(words) > block_words and items:
            yield SuffixAutomaton(items, window, coverage), False
            items, size = [], 0
        items.append((row[0], words))
        size += len(words)
    yield SuffixAutomaton(items, window, coverage), True


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", spans_col: str = "_hit_spans_", items_col: str = "_hit_items_", **limits) -> DataFrame:
    """`docs` with `spans_col` (array of [start, end) word positions, merged) and `items_col` (array of item ids).

    Null and empty texts have no words and no hits. Items without words make no window; an item with a null id
    hits words but is not listed. Repeated documents are judged alike, repeated items count once. With an empty
    benchmark nothing is hit, an empty table stays empty. Columns of `docs` under these two names are replaced.
    """
    return _scanned(docs, benchmark, text_col, spans_col, items_col, **limits)


def _scanned(
    docs: DataFrame, benchmark: DataFrame, text_col: str, spans_col: str, items_col: str, finish: Callable | None = None, finished: T.StructType | str | None = None, **limits
) -> DataFrame:
    """As `find_contamination`; `finish` makes of a batch, its spans and its items a batch of the schema `finished`, in
    the pass of the last block, so that a task never needs two Python workers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(spans_col, items_col)
    plain = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField(items_col, T.ArrayType(T.StringType()))])
    last = None
    for block, final in automata(benchmark, **limits):
        if last is not None:
            docs = written(docs, "matched")
            last.unpersist()
        last = shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared, finish=finish if final else None):
            let_go()
            automaton = shared.value
            for part in (p for batch in batches for p in byte_slices(batch, text_col)):
                seen = spans_col in part.schema.names
                old_spans, old_items = (part.column(c).to_pylist() if seen else None for c in (spans_col, items_col))
                spans_out, items_out = [], []
                for k, text in enumerate(texts_of(part.column(text_col))):
                    spans, items = automaton.scan(words_of(text))
                    if seen:
                        spans = merged([*old_spans[k], *spans])
                        items = items | set(old_items[k])
                    spans_out.append(spans)
                    items_out.append(sorted(x for x in items if x is not None))
                if finish is not None:
                    yield finish(part, spans_out, items_out)
                    continue
                cols = [part.column(n) for n in plain]
                cols += [pa.array(spans_out, pa.list_(pa.list_(pa.int32()))), pa.array(items_out, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*plain, spans_col, items_col])

        docs = docs.mapInArrow(run, finished if final and finish is not None else schema)
    return docs


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: words, words hit, items with occurring windows, their ids' digest, and the verdict."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(part: pa.RecordBatch, spans: list, items: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in x) for x in spans]
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([len(words_of(t)) for t in texts_of(part.column("text"))], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hex256(",".join(x)) for x in items], pa.string()),
                pa.array([h > 0 for h in hit], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = picked.schema["doc_id"].dataType.simpleString()
    finished = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _scanned(picked, benchmark, "text", "_hit_spans_", "_hit_items_", finish, finished, **limits)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **limits) -> DataFrame:
    """The documents without the words of occurring windows; all columns stay, the length column follows the text.

    Documents without a hit, null and empty ones among them, pass unchanged. What stands between two removed words
    goes with them. Repeated rows are judged alike, each for itself; with an empty benchmark nothing changes.
    """
    spans_col, items_col = (unused(docs.columns, c) for c in ("hit_spans", "hit_items"))
    names = docs.columns

    def cut(text: str, spans: list) -> str:
        data = text.encode()
        at = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
        out, last = [], 0
        for start, end in spans:
            out.append(data[last : at[start][0]])
            last = at[end - 1][1]
        return b"".join([*out, data[last:]]).decode()

    def finish(part: pa.RecordBatch, spans: list, items: list) -> pa.RecordBatch:
        cols = {n: part.column(n) for n in names}
        if any(spans):
            old = cols[text_col].to_pylist()
            new = [cut(t, s) if s else t for t, s in zip(old, spans, strict=True)]
            cols[text_col] = pa.array(new, pa.string())
            if length_col in cols:
                sizes = cols[length_col].to_pylist()
                cols[length_col] = pa.array([len(n) if s else z for n, s, z in zip(new, spans, sizes, strict=True)], cols[length_col].type)
        return pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return _scanned(docs, benchmark, text_col, spans_col, items_col, finish, docs.schema, **limits)
