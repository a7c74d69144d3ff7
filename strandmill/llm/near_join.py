"""Similarity join on word shingles by chosen paths.

1. Texts become sets of hashed shingles of five words; documents with equal sets form a class, of which one stands
   for all. A set is sketched by `COORDS` minima.
2. Chosen paths: at a node of the tree every coordinate is taken with chance 1 / (threshold * COORDS), by a hash of
   the node, and the sets at the node go to a child for each value of a taken coordinate. Sets of the threshold share
   one child on average, unlike sets hardly any. Nodes with up to `SMALL` sets are compared by brute force. Larger
   ones are dealt to blocks, in each of which all pairs are compared and one leader then stands for all whose
   sketches are about as alike as the threshold asks (`LED`); leaders and sets without one are split further, and what is still
   large at `DEPTH` is compared in pairs of blocks. So a large group of near copies does not travel down the tree as
   a whole. Runs, each with other nodes and leaders, are repeated until a pair at the threshold is met with the
   target recall.
3. Pairs whose sketches agree well enough are joined to provisional groups, within which all pairs are compared
   exactly, groups beyond one block in pairs of blocks. So each set travels once, links within a group are complete,
   and no list of all pairs is ever made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, bounded_batches, byte_slices, discard, hash_words, ids_of, let_go, mix64, rolling, shuffle_partitions, texts_of, unused, written
from .components import connected_components

COORDS, SMALL, DEPTH, BLOCK = 64, 48, 4, 512
#: Sketches of pairs at 0.8 agree in 51 of 64 places, give or take 3.2; fewer than this is five deviations less.
SLACK = 0.25
#: How much less alike than the threshold a leader and those that it stands for may be: what is as alike as the
#: threshold to one of them is then still alike enough to the leader to be met, and other nodes have other leaders.
LED = 0.1


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of words; shorter texts are one shingle, empty ones have none."""
    split = [t.split() for t in texts]
    sizes = [len(w) for w in split]
    hashes = hash_words([x for w in split for x in w])
    out, at = [], 0
    for n in sizes:
        own = hashes[at : at + n]
        out.append(np.unique(rolling(own, min(words, n))) if n else np.empty(0, np.uint64))
        at += n
    return out


_FACTORS = mix64(np.arange(1, COORDS + 1)) | np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        with np.errstate(over="ignore"):
            x = shingles[lo : lo + 1024, None] * _FACTORS[None]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0x9E3779B97F4A7C15)
        low = np.minimum(low, x.min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def runs_for(recall: float, threshold: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a path down to `depth` with the chance wanted."""
    met = 1.0
    for _ in range(depth):
        met = 1 - (1 - met * threshold / (threshold * COORDS)) ** COORDS
    return math.ceil(math.log(1 - recall) / math.log(1 - met))


def children(nodes: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each (node, sketch) the children it goes to: row numbers and child nodes."""
    limit = np.uint64(int(2.0**64 / (threshold * COORDS)))
    coord = np.arange(COORDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        taken = mix64(nodes[:, None] * np.uint64(0x9E3779B97F4A7C15) + coord[None]) < limit
        rows, cols = np.nonzero(taken)
        value = sketches[rows, cols].astype(np.uint64) << np.uint64(8) | cols.astype(np.uint64)
        return rows, mix64(nodes[rows] ^ mix64(value))


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in byte_slices(batch):
                sets = shingle_sets(texts_of(part.column("text")), words)
                cols = [
                    pa.array(ids_of(part.column("doc"))),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(run, "doc long, key binary, sketch binary")


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDS)


def _roots(reps: DataFrame, runs: int, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketches = _sketches(batch.column("sketch"))
            for r in range(runs):
                rows, nodes = children(np.full(len(sketches), mix64(np.array([r + 1]))[0]), sketches, threshold)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column("key").take(pa.array(rows))], names=["node", "key"])

    return reps.select("key", "sketch").mapInArrow(run, "node long, key binary")


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_numpy().view(np.uint64)
            at, to = children(nodes, _sketches(batch.column("sketch")), threshold)
            own = [batch.column(c).take(pa.array(at)) for c in ("key", "sketch")]
            yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), *own], names=["node", "key", "sketch"])

    return rows.select("node", "key", "sketch").mapInArrow(run, "node long, key binary, sketch binary")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between n things."""
    up = list(range(n))
    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        x, y = a, b
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        while up[y] != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


#: Sets in one Python group, beside the least that spreads them over all partitions.
GROUPED = 16_384


def _bins(df: DataFrame, n: int, each: int = GROUPED) -> int:
    """How many groups n rows are dealt to, so that a group is bounded however many there are."""
    return max(4 * shuffle_partitions(df.sparkSession), math.ceil(n / each))


def _runs(group: pa.Table, by: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The group in order of `by`, and where each run of equal values begins and how long it is."""
    group = group.combine_chunks().sort_by([(c, "ascending") for c in by])
    new = np.zeros(group.num_rows, bool)
    new[:1] = True
    for c in by:
        value = group[c].to_numpy()
        new[1:] |= value[1:] != value[:-1]
    begin = np.flatnonzero(new)
    return group, begin, np.diff(np.append(begin, group.num_rows))


def agreement(x: np.ndarray) -> np.ndarray:
    """Of all pairs of sketches, in how many places they agree."""
    same = np.zeros((len(x), len(x)), np.uint8)
    for c in range(COORDS):
        same += x[:, c][:, None] == x[:, c][None]
    return same


def leaders(close: np.ndarray) -> np.ndarray:
    """Of n things in their order: the first that stays and is close to it, itself for one that stays."""
    of = np.full(len(close), -1)
    for k in range(len(close)):
        if of[k] < 0:
            of[k + np.flatnonzero(close[k, k:] & (of[k:] < 0))] = k
            of[k] = k
    return of


def _small_links(small: DataFrame, least: int, bins: int) -> DataFrame:
    """Spanning links of nodes that are compared by brute force; many nodes share a group, each is compared alone."""

    def run(group: pa.Table) -> pa.Table:
        group, begin, size = _runs(group, ["node"])
        keys, x = group["key"].combine_chunks(), _sketches(group["sketch"].combine_chunks())
        pairs = begin[size == 2]
        pairs = pairs[(x[pairs] == x[pairs + 1]).sum(axis=1) >= least] if len(pairs) else pairs
        left, right = [pairs], [pairs + 1]
        for b, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            link = np.triu(agreement(x[b : b + n]) >= least, 1)
            if link.any():
                edges = np.array(_forest(n, *np.nonzero(link))) + b
                left.append(edges[:, 0])
                right.append(edges[:, 1])
        return pa.table([keys.take(pa.array(np.concatenate(c).astype(np.int64))) for c in (left, right)], names=["a", "b"])

    binned = small.select(F.pmod(F.col("node"), F.lit(bins)).alias("bin"), "node", "key", "sketch")
    return binned.groupBy("bin").applyInArrow(run, "a binary, b binary")


def _led(large: DataFrame, least: int, close: int, bins: int) -> DataFrame:
    """(a, b, node): spanning links of all pairs within a block of a node; with its node where a now stands for b.

    A block is dealt by a hash of node and key, so other sets share it, and others lead, at every node.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    dealt = large.withColumn("block", F.pmod(F.xxhash64("node", "key"), blocks)).withColumn("bin", F.pmod(F.xxhash64("node", "block"), F.lit(bins)))
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("node", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        group, begin, size = _runs(group, ["node", "block"])
        keys, nodes, x = group["key"].to_pylist(), group["node"].to_pylist(), _sketches(group["sketch"].combine_chunks())
        head = np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64)
        rows: list[tuple] = []
        for b, n in zip(begin.tolist(), size.tolist(), strict=True):
            order = b + np.argsort(mix64(head[b : b + n] ^ np.uint64(nodes[b] & 0xFFFFFFFF)), kind="stable")
            same = agreement(x[order])
            of = leaders(same >= close)
            led = np.flatnonzero(of != np.arange(n))
            p, q = np.nonzero(np.triu(same >= least, 1))
            links = _forest(n, np.concatenate([of[led], p]), np.concatenate([led, q]))
            rows += [(keys[order[i]], keys[order[j]], nodes[b] if k < len(led) else None) for k, (i, j) in enumerate(links)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return dealt.select("bin", "block", "node", "key", "sketch").groupBy("bin").applyInArrow(run, "a binary, b binary, node long")


def _with_sizes(state: DataFrame) -> DataFrame:
    """Adds size to rows of nodes with two sets or more."""
    sizes = state.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return state.join(sizes, "node")


def in_blocks(members: DataFrame, group: str, size: str, key: str, block: int) -> DataFrame:
    """Deals the members of large groups to pairs of blocks (i, j), i <= j; `side` is the member's own block."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(key), blocks.cast("long")).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("side", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("i", F.least("side", "_other")).withColumn("j", F.greatest("side", "_other")).drop("_blocks", "_other")


def _dense_links(large: DataFrame, least: int) -> DataFrame:
    """Spanning links of what is still large: all pairs of sketches, a pair of blocks at a time."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keys, x = group["key"].to_pylist(), _sketches(group["sketch"].combine_chunks())
        side, i, j = group["side"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
        link = np.triu(agreement(x) >= least, 1)
        if i != j:
            link &= side[:, None] != side[None]
        out = _forest(len(x), *np.nonzero(link))
        return pa.table({"a": pa.array([keys[p] for p, _ in out], pa.binary()), "b": pa.array([keys[q] for _, q in out], pa.binary())})

    dealt = in_blocks(large, "node", "size", "key", 1024)
    return dealt.select("node", "i", "j", "side", "key", "sketch").groupBy("node", "i", "j").applyInArrow(run, "a binary, b binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared elements of all pairs of sets, by products of 0-1 matrices over the elements that two sets have."""
    sizes = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    useful = count[column] > 1
    row, column = row[useful], column[useful]
    number = np.cumsum(count > 1) - 1
    column = number[column]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, int((count > 1).sum()) + width, width))
    for k in range(len(cuts) - 1):
        r, c = row[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * width
        m = np.zeros((len(sets), width), np.float32)
        m[r, c] = 1
        out += m @ m.T
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    size = np.array([len(s) for s in sets], np.float64)
    shared = overlaps(sets).astype(np.float64)
    union = size[:, None] + size[None] - shared
    link = shared >= threshold * union - 1e-9
    np.fill_diagonal(link, False)
    return link


_LINKS = "key binary, links long, to binary"


def _exact(dealt: DataFrame, threshold: float, words: int) -> DataFrame:
    """(key, links, to): a row for each compared set with its links there, and spanning links (with links 0)."""

    def run(group: pa.Table) -> pa.Table:
        keys, sides, comps = group["key"].to_pylist(), group["side"].to_pylist(), group["component"].to_pylist()
        sets = [np.frombuffer(s, "<u8") for s in group["shingles"].to_pylist()]
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        rows: list[tuple] = []
        of: dict = {}
        for k, c in enumerate(comps):
            of.setdefault(c, []).append(k)
        for own in of.values():
            if len(own) < 2:
                continue
            link = linked([sets[k] for k in own], threshold)
            if i != j:
                side = np.array([sides[k] for k in own])
                link &= side[:, None] != side[None]
            rows += [(keys[own[p]], int(n), None) for p, n in enumerate(link.sum(axis=1)) if n]
            rows += [(keys[own[p]], 0, keys[own[q]]) for p, q in _forest(len(own), *np.nonzero(np.triu(link, 1)))]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["key", "links", "to"])

    return dealt.groupBy("bin", "i", "j").applyInArrow(run, _LINKS)


def near_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.999
) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id among all linked to it, directly or by others),
    copy_id (the smallest id with the very same shingles) and n_links (linked sets other than its own).

    Similarity is the Jaccard coefficient of the sets of word runs (split at white space, unchanged). Texts of fewer
    words are one shingle; null and empty texts have none and stay alone, each a class of its own. Null ids come
    after all others. Repeated rows share a class and count as one set.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    marked = written(_sketched(base, words), "sketches")
    reps = written(marked.where("key is not null").groupBy("key").agg(F.min("doc").alias("rep"), F.first("sketch").alias("sketch")), "sets")
    least, close = math.ceil(COORDS * (threshold - SLACK)), math.ceil(COORDS * (threshold - LED))

    drawn = reps.select("key", "sketch")
    links: list[DataFrame] = []

    def compare(rows: DataFrame, n: int) -> None:
        if n:
            links.append(written(_small_links(rows, least, _bins(rows, n)).distinct(), "met"))

    def parts(rows: DataFrame) -> tuple[DataFrame, int, DataFrame, int]:
        small, large = (rows.where(c) for c in (F.col("size") <= SMALL, F.col("size") > SMALL))
        return small, small.count(), large, large.count()

    # Sketches are joined to the roots' nodes once, then travel with the few sets that go further down.
    rows = _roots(reps, runs_for(recall, threshold), threshold)
    for depth in range(1, DEPTH + 1):
        state = written(rows, "paths")
        sized = written(_with_sizes(state), "nodes")
        small, n_small, large, n_large = parts(sized)
        compare(small.join(drawn, "key") if depth == 1 else small, n_small)
        if not n_large:
            break
        if depth == 1:
            large = written(large.join(drawn, "key"), "large")
        led = written(_led(large, least, close, _bins(state, n_large)), "led")
        links.append(led.select("a", "b").distinct())
        gone = led.where("node is not null").select("node", F.col("b").alias("key"))
        lost = gone.groupBy("node").agg(F.count("*").alias("lost"))
        stay = large.join(gone, ["node", "key"], "left_anti").join(lost, "node", "left").withColumn("size", F.col("size") - F.coalesce("lost", F.lit(0)))
        rest = written(stay.where("size > 1").select("node", "key", "size", "sketch"), "rest")
        small, n_small, large, n_large = parts(rest)
        compare(small, n_small)
        if n_large and depth == DEPTH:
            links.append(written(_dense_links(large, least).distinct(), "met"))
        discard(state, sized)
        if not n_large:
            break
        rows = _split(large, threshold)
    none = spark.range(0).select(*(F.lit(None).cast("binary").alias(c) for c in ("a", "b")))
    found = reduce(DataFrame.union, links, none)

    groups = written(connected_components(found).withColumnRenamed("node", "key"), "groups")
    members = groups.join(groups.groupBy("component").agg(F.count("*").alias("size")), "component")
    members = members.join(reps.select("key", "rep"), "key").withColumnRenamed("rep", "doc")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts_of(batch.column("text")), words)
            keys = batch.column("key").to_pylist()
            keep = [k for k, s in enumerate(sets) if len(s) and set_key(s) == keys[k]]
            at = pa.array(keep, pa.int64())
            cols = [batch.column(c).take(at) for c in ("key", "component", "size")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([sets[k].astype("<u8").tobytes() for k in keep], pa.binary())], names=["key", "component", "size", "shingles"])

    texts = base.join(members, "doc").select("key", "component", "size", "text")
    sets = written(texts.mapInArrow(to_sets, "key binary, component binary, size long, shingles binary").dropDuplicates(["key"]), "members")
    bins = _bins(sets, sets.count(), 4096)
    few = sets.where(F.col("size") <= BLOCK).select(F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "component", "key", "shingles")
    many = in_blocks(sets.where(F.col("size") > BLOCK), "component", "size", "key", BLOCK)
    many = many.select(F.xxhash64("component").alias("bin"), "i", "j", "side", "component", "key", "shingles")
    links = written(_exact(few, threshold, words).union(_exact(many, threshold, words)), "links")

    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    classes = connected_components(links.where("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "key")
    named = classes.join(reps.select("key", "rep"), "key")
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("class")), "component").select("key", "class").join(counts, "key")
    info = reps.select("key", "rep").join(named, "key", "left")
    joined = marked.select("doc", "key").join(info, "key", "left")

    def back(c):
        return F.when(c == NO_ID, F.lit(None)).otherwise(c)

    kind = docs.schema[id_col].dataType
    return joined.select(
        back(F.col("doc")).cast(kind).alias("doc_id"),
        back(F.coalesce("class", "rep", "doc")).cast(kind).alias("class_id"),
        back(F.coalesce("rep", "doc")).cast(kind).alias("copy_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of which no other of the same class has a smaller id; all columns stay, whatever their names.

    Of rows with the kept id one stays where they have equal texts. Null and empty texts all stay, and so do rows
    without an id where no other of their class has one. An empty table gives no rows.
    """
    kept_id, n_rows, text_hash = (unused(docs.columns, c) for c in ("kept_id", "n_rows", "text_hash"))
    found = near_join(docs, id_col, text_col, **options)
    kept = found.where(F.col("class_id").eqNullSafe(F.col("doc_id"))).groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias(n_rows))
    rows = docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]), "inner").drop(kept_id)
    empty = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) == 0
    single = (F.col(n_rows) == 1) | empty
    twice = rows.where(~single).withColumn(text_hash, F.xxhash64(text_col)).dropDuplicates([id_col, text_hash])
    return rows.where(single).drop(n_rows).unionByName(twice.drop(n_rows, text_hash))
