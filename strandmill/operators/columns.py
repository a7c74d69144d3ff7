"""Reads of a locus in fixed columns: every place of the reference has a column, and before it as many as the longest
insertion there. A locus gathers its insertions (one number for each place that has one) and its bounds, not its reads.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigars as cg


def layout(reads: DataFrame) -> DataFrame:
    """(locus, first, last, gaps): the places that reads cover, and the longest insertion before places that have one.

    reads: locus, pos, end_pos, cigar (M, I, D, S, H, =, X). Clips take no columns.
    """
    def inserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size: dict[tuple[int, int], int] = {}
            for locus, pos, cigar in zip(*(cg.texts(batch.column(c)) for c in ("locus", "pos", "cigar")), strict=True):
                for at, n, _ in _steps(cigar)[1]:
                    size[locus, pos + at] = max(n, size.get((locus, pos + at), 0))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in size], pa.int64()), pa.array([x for _, x in size], pa.int64()), pa.array(list(size.values()), pa.int32())], names=["locus", "at", "size"])

    gapped = reads.where(F.col("cigar").contains("I") & F.col("locus").isNotNull()).select(*(F.col(c).cast("long").alias(c) for c in ("locus", "pos")), "cigar")
    added = gapped.mapInArrow(inserted, "locus long, at long, size int").groupBy("locus", "at").agg(F.max("size").alias("size"))
    gaps = added.groupBy("locus").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("gaps"))
    bounds = reads.groupBy("locus").agg(F.min("pos").alias("first"), F.max("end_pos").alias("last"))
    return bounds.join(gaps, "locus", "left").withColumn("gaps", F.coalesce("gaps", F.expr("cast(map() as map<bigint,int>)")))


def _gap(gaps: Column, place: Column) -> Column:
    return F.coalesce(gaps[place], F.lit(0))


def _places(low: Column, high: Column) -> Column:
    """low to high - 1, none if there are none."""
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))


@functools.lru_cache(1 << 14)
def _steps(cigar: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Matches and insertions of a read: place from its first one on, length, and the read's bases before it."""
    matches, added, at, seen = [], [], 0, 0
    for op, n in cg.elements(cigar):
        if op in cg.MATCHES:
            matches.append((at, n, seen))
        if op == "I":
            added.append((at, n, seen))
        at += n if op in cg.ON_REF else 0
        seen += n if op in cg.ON_READ else 0
    return matches, added


def row_text(cigar: str, bases: str, pos: int, end_pos: int, first: int, last: int, gaps: dict[int, int]) -> str:
    """A read's columns from `first` to `last`: its bases, `-` for what it lacks, spaces beyond its ends."""
    matches, added = _steps(cigar)
    cells = ["-"] * (end_pos - pos)
    for at, n, seen in matches:
        held = bases[seen : seen + n]
        cells[at : at + n] = held if len(held) == n else [*held, *[""] * (n - len(held))]
    del cells[max(0, end_pos - pos) :]
    cells = [*" " * (pos - first), *cells, *" " * (last - end_pos), ""]
    own = {pos + at: bases[seen : seen + n] for at, n, seen in reversed(added)}
    for p, n in gaps.items():
        # Insertions before the read's first place are no part of it; one behind its last stands before the next column.
        if first <= p <= last:
            text = own[p][:n].ljust(n, "-") if pos <= p <= end_pos and p in own else ("-" if pos < p < end_pos else " ") * n
            cells[p - first] = text + cells[p - first]
    return "".join(cells)


def overlaid(reads: DataFrame, *more: str) -> DataFrame:
    """(rid, locus, first, last, gaps, row, and more columns of the reads): all rows of a locus are of one width. Columns
    that only reads elsewhere need are not there, as the layout is that of these reads. Reads without a CIGAR take no
    part."""
    reads = reads.where(F.col("cigar") != "")
    rows = reads.select("rid", "locus", F.col("pos").cast("long").alias("pos"), F.col("end_pos").cast("long").alias("end_pos"), "bases", "cigar", *more)
    joined = rows.join(layout(reads), "locus").withColumn("first", F.col("first").cast("long")).withColumn("last", F.col("last").cast("long"))

    @F.arrow_udf("string")
    def run(cigar: pa.Array, bases: pa.Array, pos: pa.Array, end_pos: pa.Array, first: pa.Array, last: pa.Array, gaps: pa.Array) -> pa.Array:
        cut, places, sizes = gaps.offsets.to_numpy().tolist(), cg.texts(gaps.keys), cg.texts(gaps.items)
        rows = zip(*(cg.texts(x) for x in (cigar, bases, pos, end_pos, first, last)), strict=True)
        return pa.array([None if None in r else row_text(*r, dict(zip(places[a:b], sizes[a:b], strict=True))) for r, a, b in zip(rows, cut, cut[1:], strict=False)], pa.string())

    return joined.select("rid", "locus", "first", "last", "gaps", run("cigar", "bases", "pos", "end_pos", "first", "last", "gaps").alias("row"), *more)


def reference_row(ref: Column, ref_start: Column, first: Column, last: Column, gaps: Column) -> Column:
    """The reference in the same columns, `-` where reads insert."""
    base = lambda p: F.concat(F.repeat(F.lit("-"), _gap(gaps, p).cast("int")), F.substring(ref, (p - ref_start + 1).cast("int"), F.lit(1)))
    return F.concat(F.array_join(F.transform(_places(first, last), base), ""), F.repeat(F.lit("-"), _gap(gaps, last).cast("int")))


def html_row(row: Column, reference: Column) -> Column:
    """Table cells of a row: letters that differ from the reference's column in bold, spaces as empty cells."""

    class Cells(dict):
        def __missing__(self, pair: tuple[str, str]) -> str:
            a, b = pair
            self[pair] = made = "<td></td>" if a == " " else f"<td>{a}</td>" if a == b else f"<td><b>{a}</b></td>"
            return made

    @F.arrow_udf("string")
    def run(row: pa.Array, reference: pa.Array) -> pa.Array:
        cell = Cells().__getitem__

        def cells(a: str, b: str) -> str:
            return "".join(map(cell, zip(a, b.ljust(len(a), "\0"), strict=False))) if a else cell(("", b[:1]))

        return pa.array([None if a is None or b is None else f"<tr>{cells(a, b)}</tr>" for a, b in zip(cg.texts(row), cg.texts(reference), strict=True)], pa.string())

    return run(row, reference)


def homopolymers(sequences: DataFrame, most: int = 1 << 17) -> DataFrame:
    """(doc_id, k, base, n, start) of the runs of equal letters A, C, G and T of each sequence (doc_id, seq), k from 1;
    start counts such letters only. Nothing is shuffled; about `most` rows leave at a time."""
    letters = pa.array(list("ACGT"))
    code = np.full(256, -1, np.int8)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)

    def give(docs: list, runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(n) for _, n in runs]
        base = pa.DictionaryArray.from_arrays(pa.array(np.concatenate([b for b, _ in runs]), pa.int8()), letters).cast(pa.string())
        ids = pa.array(docs).take(pa.array(np.repeat(np.arange(len(docs)), sizes)))
        k, n, start = (np.concatenate(x) for x in ([np.arange(1, x + 1) for x in sizes], [n for _, n in runs], [np.cumsum(n) - n for _, n in runs]))
        return pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(k, pa.int64()), base, pa.array(n, pa.int64()), pa.array(start, pa.int64())], names=["doc_id", "k", "base", "n", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, runs, held = [], [], 0
        for batch in batches:
            for doc, seq in zip(batch.column("doc_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                at = code[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
                first = np.flatnonzero(np.diff(at, prepend=np.int8(-2)))
                n, base = np.diff(first, append=len(at)), at[first]
                docs.append(doc)
                runs.append((base[base >= 0], n[base >= 0]))
                held += len(n)
                if held >= most:
                    yield give(docs, runs)
                    docs, runs, held = [], [], 0
        if docs:
            yield give(docs, runs)

    name = sequences.schema["doc_id"].dataType
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name.simpleString()]
    return sequences.mapInArrow(run, f"doc_id {name.simpleString()}, k long, base string, n long, start long")
