"""Read operators: what a CIGAR, qualities and the reference say of one read, column by column or in Arrow batches.

What a regular expression or an expression over CIGAR elements can say stays in the JVM. Walks along a CIGAR (trims,
adapters, shifts of an end, bases at positions) run over a batch, in `edited`, and only those asked for.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ends
from ..functions import genetics as g
from ..functions import kernels as k
from ..functions import read_ops as ro

# The least bases that agree at both ends, and the least before an indel.
END_MATCHES, END_TO_INDEL = 10, 7


def low_quality_ends(quals: Column, below: str = "!-4") -> tuple[Column, Column]:
    """How many qualities of the class stand at the start, and at the end of what is left."""
    left = F.length(F.regexp_extract(quals, f"^[{below}]*", 0))
    rest = F.regexp_replace(quals, f"^[{below}]*", "")
    return left, F.length(F.regexp_extract(rest, f"[{below}]*$", 0))


def before_indel(cigar: Column) -> tuple[Column, Column]:
    """Matched bases before the first indel from either end; -1 without an indel."""

    def sum_of(text: Column) -> Column:
        return g.cigar_sum(g.cigar_elements(text), "M=X")

    first, last = F.regexp_extract(cigar, r"^((?:\d+[^ID\d])*)\d+[ID]", 1), F.regexp_extract(cigar, r"\d+[ID]((?:\d+[^ID\d])*)$", 1)
    none = ~cigar.rlike("[ID]")
    return F.when(none, -1).otherwise(sum_of(first)), F.when(none, -1).otherwise(sum_of(last))


def ends_match(cigar: Column, bases: Column, pos: Column, end: Column, ref: Column, ref_start: Column, least: int = END_MATCHES) -> Column:
    """Whether at least so many bases agree with the reference at both ends, without a gap or clip."""
    first = F.regexp_extract(cigar, r"^(\d+)[M=X]", 1).try_cast("int")
    last = F.regexp_extract(cigar, r"(\d+)[M=X]$", 1).try_cast("int")
    n = F.lit(least)
    same = (F.upper(F.left(bases, n)) == F.upper(F.substring(ref, pos - ref_start + 1, n))) & (F.upper(F.right(bases, n)) == F.upper(F.substring(ref, end - ref_start - least + 1, n)))
    return F.coalesce((first >= least) & (last >= least) & same, F.lit(False))


def clips(cigar: Column) -> dict[str, Column]:
    """Whether the read starts or ends with a soft or hard clip, and whether it matches the reference from end to end."""
    return {
        "starts_soft": cigar.rlike(r"^\d+S"),
        "ends_soft": cigar.rlike("S$"),
        "starts_hard": cigar.rlike(r"^\d+H"),
        "ends_hard": cigar.rlike("H$"),
        "matches": cigar.rlike(r"^(\d+[M=])+$"),
    }


def unclipped_bases(cigar: Column, bases: Column) -> Column:
    """The bases without soft clips."""
    left = F.coalesce(F.regexp_extract(cigar, r"^(\d+)S", 1).try_cast("int"), F.lit(0))
    right = F.coalesce(F.regexp_extract(cigar, r"\D(\d+)S$", 1).try_cast("int"), F.lit(0))
    return F.substring(bases, left + 1, F.length(bases) - left - right)


def tagged_sam(row: dict[str, Column], reason: Column) -> Column:
    """A SAM line (name, flag, chromosome, position from 1, quality, cigar, bases, qualities) with the reason as FT."""
    fields = [row["name"], F.lit("0"), row["chrom"], (row["pos"] + 1).cast("string"), F.lit("60"), F.when(row["cigar"] == "", "*").otherwise(row["cigar"]), F.lit("*"), F.lit("0"), F.lit("0"), row["bases"], row["quals"]]
    return F.concat_ws("\t", *fields, F.concat(F.lit("FT:Z:"), reason))


def write_filtered(reads: DataFrame, path: str) -> None:
    """Lines of `tagged_sam` (column line) as text files."""
    reads.select("line").write.text(path)


#: What `edited` adds, by part.
_EDITED = {
    "low": "low_pos int, low_cigar string, low_bases string",
    "adapter": "adapter_at int, adapter_cigar string, adapter_bases string",
    "near": "near_pos int, near_bases string",
    "inside": "length_change int, inside string",
    "ends": "largest_ends boolean",
    "snps": "snp_bases string",
}
#: Qualities below 5 (Phred 20).
_LOW = "".join(map(chr, range(ord("5"))))


@functools.lru_cache(1 << 16)
def _elements(cigar: str) -> tuple[tuple[str, int], ...]:
    return tuple((op, int(n)) for n, op in ro_split(cigar))


@functools.lru_cache(1 << 16)
def _trimmed(cigar: str, n: int, left: int, right: int) -> tuple[int, str]:
    """By how much the position moves, and the CIGAR, of a read of n bases that loses so many at its ends."""
    out = ro.trim(ro.Read(0, _elements(cigar), " " * n, ""), left, right)
    return out.pos, cigar_text(out.cigar)


@functools.lru_cache(1 << 16)
def _near(cigar: str, n: int, low: int, high: int) -> tuple[int, int, int]:
    """Bases that go at both ends, and by how much the position moves; low and high from the read's position on."""
    left, right = ro.ends_beyond(ro.Read(0, _elements(cigar), " " * n, ""), low, high)
    return left, n - right, _trimmed(cigar, n, left, right)[0]


def _low(r: dict) -> tuple:
    rest = r["quals"].lstrip(_LOW)
    n, left = len(r["bases"]), len(r["quals"]) - len(rest)
    right = len(rest) - len(rest.rstrip(_LOW))
    moved, cigar = _trimmed(r["cigar"], n, left, right)
    return r["pos"] + moved, cigar, r["bases"][left : max(left, n - right)]


def _adapter(r: dict) -> tuple:
    bases, n = r["bases"], len(r["bases"])
    at = ro.first_adapter(ro.complement(bases) if r["reverse"] else bases, r["mate"])
    if at is None:
        return 0, cigar_text(_elements(r["cigar"])), bases
    left, right = (n - at, 0) if r["reverse"] else (0, n - at)
    return n - at, _trimmed(r["cigar"], n, left, right)[1], bases[left : n - right]


def _near_locus(r: dict) -> tuple:
    pos, bases = r["pos"], r["bases"]
    left, til, moved = _near(r["cigar"], len(bases), r["start"] - 10 - pos, r["stop"] + 9 - pos)
    return pos + moved, bases[left : max(left, til)]


def _inside(r: dict) -> tuple:
    read = ro.Read(r["pos"], _elements(r["cigar"]), r["bases"], "")
    return ro.length_change(read, r["start"], r["stop"]), ro.sequence_between(read, r["start"], r["stop"])


def _at_snps(r: dict) -> tuple:
    return ("".join(b for b, _ in k.bases_at(list(_elements(r["cigar"])), r["bases"], r["quals"], r["pos"], r["at"] or [])),)


_PARTS = {"low": _low, "adapter": _adapter, "near": _near_locus, "inside": _inside, "snps": _at_snps}
#: Columns that each part reads.
NEEDS = {"low": "pos cigar bases quals", "adapter": "cigar bases mate reverse", "near": "pos cigar bases start stop", "inside": "pos cigar bases start stop", "snps": "pos cigar bases quals at", "ends": "pos cigar bases ref ref_start"}


def edited(reads: DataFrame, *parts: str) -> DataFrame:
    """Adds to reads (of cigar, bases, quals, pos, ref, ref_start, mate, reverse, start, stop, at array<int> those that
    the parts need; no part named: all of them):

    low_*: the read without its low-quality ends; adapter_*: without an adapter (adapter_at: bases cut, 0 for none);
    near_*: its part within 10 bases of [start, stop); length_change: inserted less deleted bases there; inside: its
    bases on [start, stop); largest_ends: no shift of an end agrees further; snp_bases: its bases at the positions `at`.
    Reads without a cigar get nulls.
    """
    parts = parts or tuple(_EDITED)
    extra = {p: T.StructType.fromDDL(_EDITED[p]) for p in parts}
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            for part, fields in extra.items():
                if part == "ends":
                    columns.append(ends.largest_end_matches(batch, _elements))
                    continue
                one, none = _PARTS[part], (None,) * len(fields)
                rows = [one(r) if r["cigar"] else none for r in batch.select(NEEDS[part].split()).to_pylist()]
                columns += [pa.array([r[i] for r in rows], kinds[f.dataType.simpleString()]) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f.name for fields in extra.values() for f in fields)])

    return reads.mapInArrow(run, T.StructType([*reads.schema.fields, *(f for fields in extra.values() for f in fields)]))


def ro_split(cigar: str) -> list[tuple[str, str]]:
    import re

    return re.findall(r"(\d+)([MIDNSHP=X])", cigar)


def cigar_text(elements) -> str:
    return "".join(f"{n}{op}" for op, n in elements)


def tagged_phases(reads: DataFrame, near: float = -0.01, far: float = -1000.0) -> DataFrame:
    """(rid, p1, p2) from haplotype tags (hp: 1, 2 or null); mates (equal sample and rname) must agree, else the read
    says nothing, and so does one of a pair whose other one has no tag."""
    mates = reads.groupBy("sample", "rname").agg(F.min("hp").alias("low"), F.max("hp").alias("high"), F.count("hp").alias("tagged"), F.count("*").alias("n"))
    hp = F.when((F.col("low") == F.col("high")) & (F.col("tagged") == F.col("n")), F.col("low"))
    found = reads.select("rid", "sample", "rname").join(mates.select("sample", "rname", hp.alias("hp")), ["sample", "rname"])

    def log(own: int) -> Column:
        return F.when(F.col("hp").isNull(), F.lit(0.0)).when(F.col("hp") == own, F.lit(near)).otherwise(F.lit(far))

    return found.select("rid", log(1).alias("p1"), log(2).alias("p2"))


def flank_paths(reads: DataFrame, k_min: int = 10, k_max: int = 15, least: float = 2, most: int = 10) -> DataFrame:
    """(locus, path, weight): sequences that a locus' reads spell between the ends of its reference, best first.

    reads: locus, bases, ref. Equal sequences arrive once with their number. A locus whose reference has no k between
    the bounds without a cycle, or whose pruned graph is cyclic, gives nothing.
    """
    counted = reads.groupBy("locus", "ref", "bases").agg(F.count("*").alias("n"))
    schema = pa.schema([("locus", pa.int64()), ("path", pa.string()), ("weight", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        ref = min(group["ref"].to_pylist())
        size = k.smallest_acyclic_k(ref, k_min, k_max)
        if size is None:
            return schema.empty_table()
        graph = k.DeBruijn.pruned(size, ref, group["bases"].to_pylist(), group["n"].to_pylist(), least)
        found = [] if graph.is_cyclic() else graph.paths(most)
        locus = group["locus"][0].as_py()
        return pa.Table.from_arrays([pa.array([locus] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.string()), pa.array([w for _, w in found], pa.int64())], schema=schema)

    return counted.groupBy("locus").applyInArrow(run, "locus long, path string, weight long")
