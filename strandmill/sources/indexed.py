"""Reading parts of position-sorted files: windows taken from filters, and tasks planned from indexes.

A region filter becomes the stretches of virtual offsets that its index names, and only their blocks are read. Without
a region, files are cut to tasks of about `split` compressed bytes, where rows begin by the index, or, without one, at
the blocks themselves. Spark applies all filters again, so a window may be wider than what is asked for.
"""

from __future__ import annotations

import bisect
import fnmatch
import json
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from .bgzf import File, Index, store_of

SPLIT = 4 << 20
FAR = 1 << 29
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Part(ds.InputPartition):
    """Rows that begin within the stretches [low, high) (virtual offsets) of a file; `aligned`: a row begins at each
    low. `whole`: a file that has no blocks."""

    path: str
    stretches: list[tuple[int, int]]
    aligned: bool = True
    whole: bool = False


@dataclass
class Window:
    """What conjunctive filters leave of (chrom, [start, end)), 0-based."""

    chroms: set[str] | None = None
    start: int = 0
    end: int = FAR

    def keep(self, chroms: Iterable[str]) -> None:
        self.chroms = set(chroms) if self.chroms is None else self.chroms & set(chroms)

    def narrow(self, filters: list[ds.Filter], low: str, high: str, first: int) -> None:
        """`low` is the column of a row's first place, counted from `first`; `high` of its end, exclusive."""
        for f in filters:
            name, value = ".".join(f.attribute) if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if name == "chrom" and isinstance(f, (ds.EqualTo, ds.In)):
                self.keep([value] if isinstance(f, ds.EqualTo) else f.value)
            elif name in (low, high) and isinstance(value, int):
                shift = first if name == low else 0
                if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)):
                    self.end = min(self.end, value - shift + (not isinstance(f, ds.LessThan)))
                if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)):
                    over = isinstance(f, ds.GreaterThan)
                    # A row that ends beyond `value` holds the place before; one that begins there holds its own.
                    self.start = max(self.start, value - shift + over if name == low else value + over - 1)

    def regions(self, given: list[tuple[str, int, int]] | None) -> list[tuple[str, int, int]] | None:
        """The windows to read, None for the whole file. `given`: half-open regions to choose from."""
        if given is None:
            return None if self.chroms is None else [(c, self.start, self.end) for c in sorted(self.chroms)]
        cut = [(c, max(a, self.start), min(b, self.end)) for c, a, b in given if self.chroms is None or c in self.chroms]
        return [r for r in cut if r[1] < r[2]]


def load_index(path: str, endings: list[str], newer: bool = False) -> Index | None:
    """The index beside a file. `newer`: one that is older than the file is an error, as its offsets may be wrong."""
    store, name = store_of(path)
    own = store.get_file_info(name)
    for ending in endings:
        at = name[: -len(ending[1])] + ending[0] if isinstance(ending, tuple) else name + ending
        info = store.get_file_info(at)
        if info.type == pafs.FileType.File:
            if newer and info.mtime_ns is not None and own.mtime_ns is not None and info.mtime_ns < own.mtime_ns:
                raise ValueError(f"the index of {path} is older than the file")
            with store.open_input_stream(at, compression=None) as f:
                return Index.parse(f.read())
    return None


def pieces(path: str, stretches: list[tuple[int, int]], starts: list[int], split: int) -> list[Part]:
    """Stretches as tasks of about `split` bytes: joined where they overlap, cut where rows begin, short ones together."""
    whole: list[list[int]] = []
    for low, high in sorted(stretches):
        if whole and low <= whole[-1][1]:
            whole[-1][1] = max(high, whole[-1][1])
        else:
            whole.append([low, high])
    out: list[Part] = []
    held = split
    for low, high in whole:
        edges = [low]
        for at in starts[bisect.bisect_right(starts, low) : bisect.bisect_left(starts, high)]:
            if (at >> 16) - (edges[-1] >> 16) >= split:
                edges.append(at)
        for a, b in zip(edges, [*edges[1:], high], strict=True):
            if held >= split:
                out.append(Part(path, []))
                held = 0
            out[-1].stretches.append((a, b))
            held += (b >> 16) - (a >> 16) + 1
    return out


def cut(path: str, size: int, index: Index | None, split: int, first: int = 0) -> list[Part]:
    """A whole file as tasks, from virtual offset `first` on."""
    end = size << 16
    if index is not None:
        edges = [first]
        for at in index.starts():
            if at > edges[-1] and (at >> 16) - (edges[-1] >> 16) >= split:
                edges.append(at)
        return [Part(path, [(a, b)]) for a, b in zip(edges, [*edges[1:], end], strict=True)]
    edges = [first, *(x << 16 for x in range((first >> 16) + split, size, split))]
    return [Part(path, [(a, b)], aligned=k == 0) for k, (a, b) in enumerate(zip(edges, [*edges[1:], end], strict=True))]


def listed(paths: list[str], ending: str) -> list[str]:
    """Files, folders (their files of that ending) and patterns of file names, as files in the order given."""
    out = []
    for path in paths:
        store, name = store_of(path)
        head, _, tail = name.rpartition("/")
        if any(c in tail for c in "*?["):
            found = [i.path for i in store.get_file_info(pafs.FileSelector(head or ".")) if fnmatch.fnmatch(i.base_name, tail)]
        elif store.get_file_info(name).type == pafs.FileType.Directory:
            found = [i.path for i in store.get_file_info(pafs.FileSelector(name)) if i.base_name.endswith(ending)]
        else:
            found = [name]
        before = path[: len(path) - len(name)] if path.endswith(name) else ""
        out += [before + f for f in sorted(found)]
    return out


class RegionReader(ds.DataSourceReader):
    """A reader whose filters on chrom and places narrow what is read. Subclasses plan and read one file."""

    low, high, first, ending = "pos", "end_pos", 0, ""

    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["files"])
        self.split = int(options.get("split", SPLIT))
        self.given = [tuple(r) for r in json.loads(options["regions"])] if options.get("regions") else None
        self.window = Window()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        self.window.narrow(filters, self.low, self.high, self.first)
        return filters

    def partitions(self) -> list[Part]:
        wanted = self.window.regions(self.given)
        return [p for path in listed(self.paths, self.ending) for p in self.plan(File(path), wanted)] or [Part("", [])]

    def plan(self, file: File, regions: list[tuple[str, int, int]] | None) -> list[Part]:
        raise NotImplementedError


def load(spark: SparkSession, source: type[ds.DataSource], path: str | list[str], regions: list[tuple[str, int, int]] | None, split: int) -> DataFrame:
    spark.dataSource.register(source)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format(source.name()).option("files", json.dumps([path] if isinstance(path, str) else list(path))).option("split", split)
    return (reader.option("regions", json.dumps(regions)) if regions is not None else reader).load()
