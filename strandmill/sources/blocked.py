"""Writing sorted, indexed files of blocked gzip in parallel.

Rows are dealt by ranges of (contig, place) and sorted; every task makes the blocks of its part and the bins of its
rows; the driver joins the parts' bytes, a bounded piece at a time, and the bins, shifted by what lies before them. With
`join=False` every part stays a file with a header and an index of its own, and no rows pass the driver. A task that is
tried again writes a part of its own, and only parts of tasks that ended count.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import bgzf
from .bgzf import Contig, Index, store_of


@dataclass
class Written(WriterCommitMessage):
    number: int
    path: str
    size: int
    index: bytes


class BlockedWriter(DataSourceArrowWriter):
    """Rows in order within a task, tasks in order of their numbers. Subclasses say what a row's bytes are."""

    ending, index_ending = "", ""

    def __init__(self, options: dict[str, str]):
        self.path, self.head, self.join = options["target"], base64.b64decode(options["head"]), options["join"] == "true"
        self.run = uuid.uuid4().hex

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, int, bytes]]:
        """Contig (None: without a place), first place from 0, end, and bytes of each row."""
        raise NotImplementedError

    def index_bytes(self, index: Index) -> bytes:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        number, attempt = context.partitionId(), context.taskAttemptId()
        path = f"{self.path}.parts-{self.run}/{number:05d}-{attempt}{self.ending}"
        store, name = store_of(path)
        store.create_dir(name.rpartition("/")[0], recursive=True)
        contigs: dict[str, Contig] = {}
        before: tuple[str | None, int] | None = None
        with store.open_output_stream(name, compression=None) as sink:
            out = bgzf.Writer(sink)
            if not self.join:
                out.write(self.head)
            for batch in iterator:
                for chrom, start, end, data in self.rows(batch):
                    if before is not None and (before[0] == chrom and chrom is not None and before[1] > start or before[0] != chrom and (chrom in contigs or before[0] is None)):
                        raise ValueError(f"rows are not in order: {chrom} {start} after {before[0]} {before[1]}")
                    before = chrom, start
                    low = out.tell()
                    out.write(data)
                    if chrom is not None:
                        contigs.setdefault(chrom, Contig()).add(start, end, low, out.tell())
            out.flush()
            if not self.join:
                sink.write(bgzf.END)
        return Written(number, path, out.written, Index(list(contigs.values()), list(contigs)).to_bytes())

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        store, target = store_of(self.path)
        if not self.join:
            store.create_dir(target, recursive=True)
            for k, m in enumerate(parts):
                name = f"{target}/part-{k:05d}{self.ending}"
                store.move(store_of(m.path)[1], name)
                self._index(store, name, Index.parse(m.index))
            self._clear()
            return
        indexes = []
        with store.open_output_stream(target, compression=None) as sink:
            out = bgzf.Writer(sink)
            out.write(self.head)
            out.flush()
            at = out.written
            for m in parts:
                indexes.append(Index.parse(m.index).shifted(at))
                part = store_of(m.path)[1]
                with store.open_input_stream(part, compression=None) as source:
                    while piece := source.read(8 << 20):
                        sink.write(piece)
                store.delete_file(part)  # else all bytes would lie there twice
                at += m.size
            sink.write(bgzf.END)
        self._index(store, target, bgzf.joined(indexes))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _index(self, store: pafs.FileSystem, name: str, index: Index) -> None:
        with store.open_output_stream(name + self.index_ending, compression=None) as f:
            f.write(self.index_bytes(index))

    def _clear(self) -> None:
        store, folder = store_of(f"{self.path}.parts-{self.run}")
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


def in_order(rows: DataFrame, contigs: list[str], order: list[str], parts: int | None) -> DataFrame:
    """Rows dealt and sorted by contig (as given, others after them by their bytes, `*` last) and `order`.

    `parts`: as many as there are shuffle partitions unless given, as a row costs more to write than its bytes tell.
    """
    known = F.array_position(F.array(*[F.lit(c) for c in contigs]).cast("array<string>"), F.col("chrom"))
    by = [F.when(known > 0, known).when(F.col("chrom") == "*", F.lit(1 << 31)).otherwise(F.lit(1 << 30)), F.col("chrom"), *(F.col(c) for c in order)]
    return rows.repartitionByRange(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)


def write_blocked(rows: DataFrame, source: type[DataSource], path: str, head: bytes, join: bool, **options: str) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(source)
    writer = rows.write.format(source.name()).mode("append").option("target", path).option("head", base64.b64encode(head).decode())
    writer.option("join", str(join).lower()).options(**options).save()
