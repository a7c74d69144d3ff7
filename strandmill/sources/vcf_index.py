"""VCF in blocked gzip with a tabix index: read by regions or in parts, written in parallel as one sorted file.

Rows are written as `blocked` says: parts in order, joined to one file or left as a folder of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from . import bgzf, text
from .bgzf import File, Index
from .blocked import BlockedWriter, in_order, write_blocked
from .indexed import SPLIT, Part, RegionReader, cut, listed, load, load_index, pieces

_SCHEMA = "chrom string, pos int, end_pos int, value string"
_ARROW = pa.schema([("chrom", pa.string()), ("pos", pa.int32()), ("end_pos", pa.int32()), ("value", pa.string())])


def place_of(line: bytes) -> tuple[str, int, int]:
    """Contig, place from 1 and last place (that of INFO END if there is one) of a row."""
    chrom, pos, _, ref, _ = line.split(b"\t", 4)
    start = int(pos)
    end = start + len(ref) - 1
    fields = line.split(b"\t", 8)
    if len(fields) > 7:
        for item in fields[7].rstrip(b"\n").split(b";"):
            if item.startswith(b"END=") and item[4:].isdigit():
                end = max(end, int(item[4:]))
    return chrom.decode(), start, end


class VcfReader(RegionReader):
    low, high, first, ending = "pos", "end_pos", 1, ".vcf.gz"

    def plan(self, file: File, regions: list | None) -> list[Part]:
        if not bgzf.is_blocked(file):
            raise ValueError(f"{file.path} is no blocked gzip file")
        index = load_index(file.path, [".tbi"], newer=True)
        if regions is None or index is None:
            return cut(file.path, file.size, index, self.split)
        at = {n: k for k, n in enumerate(index.names)}
        return pieces(file.path, [s for c, a, b in regions for s in index.stretches(at.get(c, -1), a, b)], index.starts(), self.split)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(part):
            held.append(row)
            if len(held) == 2000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def rows(self, part: Part, file: File | None = None) -> Iterator[tuple[str, int, int, str]]:
        """A row belongs to the part in whose blocks it begins: a part that is not aligned skips the rest of a line
        begun before it, and the last line of a part is read to its end beyond it."""
        if not part.path:
            return
        wanted = self.window.regions(self.given)
        file = file or File(part.path)
        for low, high in part.stretches:
            start = low if part.aligned else bgzf.next_block(file, low >> 16) << 16
            stream = bgzf.Stream(file, start, high)
            if not part.aligned and start < high and not _line_ends_before(file, start >> 16):
                stream.line()
            while stream.tell() < high and (line := stream.line()):
                if line[:1] == b"#" or not line.strip():
                    continue
                chrom, pos, end = place_of(line)
                if wanted is None or any(chrom == c and pos - 1 < b and end > a for c, a, b in wanted):
                    yield chrom, pos, end, line.rstrip(b"\r\n").decode()


def _line_ends_before(file: File, at: int) -> bool:
    """Whether the data before the block at `at` ends a line: read from the nearest block that holds data."""
    back = 1 << 17
    while at > 0:
        first = bgzf.next_block(file, max(0, at - back))
        last = b""
        for offset, data, _ in bgzf.blocks(file, first, stop=at):
            if offset >= at:
                break
            last = data or last
        if last or first == 0:
            return last[-1:] in (b"\n", b"")
        back *= 2
    return True


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class VcfWriter(BlockedWriter):
    ending, index_ending = ".vcf.gz", ".tbi"

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, bytes]]:
        for value in batch.column("value").to_pylist():
            line = value.encode() + b"\n"
            chrom, pos, end = place_of(line)
            yield chrom, pos - 1, end, line

    def index_bytes(self, index: Index) -> bytes:
        return b"".join(bgzf.block(data) for data in _cut(index.to_bytes())) + bgzf.END


def _cut(data: bytes) -> Iterator[bytes]:
    for k in range(0, len(data), bgzf.MOST):
        yield data[k : k + bgzf.MOST]


class VcfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandmill_vcf"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> VcfReader:
        return VcfReader(self.options)

    def writer(self, schema, overwrite: bool) -> VcfWriter:
        return VcfWriter(self.options)


def read_vcf_lines(spark: SparkSession, path: str | list[str], regions: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> DataFrame:
    """(chrom, pos, end_pos, value): rows of blocked VCF files, folders of them or patterns; pos from 1, end_pos the last
    place. Filters on chrom, pos and end_pos, and `regions` (half-open, from 0), read only the blocks that the tabix
    index names; an index older than its file is an error. Files without an index are cut at their blocks."""
    return load(spark, VcfSource, path, regions, split)


def read_vcf(spark: SparkSession, path: str | list[str], regions: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> DataFrame:
    return text.variants_of(read_vcf_lines(spark, path, regions, split))


def header_of(path: str) -> list[str]:
    """Header lines of a blocked VCF file, a folder of them or a pattern (of the first file)."""
    stream, out = bgzf.Stream(File(listed([path], ".vcf.gz")[0]), 0, 1), []
    while (line := stream.line()).startswith(b"#"):
        out.append(line.rstrip(b"\r\n").decode())
    return out


def write_vcf(rows: DataFrame, path: str, head: list[str], contigs: list[str] | None = None, join: bool = True, parts: int | None = None) -> None:
    """Writes rows (chrom, pos, value: the line) sorted by contig, in the order given or of their bytes, and place.

    path: a file with its .tbi beside it, or with join=False a folder of such files. Rows of one place follow each other
    by their text, whatever the partitions, of which there are `parts`, or as many as shuffle partitions. No rows give a file of the header alone.
    """
    lines = rows.select("chrom", F.col("pos").cast("int").alias("pos"), F.lit(0).alias("end_pos"), "value")
    write_blocked(in_order(lines, contigs or [], ["pos", "value"], parts), VcfSource, path, "".join(f"{line}\n" for line in head).encode(), join)
