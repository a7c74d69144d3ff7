"""BAM as a DataFrame: tasks are stretches of blocks, regions are found by the index, records are decoded in Python.

For many passes over large files write the result as Parquet, partitioned by chromosome: then filters prune.
"""

from __future__ import annotations

import bisect
import binascii
import functools
import gzip
import io
import itertools
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from . import bgzf
from .bgzf import File
from .blocked import BlockedWriter, in_order, write_blocked
from .indexed import FAR, SPLIT, Part, RegionReader, cut, listed, load, load_index, pieces

_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_CODES = {c: k for k, c in enumerate(_BASES)}
#: Bytes of letters to the hexadecimal digit of their code, and back.
_DIGITS = bytes(b"0123456789abcdef"[_CODES.get(chr(c).upper(), 15)] for c in range(256))
_LETTERS = bytes(ord(_BASES[int(chr(c), 16)]) if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_LOWERED = bytes((c - 33) % 256 for c in range(256))
_PRINTED = bytes(min(93, q) + 33 for q in range(256))
_SCHEMA = "file string, name string, flag int, chrom string, pos int, end_pos int, mapq int, cigar array<struct<op:string,len:int>>, mate_chrom string, mate_pos int, bases string, quals string, tags map<string,string>"
_CIGAR = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
_ARROW = pa.schema(
    [("file", pa.string()), ("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int32()), ("end_pos", pa.int32()), ("mapq", pa.int32()), ("cigar", _CIGAR)]
    + [("mate_chrom", pa.string()), ("mate_pos", pa.int32()), ("bases", pa.string()), ("quals", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]
)
_SIZES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _tags(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            form = _SIZES[chr(data[at])]
            n = struct.unpack_from("<i", data, at + 1)[0]
            size = struct.calcsize(form)
            value = ",".join(str(struct.unpack_from(form, data, at + 5 + size * k)[0]) for k in range(n))
            at += 5 + size * n
        else:
            form = _SIZES[kind]
            value = str(struct.unpack_from(form, data, at)[0])
            at += struct.calcsize(form)
        out.append((name, value))
    return out


def read_header(take: Callable[[int], bytes], file: str) -> tuple[str, list[str], list[int]]:
    """The header's text, and the names and lengths of its contigs."""
    if take(4) != b"BAM\1":
        raise ValueError(f"{file} is no BAM file")
    text = take(struct.unpack("<i", take(4))[0]).rstrip(b"\0").decode()
    names, lengths = [], []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        lengths.append(struct.unpack("<i", take(4))[0])
    return text, names, lengths


@functools.lru_cache(1 << 14)
def _cigar_of(data: bytes) -> tuple[list[tuple[str, int]], int]:
    """A CIGAR's elements, and its bases on the reference."""
    cigar = [(_OPS[x & 15], x >> 4) for x in struct.unpack(f"<{len(data) // 4}I", data)]
    return cigar, sum(n for op, n in cigar if op in "MDN=X")


_few_tags = functools.lru_cache(1 << 14)(_tags)


def decode(r: bytes, names: list[str], file: str) -> dict:
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", r)
    at = 32 + n_name
    ops = r[at : at + 4 * n_cigar]
    cigar, size = _cigar_of(ops) if n_cigar <= 16 else _cigar_of.__wrapped__(ops)
    at += 4 * n_cigar
    mid = at + (n_seq + 1) // 2
    bases = binascii.hexlify(r[at:mid]).translate(_LETTERS)[:n_seq].decode()
    quals, rest = r[mid : mid + n_seq].translate(_PRINTED).decode(), r[mid + n_seq :]
    return {
        "file": file, "name": r[32 : 32 + n_name - 1].decode(), "flag": flag, "chrom": names[ref] if ref >= 0 else "*", "pos": pos,
        "end_pos": pos + size, "mapq": mapq, "cigar": cigar,
        "mate_chrom": names[mate_ref] if mate_ref >= 0 else "*", "mate_pos": mate_pos, "bases": bases, "quals": quals, "tags": _few_tags(rest) if len(rest) <= 64 else _tags(rest),
    }


def _exactly(stream, file: str) -> Callable[[int], bytes]:
    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise ValueError(f"{file} is cut off")
        return data

    return take


def parse(stream, file: str) -> Iterator[dict]:
    """Records of an uncompressed BAM stream; a cut-off file is an error."""
    take = _exactly(stream, file)
    _, names, _ = read_header(take, file)
    while head := stream.read(4):
        yield decode(take(struct.unpack("<i", head)[0]), names, file)


def plausible(data: bytes, at: int, lengths: list[int]) -> int | None:
    """Where the record after one at `at` begins, if what lies there could be a record."""
    if at + 36 > len(data):
        return None
    size, ref, pos, n_name, _, _, n_cigar, flag, n_seq, mate_ref, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fits = all(-1 <= x < len(lengths) and -1 <= p <= (lengths[x] if x >= 0 else FAR) for x, p in ((ref, pos), (mate_ref, mate_pos)))
    if not fits or n_name < 1 or n_seq < 0 or size < 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq or (n_cigar == 0 and not flag & 4 and n_seq > 0):
        return None
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    cigar = data[at + 36 + n_name : at + 36 + n_name + 4 * n_cigar]
    if n_cigar and len(cigar) == 4 * n_cigar:
        ops = np.frombuffer(cigar, "<u4")
        kinds = ops & 15
        if (kinds > 8).any() or (n_seq and int((ops >> 4)[np.isin(kinds, (0, 1, 4, 7, 8))].sum()) != n_seq):
            return None
    return at + 4 + size


def _candidates(data: bytes, contigs: int) -> np.ndarray:
    """Places whose first numbers could be those of a record."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(raw) < 36:
        return np.empty(0, np.int64)
    word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    word, n = word.view(np.int32), len(raw) - 35
    low = lambda k: word[k : k + n]
    fits = (low(0) >= 32) & (low(4) >= -1) & (low(4) < contigs) & (low(8) >= -1) & (raw[12 : 12 + n] >= 1) & (low(20) >= 0) & (low(24) >= -1) & (low(24) < contigs) & (low(28) >= -1)
    return np.flatnonzero(fits)


def first_record(file: File, start: int, lengths: list[int], proof: int = 5) -> int | None:
    """The virtual offset of the first record that begins in a block at or after byte `start`.

    A place counts if a chain of `proof` records, or one up to the end of the file, begins there.
    """
    source = bgzf.blocks(file, bgzf.next_block(file, start))
    data, origins, more, least, done = bytearray(), [], True, 1 << 17, 0
    while more:
        while more and len(data) < least:
            piece = next(source, None)
            more = piece is not None
            if piece is not None and piece[1]:
                origins.append((len(data), piece[0]))
                data += piece[1]
        held = bytes(data)
        for at in (_candidates(held[done:], len(lengths)) + done).tolist():
            done, place, links = at, at, 0
            while place is not None and links < proof and place < len(held):
                if place + 36 > len(held) and more:
                    break
                place = plausible(held, place, lengths)
                links += place is not None
            if place is None:
                continue
            if links == proof or (place == len(held) and not more):
                base, origin = origins[bisect.bisect_right(origins, at, key=lambda o: o[0]) - 1]
                return origin << 16 | at - base
            if more:
                break  # the chain goes on beyond what is held
        else:
            done = max(done, len(held) - 35)
        least *= 2
    return None


class BamReader(RegionReader):
    ending = ".bam"

    def plan(self, file: File, regions: list | None) -> list[Part]:
        if not bgzf.is_blocked(file):
            return [Part(file.path, [], whole=True)]
        stream = bgzf.Stream(file, 0, 1)
        _, names, _ = read_header(_exactly(stream, file.path), file.path)
        index = load_index(file.path, [".bai", (".bai", ".bam")])
        if regions is None or index is None:
            return cut(file.path, file.size, index, self.split, stream.tell())
        at = {n: k for k, n in enumerate(names)}
        if any(c == "*" for c, _, _ in regions):  # what has no place lies behind all that has
            return cut(file.path, file.size, index, self.split, stream.tell())
        return pieces(file.path, [s for c, a, b in regions for s in index.stretches(at.get(c, -1), a, b)], index.starts(), self.split)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return batches_of(self.records(part))

    def records(self, part: Part, file: File | None = None) -> Iterator[dict]:
        if not part.path:
            return
        wanted = self.window.regions(self.given)
        file = file or File(part.path)
        if part.whole:
            rows = parse(gzip.GzipFile(fileobj=io.BytesIO(file.read(0, file.size))), part.path)
        else:
            rows = self._within(part, file)
        for row in rows:
            if wanted is None or any(row["chrom"] == c and (c == "*" or row["pos"] < b and max(row["end_pos"], row["pos"] + 1) > a) for c, a, b in wanted):
                yield row

    def _within(self, part: Part, file: File) -> Iterator[dict]:
        _, names, lengths = read_header(_exactly(bgzf.Stream(file, 0, 1), part.path), part.path)
        for low, high in part.stretches:
            start = low if part.aligned else first_record(file, low >> 16, lengths)
            if start is None or start >= high:
                continue
            stream = bgzf.Stream(file, start, high)
            take = _exactly(stream, part.path)
            while stream.tell() < high and (head := stream.read(4)):
                if len(head) < 4:
                    raise ValueError(f"{part.path} is cut off")
                yield decode(take(struct.unpack("<i", head)[0]), names, part.path)


def batches_of(rows: Iterator[dict], most: int = 2000) -> Iterator[pa.RecordBatch]:
    while held := list(itertools.islice(rows, most)):
        yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Records (cigar and tags as pairs) as columns."""

    def offsets(name: str) -> pa.Array:
        return pa.array(np.cumsum([0, *(len(r[name]) for r in rows)]), pa.int32())

    def part(name: str, k: int, kind: pa.DataType) -> pa.Array:
        return pa.array([x[k] for r in rows for x in r[name]], kind)

    cigar = pa.ListArray.from_arrays(offsets("cigar"), pa.StructArray.from_arrays([part("cigar", 0, pa.string()), part("cigar", 1, pa.int32())], fields=list(_CIGAR.value_type)))
    tags = pa.MapArray.from_arrays(offsets("tags"), part("tags", 0, pa.string()), part("tags", 1, pa.string()))
    made = {"cigar": cigar, "tags": tags}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.array([r[f.name] for r in rows], f.type) for f in _ARROW], schema=_ARROW)


@functools.lru_cache(1 << 14)
def _tag(key: str, value: str) -> bytes:
    """A tag's bytes; whole numbers of 32 bits become numbers, others text."""
    number = value.lstrip("-").isdigit() and str(int(value)) == value and -(1 << 31) <= int(value) < 1 << 31
    return key.encode() + (b"i" + struct.pack("<i", int(value)) if number else b"Z" + value.encode() + b"\0")


def _texts(column: pa.Array) -> list:
    """Values of a text column; by way of numpy, which takes a fraction of the time."""
    return column.to_numpy(zero_copy_only=False).tolist()


#: What a record begins with.
_HEAD = np.dtype([(c, k) for c, k in zip("size ref pos n_name mapq bin n_cigar flag n_seq mate mate_pos length".split(), "<i4 <i4 <i4 u1 u1 <u2 <u2 <u2 <i4 <i4 <i4 <i4".split(), strict=True)])


def _bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """`bgzf.bin_of` of many; end is beyond start."""
    out = np.zeros(len(start), np.int64)
    for level in range(1, bgzf.LEVELS + 1):
        shift = bgzf.WINDOW + 3 * (bgzf.LEVELS - level)
        out = np.where(start >> shift == end - 1 >> shift, ((1 << 3 * level) - 1) // 7 + (start >> shift), out)
    return out


def encode(batch: pa.RecordBatch, contigs: dict[str, int]) -> tuple[list[bytes], np.ndarray]:
    """The bytes of a batch's records, and their ends on the reference."""
    column = lambda c: batch.column(batch.schema.names.index(c))
    numbers = {c: column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "mapq", "flag", "mate_pos")}
    refs, mates = ([contigs.get(x, -1) for x in _texts(column(c))] for c in ("chrom", "mate_chrom"))
    n_cigar = column("cigar").value_lengths().fill_null(0).to_numpy()
    flat = column("cigar").flatten()
    ops, lengths = flat.field("op").dictionary_encode(), flat.field("len").to_numpy().astype(np.int64)
    kinds = ops.dictionary.to_pylist()
    codes, on_ref = (np.array([f(x) for x in kinds], np.int64)[ops.indices.to_numpy()] if kinds else np.zeros(0, np.int64) for f in (_OPS.index, lambda x: x in "MDN=X"))
    words = (lengths << 4 | codes).astype("<u4").tobytes()
    cut = np.cumsum([0, *n_cigar])
    span = np.diff(np.concatenate([[0], np.cumsum(lengths * on_ref)])[cut])
    ends = numbers["pos"] + np.maximum(span, 1)
    head = np.zeros(batch.num_rows, _HEAD)
    bodies, sizes, seqs, called = [], [], [], []
    at, tags = (4 * cut).tolist(), column("tags")
    first, has = tags.offsets.to_numpy().tolist(), tags.is_valid().to_numpy(zero_copy_only=False).tolist()
    keys, texts = _texts(tags.keys), _texts(tags.items)
    for i, (name, bases, quals) in enumerate(zip(*(_texts(column(c)) for c in ("name", "bases", "quals")), strict=True)):
        name, letters = name.encode() + b"\0", b"" if bases == "*" else bases.encode("latin-1", "replace")
        n = len(letters)
        digits = letters.translate(_DIGITS)
        raw = quals.encode("latin-1") if quals not in (None, "*", "") else None
        if raw is not None and min(raw) < 33:
            raise ValueError(f"a quality of {bases} is below its least letter")
        body = b"".join((name, words[at[i] : at[i + 1]], binascii.unhexlify(digits + b"0" if n % 2 else digits), b"\xff" * n if raw is None else raw.translate(_LOWERED), *[_tag(keys[j], texts[j]) if len(texts[j]) <= 64 else _tag.__wrapped__(keys[j], texts[j]) for j in range(first[i], first[i + 1]) if has[i]]))
        bodies.append(body)
        sizes.append(len(body) + 32)
        seqs.append(n)
        called.append(len(name))
    values = {"size": sizes, "ref": refs, "n_name": called, "bin": np.where(numbers["pos"] >= 0, _bins(np.maximum(numbers["pos"], 0), np.maximum(ends, 1)), 4680), "n_cigar": n_cigar, "n_seq": seqs, "mate": mates} | numbers
    for c, x in values.items():
        x = np.asarray(x, np.int64)
        kind = np.iinfo(_HEAD[c])
        if len(x) and (x.min() < kind.min or x.max() > kind.max):
            raise ValueError(f"a record's {c} is beyond what a BAM file can hold")
        head[c] = x
    heads = head.tobytes()
    return [heads[36 * i : 36 * i + 36] + body for i, body in enumerate(bodies)], ends


def header_bytes(lines: list[str], contigs: list[tuple[str, int]]) -> bytes:
    head = "".join(f"{line}\n" for line in lines).encode()
    out = [b"BAM\1", struct.pack("<i", len(head)), head, struct.pack("<i", len(contigs))]
    return b"".join(out + [struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs])


class BamWriter(BlockedWriter):
    ending, index_ending = ".bam", ".bai"

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.contigs = json.loads(options["contigs"])

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, int, bytes]]:
        number = {c: k for k, c in enumerate(self.contigs)}
        chroms = _texts(batch.column(batch.schema.names.index("chrom")))
        for chrom in dict.fromkeys(chroms):
            if chrom != "*" and chrom not in number:
                raise ValueError(f"the header has no contig {chrom}")
        starts = batch.column(batch.schema.names.index("pos")).to_numpy(zero_copy_only=False).tolist()
        data, ends = encode(batch, number)
        for chrom, start, end, record in zip(chroms, starts, ends.tolist(), data, strict=True):
            yield None if chrom == "*" else chrom, start, end, record

    def index_bytes(self, index: bgzf.Index) -> bytes:
        own = dict(zip(index.names, index.contigs, strict=True))
        return bgzf.Index([own.get(c, bgzf.Contig()) for c in self.contigs]).to_bytes()


def write_bam(reads: DataFrame, path: str, contigs: list[tuple[str, int]], lines: list[str] | None = None, join: bool = True, parts: int | None = None, made: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes reads (the columns of read_bam; file and end_pos are not read) in order of contigs, places, names and flags.

    path: a file with its .bai beside it, or with join=False a folder of such files. `lines`: the header's text besides
    its @SQ lines. Reads without a place have the contig `*` and come last. A contig that the header lacks is an error.
    made: gives ordered reads the columns that they lack; then only chrom, pos, name, flag and what it needs are shuffled.
    It leaves rows in their order.
    """
    head = [line for line in lines or [] if not line.startswith("@SQ")]
    text = [*[x for x in head if x.startswith("@HD")], *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs], *[x for x in head if not x.startswith("@HD")]]
    whole = lambda r: r.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(_SCHEMA) if f.name not in ("file", "end_pos")))
    ordered = in_order(reads if made else whole(reads), [c for c, _ in contigs], ["pos", "name", "flag"], parts)
    write_blocked(whole(made(ordered)) if made else ordered, BamSource, path, header_bytes(text, contigs), join, contigs=json.dumps([c for c, _ in contigs]))


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strandmill_bam"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter(self.options)


def read_bam(spark: SparkSession, path: str | list[str], regions: list[tuple[str, int, int]] | None = None, split: int = SPLIT) -> DataFrame:
    """Alignments of BAM files, folders of them or patterns, in tasks of about `split` compressed bytes.

    Filters on chrom, pos and end_pos, and `regions` (half-open, a list that the driver can hold), read only the blocks
    that a .bai index names. Files without an index are cut at their blocks, and each task finds the first record that
    begins in its own. A file of plain gzip is one task. A cut-off or damaged file is an error when it is read. Paths
    are those that Arrow opens on every machine; for others, read_whole_bam.
    """
    return load(spark, BamSource, path, regions, split)


def read_bam_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): the header lines of BAM files, as `text.header_groups` and `text.header_contigs` take them."""
    paths = listed([path] if isinstance(path, str) else list(path), ".bam")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                file = File(name)
                stream = bgzf.Stream(file, 0, 1) if bgzf.is_blocked(file) else gzip.GzipFile(fileobj=io.BytesIO(file.read(0, file.size)))
                lines = read_header(_exactly(stream, name), name)[0].splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["file", "value"])

    return spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, min(len(paths), 1000))).mapInArrow(run, "file string, value string")


def by_file(reads: DataFrame, files: list[str]) -> DataFrame:
    """Reads in the order of the files given, each in order of its places, contigs by name."""
    place = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("file"))
    return reads.orderBy(place, "chrom", "pos", "name", "flag")


def by_position(reads: DataFrame, contigs: list[str]) -> DataFrame:
    """Reads of all files in the order of the contigs given and of their places, ties by file and name; what has no
    place comes last."""
    known = F.array_position(F.array(*[F.lit(c) for c in contigs]).cast("array<string>"), F.col("chrom"))
    return reads.orderBy(F.when(known > 0, known).otherwise(FAR), "chrom", "pos", "file", "name", "flag")


def read_whole_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of small BAM files in stores that only Spark reads: each file is one value and one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                yield from batches_of(parse(gzip.GzipFile(fileobj=io.BytesIO(content)), name))

    return files.mapInArrow(run, _SCHEMA)
