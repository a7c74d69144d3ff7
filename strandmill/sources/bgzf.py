"""Blocked gzip and its indexes: blocks read and written one by one, and the bins that say where a region's rows lie.

A blocked gzip file is a chain of gzip members of at most 64 KB of data, each naming its own size. A virtual offset is
the file offset of a block times 65,536 plus the place within its data. An index keeps, for each contig, stretches of
virtual offsets by bin (16 KB of sequence at the lowest of six levels, eight times as much at the next), and for each
16 KB the first offset of what reaches it.
"""

from __future__ import annotations

import bisect
import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs as pafs

# Fixed values of the formats: magic numbers, data in a block, the empty block at the end, window and levels of bins.
MAGIC, BAI, TBI = b"\x1f\x8b\x08\x04", b"BAI\1", b"TBI\1"
MOST = 65280
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
WINDOW, LEVELS, META = 14, 5, 37450


class File:
    """Random reads of a file in any store that Arrow reaches; `taken` counts the bytes read."""

    def __init__(self, path: str):
        store, name = store_of(path)
        self.path, self.size = path, store.get_file_info(name).size
        if self.size is None:
            raise FileNotFoundError(path)
        self.taken, self._handle = 0, store.open_input_file(name)

    def read(self, at: int, n: int) -> bytes:
        data = self._handle.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        self.taken += len(data)
        return data


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with `head` (18 bytes or more), None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(len(head), 12 + extra):
        if head[at : at + 4] == b"BC\x02\x00" and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return None


def is_blocked(file: File) -> bool:
    return block_size(file.read(0, 64)) is not None


def next_block(file: File, at: int, step: int = 1 << 17) -> int:
    """Where the first block at or after `at` begins; the end of the file if none does.

    What looks like a block must be followed by another one, or by the end of the file.
    """
    if at <= 0:
        return 0
    while at < file.size:
        data = file.read(at, step)
        k = data.find(MAGIC)
        while k >= 0:
            size = block_size(data[k : k + 64] if k + 64 <= len(data) else file.read(at + k, 64))
            if size is not None and (at + k + size == file.size or block_size(file.read(at + k + size, 64)) is not None):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += max(1, len(data) - 3)
    return file.size


def blocks(file: File, at: int, ahead: int = 1 << 18, stop: int | None = None) -> Iterator[tuple[int, bytes, int]]:
    """(offset, data, offset of the next) of every block from `at` on. Bytes are read `ahead` at a time, beyond `stop`
    no more than a block. A cut-off block is an error."""
    held, base = b"", at
    while at < file.size:
        if at - base + 64 > len(held) or (size := block_size(held[at - base : at - base + 64])) is None or at - base + size > len(held):
            want = ahead if stop is None else min(ahead, max(1 << 16, stop - at))
            held, base = file.read(at, want), at
            size = block_size(held[:64])
            if size is not None and size > len(held):
                held = file.read(at, size)
        if size is None or len(held) - (at - base) < size:
            raise ValueError(f"{file.path} is cut off or no blocked gzip file at byte {at}")
        raw = held[at - base : at - base + size]
        start = 12 + struct.unpack_from("<H", raw, 10)[0]
        data = zlib.decompress(raw[start:-8], -15)
        if zlib.crc32(data) != struct.unpack_from("<I", raw, size - 8)[0]:
            raise ValueError(f"{file.path} is damaged at byte {at}")
        yield at, data, at + size
        at += size


class Stream:
    """Data of consecutive blocks from a virtual offset on."""

    def __init__(self, file: File, start: int = 0, stop: int | None = None):
        self.file = file
        self._blocks = blocks(file, start >> 16, stop=None if stop is None else (stop >> 16) + 1)
        self._at, self._data, self._next, self._place = start >> 16, b"", start >> 16, 0
        self._skip = start & 0xFFFF

    def _fill(self) -> bool:
        for self._at, self._data, self._next in self._blocks:
            self._place, self._skip = self._skip, 0
            if self._place < len(self._data):
                return True
        return False

    def tell(self) -> int:
        """The virtual offset of what is read next."""
        if self._place < len(self._data):
            return self._at << 16 | self._place
        return self._next << 16 | self._skip

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and (self._place < len(self._data) or self._fill()):
            piece = self._data[self._place : self._place + n]
            self._place += len(piece)
            n -= len(piece)
            out.append(piece)
        return b"".join(out)

    def line(self) -> bytes:
        """Up to and with the next line feed; empty at the end."""
        out = []
        while self._place < len(self._data) or self._fill():
            end = self._data.find(b"\n", self._place)
            piece = self._data[self._place : end + 1 if end >= 0 else len(self._data)]
            self._place += len(piece)
            out.append(piece)
            if end >= 0:
                break
        return b"".join(out)


def block(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = MAGIC + bytes([0, 0, 0, 0, 0, 255, 6, 0]) + b"BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class Writer:
    """Blocks written to a binary sink; `tell` is the virtual offset of what is written next."""

    def __init__(self, sink):
        self.sink, self.written, self._held = sink, 0, bytearray()

    def tell(self) -> int:
        return self.written << 16 | len(self._held)

    def write(self, data: bytes) -> None:
        self._held += data
        while len(self._held) >= MOST:
            self._put(MOST)

    def _put(self, n: int) -> None:
        made = block(bytes(self._held[:n]))
        del self._held[:n]
        self.sink.write(made)
        self.written += len(made)

    def flush(self) -> None:
        if self._held:
            self._put(len(self._held))


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    end = max(end, start + 1) - 1
    for level in range(LEVELS, 0, -1):
        shift = WINDOW + 3 * (LEVELS - level)
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> Iterator[int]:
    """All bins that overlap [start, end)."""
    end = max(end, start + 1) - 1
    for level in range(LEVELS + 1):
        shift, first = WINDOW + 3 * (LEVELS - level), ((1 << 3 * level) - 1) // 7
        yield from range(first + (start >> shift), first + (min(end, (1 << 29) - 1) >> shift) + 1)


@dataclass
class Contig:
    bins: dict[int, list[list[int]]] = field(default_factory=dict)
    first: dict[int, int] = field(default_factory=dict)  # by window

    def add(self, start: int, end: int, low: int, high: int) -> None:
        own = self.bins.setdefault(bin_of(start, end), [])
        if own and own[-1][1] >> 16 == low >> 16:
            own[-1][1] = high
        else:
            own.append([low, high])
        for w in range(start >> WINDOW, (max(end, start + 1) - 1 >> WINDOW) + 1):
            self.first.setdefault(w, low)

    def linear(self) -> list[int]:
        """First offsets of all windows up to the last that has one; of those without, the one before."""
        out = [0] * (max(self.first, default=-1) + 1)
        for w in range(len(out)):
            out[w] = self.first.get(w, out[w - 1] if w else 0)
        return out


@dataclass
class Index:
    contigs: list[Contig]
    names: list[str] | None = None

    @classmethod
    def parse(cls, data: bytes) -> Index:
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        at, names = 8, None
        if data[:4] == TBI:
            n_names = struct.unpack_from("<i", data, 32)[0]
            names = [x.decode() for x in data[36 : 36 + n_names].split(b"\0")[:-1]]
            at = 36 + n_names
        elif data[:4] != BAI:
            raise ValueError("no BAI or tabix index")
        contigs = []
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            own = Contig()
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            for _ in range(n):
                number, k = struct.unpack_from("<Ii", data, at)
                values = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
                at += 8 + 16 * k
                if number != META:
                    own.bins[number] = [list(x) for x in zip(values[::2], values[1::2], strict=True)]
            n, at = struct.unpack_from("<i", data, at)[0], at + 4
            own.first = {w: x for w, x in enumerate(struct.unpack_from(f"<{n}Q", data, at)) if x}
            at += 8 * n
            contigs.append(own)
        return cls(contigs, names)

    def to_bytes(self) -> bytes:
        out = [BAI if self.names is None else TBI, struct.pack("<i", len(self.contigs))]
        if self.names is not None:
            names = b"".join(n.encode() + b"\0" for n in self.names)
            out.append(struct.pack("<7i", 2, 1, 2, 0, ord("#"), 0, len(names)) + names)
        for c in self.contigs:
            out.append(struct.pack("<i", len(c.bins)))
            for number, chunks in sorted(c.bins.items()):
                out.append(struct.pack(f"<Ii{2 * len(chunks)}Q", number, len(chunks), *(x for pair in chunks for x in pair)))
            line = c.linear()
            out.append(struct.pack(f"<i{len(line)}Q", len(line), *line))
        return b"".join(out)

    def stretches(self, contig: int, start: int = 0, end: int = 1 << 29) -> list[tuple[int, int]]:
        """Virtual offsets within which all rows of [start, end) lie, in order, neighbouring ones joined."""
        if not 0 <= contig < len(self.contigs) or end <= start:
            return []
        own = self.contigs[contig]
        windows = sorted(own.first)
        k = bisect.bisect_right(windows, max(0, start) >> WINDOW) - 1
        least = own.first[windows[k]] if k >= 0 else 0
        found = sorted((low, high) for b in bins_over(max(0, start), end) for low, high in own.bins.get(b, ()) if high > least)
        out: list[tuple[int, int]] = []
        for low, high in ((max(low, least), high) for low, high in found):
            if out and low >> 16 <= (out[-1][1] >> 16) + 1:
                out[-1] = out[-1][0], max(out[-1][1], high)
            else:
                out.append((low, high))
        return out

    def starts(self) -> list[int]:
        """Offsets at which rows begin, in order: where stretches of any bin do."""
        return sorted({low for c in self.contigs for chunks in c.bins.values() for low, _ in chunks})

    def shifted(self, bytes_before: int) -> Index:
        by = bytes_before << 16
        return Index([Contig({b: [[lo + by, hi + by] for lo, hi in x] for b, x in c.bins.items()}, {w: x + by for w, x in c.first.items()}) for c in self.contigs], self.names)


def joined(indexes: list[Index]) -> Index:
    """The tabix index of files put one after the other, each already shifted to its place."""
    by_name: dict[str, Contig] = {}
    for index in indexes:
        for name, c in zip(index.names, index.contigs, strict=True):
            own = by_name.setdefault(name, Contig())
            for b, chunks in c.bins.items():
                own.bins.setdefault(b, []).extend(chunks)
            for w, x in c.first.items():
                own.first[w] = min(x, own.first.get(w, x))
    return Index(list(by_name.values()), list(by_name))
