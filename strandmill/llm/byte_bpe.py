"""Byte-level BPE as a finite-state transducer that is determinised while it runs.

Encoding. The encoding of a prefix of a piece ends in exactly one token t such that t and the token before it can
stand side by side (their joint bytes encode to just the two); all of an encoding follows from these last tokens.
The nondeterministic machine keeps a thread for every start from which some vocabulary entry may still be spelled.
Its sets of threads are the suffixes of what was read that begin an entry, so the longest one names a state of the
deterministic machine. Moves between states, and which two tokens may meet, are worked out when first needed and
then looked up. The encodings of all starts that are still open meet at some boundary no further back than a few
tokens; what lies before it can't change any more and is emitted, so lookahead and memory are bounded on any piece.

Decoding. A machine over UTF-8 lead and continuation bytes, lifted from bytes to tokens: what a token's bytes do to
the bytes still pending is worked out once. Invalid bytes become U+FFFD, one for each maximal broken part.

All tables live in the Python worker. What follows from the vocabulary is held in arrays; what is learnt from texts
is bounded (`MAX_TRANSITIONS` and `MAX_PAIRS` entries, `MEMO_BYTES` for looked-up texts): when a table is full it is
started anew, so a worker takes some 110 MB on any corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_slices, held, texts_of

NEVER = 1 << 40
MAX_TRANSITIONS, MAX_PAIRS, LONG_PIECE, LOOKAHEAD = 100_000, 300_000, 48, 1024
#: Of each generation of looked-up texts: whole ones, and matches of the pattern. An entry takes ENTRY bytes besides its own.
MEMO_BYTES, PIECE_BYTES, ENTRY = 40 << 20, 6 << 20, 160


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def by_rank(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The bytes of each id, None for ids that stand for nothing."""
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        out[rank] = word
    return out


class Transducer:
    """Encodes one piece of bytes at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = by_rank(ranks)
        n = len(self.bytes_of)
        #: token -> the token that its last (first) byte was part of before the last merge; -1 for single bytes.
        self.right, self.left = array("i", [-1]) * n, array("i", [-1]) * n
        children: dict[int, int] = {}
        #: A trie of the vocabulary: (node, byte) -> node, and for each node its token, depth, parent and byte.
        self.token, self.depth, self.parent, self.byte = array("i", [-1]), array("i", [0]), array("i", [0]), bytearray(1)
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts, halves = self.merge(word)
            if parts != [rank]:
                continue  # no sequence of merges makes it; it only stands for a whole piece
            if halves:
                self.left[rank], self.right[rank] = halves
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in children:
                    children[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.parent.append(node)
                    self.byte.append(b)
                node = children[key]
            self.token[node] = rank
        self.keys = array("q", sorted(children))
        self.targets = array("i", [children[k] for k in self.keys])
        self.pairs = _Pairs(self)
        self.moves = _Moves(self)
        self.suffix = array("i", [-1]) * len(self.token)
        self.suffix[0] = 0
        self.ends: list[tuple | None] = [(), *[None] * (len(self.token) - 1)]

    def child(self, key: int) -> int:
        """The node that a node << 8 | byte leads to in the trie, or -1."""
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    @staticmethod
    def chain(token: int, below: array) -> list[int]:
        """What a token was before its merges, at one of its ends, up to itself."""
        out = []
        while token >= 0:
            out.append(token)
            token = below[token]
        return out[::-1]

    def merge(self, data: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The merges as defined: the pair of lowest rank first, the leftmost of equals. Also the last pair merged."""
        parts, halves, ranks = [data[i : i + 1] for i in range(len(data))], None, self.ranks
        while len(parts) > 1:
            best, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            halves = ranks[parts[i]], ranks[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts], halves

    def apart(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart when their bytes are encoded together.

        Merges run in the order of ranks, so the bytes beside the seam grow by their own tokens' steps; the seam
        closes if at some time the two that stand there have a rank before the next step of either.
        """
        left, right, i, j = self.chain(a, self.right), self.chain(b, self.left), 0, 0
        while True:
            grown = left[i + 1] if i + 1 < len(left) else NEVER
            grows = right[j + 1] if j + 1 < len(right) else NEVER
            seam = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], NEVER)
            if seam < grown and seam <= grows and seam != NEVER:
                return False
            if grown == grows == NEVER:
                return True
            if grown <= grows:
                i += 1
            else:
                j += 1

    def back(self, node: int) -> int:
        """The state of the longest proper suffix."""
        known = self.suffix[node]
        if known < 0:
            parent = self.parent[node]
            known = self.suffix[node] = self.moves[self.back(parent) << 8 | self.byte[node]] if parent else 0
        return known

    def endings(self, node: int) -> tuple[tuple[int, int], ...]:
        """Tokens that end here and their lengths, the longest first."""
        known = self.ends[node]
        if known is None:
            own = ((self.token[node], self.depth[node]),) if self.token[node] >= 0 else ()
            known = self.ends[node] = own + self.endings(self.back(node))
        return known

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last, node = [-1], 0
        moves, pairs, ends, bytes_of = self.moves, self.pairs, self.ends, self.bytes_of
        for byte in data:
            node = moves[node << 8 | byte]
            n = len(last)
            for token, size in ends[node] or self.endings(node):
                before = last[n - size] if size <= n else None
                if before is not None and (before < 0 or pairs[before << 20 | token]):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            if n > LOOKAHEAD:
                last = self._emit(last, self.depth[node], out)
        tail, n = [], len(last) - 1
        while n:
            tail.append(last[n])
            n -= len(bytes_of[last[n]])
        out += reversed(tail)
        return out

    def _emit(self, last: list[int], open_bytes: int, out: list[int]) -> list[int]:
        """Emits what all open starts have in common; the rest of the last tokens, from the boundary on."""
        n = len(last) - 1
        starts = set(range(max(0, n - open_bytes), n + 1))
        while len(starts) > 1:
            furthest = max(starts)
            starts.remove(furthest)
            starts.add(furthest - len(self.bytes_of[last[furthest]]))
        at = boundary = starts.pop()
        done = []
        while at:
            done.append(last[at])
            at -= len(self.bytes_of[last[at]])
        out += reversed(done)
        return last[boundary:]


class _Pairs(dict):
    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, key: int) -> bool:
        if len(self) >= MAX_PAIRS:
            self.clear()
        self[key] = known = self.machine.apart(key >> 20, key & 0xFFFFF)
        return known


class _Moves(dict):
    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, key: int) -> int:
        if len(self) >= MAX_TRANSITIONS:
            self.clear()
        node = key >> 8
        to = self.machine.child(key)
        if to < 0:
            to = self[self.machine.back(node) << 8 | key & 0xFF] if node else 0
        self[key] = to
        return to


class _Packed(dict):
    """A memo of two generations, each of `limit` bytes: text -> its ids as little-endian unsigned 32-bit integers.

    What is used again while the younger one fills moves into it, so frequent texts are kept.
    """

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.old, self.size = encode, limit, {}, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= LONG_PIECE:
            self.size += ENTRY + 2 * len(text) + len(ids)
            if self.size > self.limit:
                self.old = dict(self)
                self.clear()
                self.size = 0
            self[text] = ids
        return ids


def _pack(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


#: A space between two characters that aren't white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """lone_space: the pattern always starts a match at a space between two other characters than white space, so
    that what stands between two such spaces can be looked up as a whole; and it matches such a space with letters
    alone behind it as one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, lone_space: bool = False):
        import regex

        self.find = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.lone_space = lone_space
        self.pieces = _Packed(lambda x: _pack(self.machine.encode(x.encode())), PIECE_BYTES if lone_space else MEMO_BYTES)
        self.after_space = _Packed(self._word, MEMO_BYTES)

    def _word(self, text: str) -> bytes:
        """What stands behind a lone space, with that space."""
        return _pack(self.machine.encode(b" " + text.encode())) if text.isalpha() else self._matches(" " + text)

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, packed as little-endian unsigned 32-bit integers."""
        if not self.lone_space:
            return self._matches(text)
        first, *rest = _LONE_SPACE.split(text)
        return self._matches(first) + b"".join(map(self.after_space.__getitem__, rest))


#: UTF-8 (RFC 3629): for each range of lead bytes, the ranges of the bytes that follow.
_FOLLOW = [
    (0xC2, 0xDF, ((0x80, 0xBF),)),
    (0xE0, 0xE0, ((0xA0, 0xBF), (0x80, 0xBF))),
    (0xE1, 0xEC, ((0x80, 0xBF), (0x80, 0xBF))),
    (0xED, 0xED, ((0x80, 0x9F), (0x80, 0xBF))),
    (0xEE, 0xEF, ((0x80, 0xBF), (0x80, 0xBF))),
    (0xF0, 0xF0, ((0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
    (0xF1, 0xF3, ((0x80, 0xBF), (0x80, 0xBF), (0x80, 0xBF))),
    (0xF4, 0xF4, ((0x80, 0x8F), (0x80, 0xBF), (0x80, 0xBF))),
]
_EXPECT = {lead: follow for low, high, follow in _FOLLOW for lead in range(low, high + 1)}


def utf8_step(pending: bytes, data: bytes) -> tuple[str, bytes]:
    """What can be said of pending + data: the text so far, and the bytes of a character not yet complete."""
    out: list[str] = []
    for b in data:
        if pending:
            follow = _EXPECT[pending[0]]
            low, high = follow[len(pending) - 1]
            if low <= b <= high:
                pending += bytes((b,))
                if len(pending) == len(follow) + 1:
                    out.append(pending.decode())
                    pending = b""
                continue
            out.append("�")
            pending = b""
        if b < 0x80:
            out.append(chr(b))
        elif b in _EXPECT:
            pending = bytes((b,))
        else:
            out.append("�")
    return "".join(out), pending


class Decoder:
    """Turns ids into text as they come; `finish` ends the text."""

    def __init__(self, ranks: dict[bytes, int]):
        bytes_of = by_rank(ranks)
        self.bytes_of = bytes_of
        self.whole: list[str | None] = [None] * len(bytes_of)
        for token, data in enumerate(bytes_of):
            if data is not None:
                text, rest = utf8_step(b"", data)
                if not rest and text.encode() == data:
                    self.whole[token] = text
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.pending = b""

    def feed(self, ids: Iterable[int]) -> str:
        pending, whole, moves, out = self.pending, self.whole, self.moves, []
        for t in ids:
            text = whole[t]
            if text is None or pending:
                step = moves.get((pending, t))
                if step is None:
                    if len(moves) >= MAX_TRANSITIONS:
                        moves.clear()
                    step = moves[pending, t] = utf8_step(pending, self.bytes_of[t])
                text, pending = step
            out.append(text)
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return "�" if rest else ""


def coders(ranks_path: str, pattern: str, lone_space: bool) -> tuple[Encoder, Decoder]:
    """The two machines of this worker; they are built once and grow as texts come."""

    def make() -> tuple[Encoder, Decoder]:
        ranks = read_ranks(ranks_path)
        return Encoder(ranks, pattern, lone_space), Decoder(ranks)

    return held(("coders", ranks_path, pattern, lone_space), make)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, lone_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every row; null and empty texts have no ids.

    Repeated rows are encoded alike, each for itself; an empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = coders(ranks_path, pattern, lone_space)
        for batch in batches:
            for part in byte_slices(batch):
                packed = [encoder.encode(t) for t in texts_of(part.column("text"))]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                flat = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str, lone_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids again, and returns their number and the digests of both.

    Null and empty texts have no ids and the digests of nothing. Repeated rows are judged alike, each for itself; an
    empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(ranks_path, pattern, lone_space)
        for part in (p for batch in batches for p in byte_slices(batch)):
            counts, ids_hex, text_hex = [], [], []
            for text in texts_of(part.column("text")):
                packed = encoder.encode(text)
                counts.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                back = hashlib.sha256()
                ids = np.frombuffer(packed, "<u4")
                for lo in range(0, len(ids), 65536):
                    back.update(decoder.feed(ids[lo : lo + 65536].tolist()).encode())
                back.update(decoder.finish().encode())
                text_hex.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
