"""Byte-level BPE: what the looked-up words take for granted, bounds of the memo, null, empty and very long texts."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import regex

from strandmill.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_letters_behind_a_space_are_one_match():
    find = regex.compile(P.PATTERN).findall
    letters = [c for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalpha()]
    assert all(find(" " + c) == [" " + c] for c in letters)
    rng = random.Random(1)
    for _ in range(200):
        word = " " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        assert find("x" + word + " y")[1] == word


def test_small_memo_changes_nothing(monkeypatch):
    ranks = byte_bpe.read_ranks(PATH)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeiosté,.'1") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)]
    want = [byte_bpe.Encoder(ranks, P.PATTERN, True).encode(t) for t in texts]
    for name, bound in (("MEMO_BYTES", 3000), ("PIECE_BYTES", 2000), ("MAX_PAIRS", 50), ("MAX_TRANSITIONS", 60)):
        monkeypatch.setattr(byte_bpe, name, bound)
    small = byte_bpe.Encoder(ranks, P.PATTERN, True)
    assert [small.encode(t) for t in texts] == want
    assert small.after_space.size <= 3000 and len(small.machine.pairs) <= 50 and len(small.machine.moves) <= 60 + 300
    plain = byte_bpe.Encoder(ranks, P.PATTERN)
    assert [plain.encode(t) for t in texts] == want


def test_null_empty_long_and_repeated_texts(spark):
    long = "word é" * 60_000 + "a" * 50_000
    rows = [(1, None, 7), (2, "", 7), (3, long, 7), (4, "hi there", 7), (4, "hi there", 7), (None, "hi there", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = byte_bpe.digest_documents(docs, PATH, P.PATTERN, lone_space=True).collect()
    assert len(got) == len(rows)
    none = hashlib.sha256(b"").hexdigest()
    for r in got:
        text = {1: "", 2: "", 3: long}.get(r.doc_id, "hi there")
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert text or (r.n_tokens, r.ids_sha256) == (0, none)
    ids = {r.doc_id: r.ids for r in byte_bpe.encode_documents(docs.where("doc_id < 4"), PATH, P.PATTERN, True).collect()}
    assert ids[1] == ids[2] == [] and hashlib.sha256(np.array(ids[3], "<u4").tobytes()).hexdigest() in {r.ids_sha256 for r in got}
    assert byte_bpe.digest_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
