"""The pipeline on a few hundred documents: every stage's whole output against a plain form over what it was given."""

import hashlib
import re
import struct

import corpus_pipeline as cp
from strandmill.llm import byte_bpe, secrets
from test_near_join import brute

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def cut(text, windows):
    """The text without the words that lie in an occurring window, and what stands between two of them."""
    data = text.encode()
    found = [(m.span(), m.group()) for m in WORD.finditer(data.translate(FOLD))]
    words = [w for _, w in found]
    hit = [False] * len(words)
    for size, known in windows.items():
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in known:
                hit[k : k + size] = [True] * size
    out, last, k = [], 0, 0
    while k < len(words):
        if hit[k]:
            end = k
            while end + 1 < len(words) and hit[end + 1]:
                end += 1
            out.append(data[last : found[k][0][0]])
            last = found[end][0][1]
            k = end
        k += 1
    return b"".join([*out, data[last:]]).decode()


def masked(text, spans):
    """The text with each span, overlapping ones together, as a mark."""
    joined = []
    for start, end in sorted(tuple(map(int, x.rsplit(":", 2)[1:])) for x in spans.split(",") if x):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(end, joined[-1][1])
        else:
            joined.append([start, end])
    for start, end in reversed(joined):
        text = text[:start] + "[SECRET]" + text[end:]
    return text


def test_stages_equal_plain_forms(spark, tmp_path):
    import public_tokenizers as tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    given = {r.doc_id: r for r in docs.collect()}
    more = [(10_000 + k, r.text, r.lang, r.source, r.n_chars) for k, r in enumerate(sorted(given.values())[:60])]
    more += [(20_000 + k, r.text + " one more", r.lang, r.source, r.n_chars) for k, r in enumerate(sorted(given.values())[60:120])]
    long = [r for r in sorted(given.values()) if len(r.text) > 300]
    more += [(30_000 + k, f'{a.text} password = "hunter{k}2x9z" {b.text}', a.lang, a.source, a.n_chars) for k, (a, b) in enumerate(zip(long[:20], long[20:40], strict=True))]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps, frames = [docs.collect()], [docs]
    for name, stage in cp.STAGES:
        stage(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
        steps.append(frames[-1].collect())
    whole, kept, single, clean, safe, encoded = steps
    assert set(kept) < set(whole) and len(kept) > 0.5 * len(whole)

    first = {i: c for i, c, *_ in brute([(r.doc_id, r.text) for r in kept])}
    assert sorted(single) == sorted(r for r in kept if first[r.doc_id] == r.doc_id) and len(single) < len(kept) - 30

    windows = {}
    for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect():
        words = WORD.findall((r.text or "").encode().translate(FOLD))
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(size, set()).add(tuple(words[k : k + size]))
    want = {r.doc_id: cut(r.text, windows) for r in single}
    assert {r.doc_id: r.text for r in clean} == want and any(want[r.doc_id] != r.text for r in single)

    spans = {r.doc_id: r.spans for r in secrets.report(frames[3]).select("doc_id", "spans").collect()}
    assert {r.doc_id: r.text for r in safe} == {r.doc_id: masked(r.text, spans[r.doc_id]) for r in clean}
    assert any(spans.values())

    ranks = byte_bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("plain", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for r in safe:
        ids = library.encode_ordinary(r.text)
        want.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert {tuple(r) for r in encoded} == want
    assert {tuple(r) for r in cp.run(spark, str(tmp_path)).collect()} == want
