import random

import corpus_pipeline as cp
from strandmill.llm import decontaminate as dc
from strandmill.llm import quality, secrets


def corpus(n=500, seed=8):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "abcde" for b in "aeiou" for c in ("n", "st", "r")]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        low, toxic = k % 7 == 0, k % 5 == 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(("vilename", "slurword"))
        text = " ".join(w + "%%%" for w in words) if low else " ".join(words) + "."
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
        labels.append((k, int(not low), int(toxic)))
    return rows, labels


def test_stages_take_effect(spark, tmp_path):
    rows, labels = corpus()
    spare, _ = corpus(40, 99)
    start, end, secret = spare[2][1], spare[3][1], spare[4][1]
    clean = [r for r in rows if r[0] % 7 and r[0] % 5 != 1]
    item = " ".join(f"item{k}" for k in range(14))
    extra = [
        (900, clean[0][1], "en", "src1", 1),
        (901, f"{start} {item} {end}", "en", "src1", 1),
        (902, secret + ' token = "' + "0123456789abcdef" * 2 + '" ' + secret, "en", "src1", 1),
        (903, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + extra, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = {r.doc_id: r for r in docs.collect()}
    kept = out["quality classifier"]
    bad = {k for k, q, t in labels if t or not q}
    assert len(bad & set(kept)) <= 0.1 * len(bad)
    assert len({r[0] for r in clean} - set(kept)) <= 0.02 * len(clean)
    assert 900 not in out["n-gram Jaccard join"] and clean[0][0] in out["n-gram Jaccard join"]
    for k, name in enumerate(("n-gram Jaccard join", "benchmark decontamination", "secret scan")):
        assert set(out[name]) == set(kept) - {900}, k
    assert out["benchmark decontamination"][901].text == f"{start}  {end}"
    assert out["benchmark decontamination"][901].n_chars == len(f"{start}  {end}")
    assert "[SECRET]" in out["secret scan"][902].text and "0123456789" not in out["secret scan"][902].text
    assert set(out["byte-level BPE"]) == set(out["secret scan"])
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == set(out["byte-level BPE"])


def test_quality_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None), (None, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == 2
    assert quality.score(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    rows, labels = corpus(900, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    p = {r.doc_id: r for r in quality.score(docs, known).collect()}
    rest = labels[600:]
    assert sum((p[k].p_quality >= 0.5) == bool(q) for k, q, _ in rest) >= 0.97 * len(rest)
    assert sum((p[k].p_toxic >= 0.5) == bool(t) for k, _, t in rest) >= 0.97 * len(rest)


def test_network_on_other_findings():
    import numpy as np

    model = secrets.trained()
    found, y = secrets.labelled_findings(1000, seed=77)
    p = model.probability(np.stack([secrets.features(*f) for f in found]))
    assert (p[y == 1] >= model.threshold).mean() >= 0.95
    assert (p[y == 0] >= model.threshold).mean() <= 0.03


def test_base_findings(spark):
    import re

    text = 'x PassWord: "abcdef" token=abc secret = abcdefgh api-key=xxxxxxx APIKEY="k1_2-3" AKIA' + "A1" * 8 + " AKIAB " + "0a" * 12 + " passwd=ſecret=zzzzzz é" + "f" * 23
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    want = [(k, *m.span()) for k, r, ok in kinds for m in r.finditer(text) if ok(m)]
    assert secrets.base_findings(text) == want
    df = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.report(df).collect()}
    assert got[1].n_assign + got[1].n_access + got[1].n_hex == len(want) and got[2].spans == got[3].spans == ""


def brute_hits(words, items, window=10):
    hit, found = set(), set()
    for item, w in items:
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(item)
    return hit, found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    vocab = ["a", "B", "c", "é", "d1", "the"]
    items = [(str(k), [rng.choice(vocab).lower() for _ in range(rng.choice((0, 1, 4, 9, 10, 11, 25)))]) for k in range(30)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", "-"]
    for i in range(8):
        texts.append("x, " + ". ".join(items[i][1]) + " y")
    items = [x for x in items if len(x[1]) != 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), " ".join(w).upper() if len(w) % 2 else " ".join(w)) for k, w in items] + [(500, None)], "item_id long, text string")
    upper = [(k, [x.replace("É", "é") for x in w]) for k, w in items]
    want = {}
    for i, t in enumerate(texts):
        w = [x.decode() for x in dc.words_of(t or "")]
        hit, found = brute_hits(w, [(k, [y.decode() for y in dc.words_of(" ".join(v).upper() if len(v) % 2 else " ".join(v))]) for k, v in upper])
        want[i] = (len(w), len(hit), len(found), dc.hex256(",".join(sorted(found))), bool(hit))
    for block in (200_000, 40):
        got = {r.doc_id: tuple(r)[1:] for r in dc.report(docs, bench, block_words=block).collect()}
        assert got == want


def test_bpe_equals_library(spark):
    import hashlib

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    from strandmill.llm import byte_bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["".join(rng.choice("abst'é漢🙂 \n\t\x1c\xa0.,01ße") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", "a" * 5000, " " * 300, "don't  we'll\r\n\n x", "<|endoftext|>", "é" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lone in (True, False):
        for r in byte_bpe.digest_documents(df, path, P.PATTERN, lone_space=lone).collect():
            ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4")
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    decoder = byte_bpe.Decoder(ranks)
    raw = bytes(rng.randrange(256) for _ in range(4000))
    one_byte = [ranks[bytes((b,))] for b in raw]
    assert decoder.feed(one_byte) + decoder.finish() == raw.decode("utf-8", "replace")


def test_repeated_ids_give_one_training_row(spark):
    rows, labels = corpus(120, 4)
    docs = spark.createDataFrame(rows + [rows[0]] * 50, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    got = quality.score(docs, known).collect()
    assert len(got) == 170 and len({r.p_quality for r in got if r.doc_id == 0}) == 1
