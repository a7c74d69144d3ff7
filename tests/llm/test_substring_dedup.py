import hashlib
import random
import re

from strandmill.llm import substring_dedup as sd


def brute(rows, window=13):
    rows = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, sd.NO_ID), sd.NO_ID if i is None else i)
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (sd.NO_ID if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)] + ["é", "\xa0x", "the", "the", "the"]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(10, 40))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "the " * 500), (n + 4, "the " * 40), (3, rows[3][1]), (None, rows[4][1]), (n + 5, "a b c")]
    rows += [(2, "x " + rows[50][1])]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "SLICE_BYTES", 3000)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, sd.report(df, buckets=7).collect()), key=str)
    assert got == brute(rows)


def test_one_window_more_or_less(spark):
    words = [f"u{k}" for k in range(30)]
    rows = [(1, " ".join(words[:12])), (2, " ".join(words[:12])), (3, " ".join(words[:13])), (4, "z " + " ".join(words[:13]) + " y")]
    got = {r.doc_id: r.n_removed for r in sd.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 13}


def test_empty_table(spark):
    assert sd.report(spark.createDataFrame([], "doc_id long, text string, n_words int")).count() == 0
