import random

import numpy as np

from strandmill.llm import near_join as nj


def shingles(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[k : k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)) if w else frozenset()


def brute(rows):
    sets = {}
    for i, t in rows:
        if s := shingles(t):
            sets.setdefault(s, []).append(i)
    keys = list(sets)
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            n = len(keys[a] & keys[b])
            if n and n >= 0.8 * (len(keys[a]) + len(keys[b]) - n):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    group = {}
    for k, s in enumerate(keys):
        group.setdefault(find(k), []).extend(sets[s])
    out = set()
    for i, t in rows:
        s = shingles(t)
        if not s:
            out.add((i, i, i, 0))
        else:
            k = keys.index(s)
            out.add((i, min(group[find(k)]), min(sets[s]), links[k]))
    return out


def corpus(n, near, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 120))) for _ in range(n)]
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(near):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for k in range(0, n, 3):
        w = texts[k].split()
        if k % 2:
            w[rng.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    texts += ["", None, "one two", "one  two", "a " * 50, "a " * 20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus(150, 90)
    monkeypatch.setattr(nj, "SMALL", 8)
    monkeypatch.setattr(nj, "BLOCK", 32)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert set(map(tuple, nj.near_join(df).collect())) == brute(rows)


def test_kept_documents(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "x y z"), (1, None), (2, "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, links string, n int")
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]


def test_empty_table(spark):
    assert nj.near_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 20).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = nj.overlaps(sets)
    assert all(want[i][j] is None or want[i][j] == got[i, j] for i in range(9) for j in range(9))
