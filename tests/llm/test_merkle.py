import hashlib
import random
import zlib

import pytest

from strandmill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climb(nodes, fanout=16):
    """The root of the nodes and, for each, its siblings level by level as (left, right)."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            lo = a - a % fanout
            steps[k].append(("".join(nodes[lo:a]), "".join(nodes[a + 1 : lo + fanout])))
        nodes = [h(*nodes[lo : lo + fanout]) for lo in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    out, subs, below = [], [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, steps = climb([leaf(*r) for r in own])
        subs.append(root)
        below.append(list(zip(own, steps, strict=True)))
    if not subs:
        return []
    root, tops = climb(subs)
    for sub, top, own in zip(subs, tops, below, strict=True):
        for r, steps in own:
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            fold = leaf(r[0], text, *r[2:])
            for a, b in steps + top:
                fold = h(a, fold, b)
            out.append((r[0], leaf(*r), sub, root, h(*(a + b for a, b in steps + top)), fold, fold == root))
    return sorted(out, key=str)


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    words = ["Ab", "é", "Z", "x", "ÀB", ""]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))), rng.choice(["en", None]), rng.choice(sources), rng.choice([1, 22, None])) for k in range(n)]


EDGES = [(None, "Null Id", None, "a", 1), (None, "Null Id", None, "a", 1), (5, None, None, None, None), (5, "", "", "", 0), (7, "Twice", "en", "a", 5), (7, "Twice", "en", "a", 5), (7, "Other", "en", "a", 5), (-3, "A" * 200_000, "en", "b", 200_000)]


@pytest.mark.parametrize(
    "rows",
    [
        rows_of(700, ["a"] * 12 + [None, "", "é", "Z", "zz"]) + EDGES,
        rows_of(16, ["a"]),
        rows_of(17, ["a"]),
        rows_of(1, ["a"]),
        rows_of(300, [f"s{k}" for k in range(150)]),
        [],
    ],
)
def test_equals_brute_force(spark, rows):
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA).repartition(3)
    assert sorted(map(tuple, merkle.report(df).collect()), key=str) == brute(rows)


def test_counts_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", 0)
    rows = rows_of(300, ["a", "b", "b", None])
    assert sorted(map(tuple, merkle.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_levels_hold_the_tree_and_names_may_clash(spark):
    rows = [(k, f"t{k}", k % 3, k, k) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, hash string, g long, place long, node long")
    out, levels = merkle.manifest(df, "g", "id", merkle.leaf_of(df.id, df.hash), {"n": df.place, "steps_of": df.node}, fanout=4)
    found = {r.id: r for r in out.collect()}
    assert all(found[k].n == found[k].steps_of == k for k in range(40)) and len({r.root for r in found.values()}) == 1
    assert [level.count() for level in levels] == [4 + 4 + 4, 3, 1]
    assert found[6].place == 2 and found[6].group == 0
