"""Near duplicates: groups of near copies of any likeness, clashing names, nulls, empty tables."""

import random

from test_near_join import brute

from strandmill.llm import near_join as nj


def test_group_from_unlike_to_equal(spark):
    """A group whose pairs lie on both sides of the threshold, larger than a block, among texts of their own."""
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocab) for _ in range(150)]
    texts = []
    for _ in range(620):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 80))) for _ in range(150)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {tuple(r) for r in nj.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_leaders_stand_for_those_close_to_them():
    import numpy as np

    x = np.zeros((4, nj.COORDS), np.uint32)
    x[2:] = 7
    x[3, :5] = 9
    same = nj.agreement(x)
    assert same[0, 1] == nj.COORDS and same[0, 2] == 0 and same[2, 3] == nj.COORDS - 5
    assert nj.leaders(same >= nj.COORDS).tolist() == [0, 0, 2, 3]
    assert nj.leaders(same >= nj.COORDS - 5).tolist() == [0, 0, 2, 2]


def test_names_of_its_own_in_the_table(spark):
    rows = [(1, "a b c d e f", 5, 6, 7, 8), (2, "a b c d e f", 5, 6, 7, 8), (2, "a b c d e f", 5, 6, 7, 8), (3, "", 1, 1, 1, 1), (None, None, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rows_ int, kept_id int, n_rows int, text_hash int")
    out = nj.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 1), (False, 3), (True, None)]


def test_empty_table_and_one_long_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_join(docs).count() == 0 and nj.one_of_each(docs).count() == 0
    long = " ".join(f"x{k}" for k in range(150_000))
    rows = [(1, long), (2, long + " y"), (3, "x1 x2")]
    out = {r.doc_id: (r.class_id, r.n_links) for r in nj.near_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
