"""Stages on empty tables, nulls, very long and repeated rows, and columns named like the operators' own; the classifier
row by row."""

import numpy as np
from test_pipeline import corpus

import corpus_pipeline as cp
from strandmill.llm import decontaminate, quality
from strandmill.llm.decontaminate import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, rows, extra=""):
    known, labels = corpus(200, 4)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    item = " ".join(f"item{k}" for k in range(12))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return known, spark.createDataFrame(rows, DOCS + extra), item


def test_empty_table(spark, tmp_path):
    _, docs, _ = tables(spark, tmp_path, [])
    for _, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_names_nulls_long_and_repeated_rows(spark, tmp_path):
    mine = ", _rows_ int, kept_id int, hit_spans int, _hit_items_ int, keep int, words int, id int, key string"
    item = " ".join(f"item{k}" for k in range(12))
    long = " ".join(f"w{k % 5000}x{k % 7}" for k in range(60_000))
    texts = [(900, None), (901, ""), (902, long), (903, f"so it is {item} said"), (903, f"so it is {item} said"), (None, "no id at all"), (904, 'token = "abcdefgh12"')]
    rest = (1, 2, 3, 4, 5, 6, 7, "k")
    rows = [(i, t, None, "s", None, *rest) for i, t in texts]
    known, docs, _ = tables(spark, tmp_path, rows, mine)
    docs = docs.unionByName(spark.createDataFrame([(*r, *rest) for r in known], DOCS + mine))
    columns, out = docs.columns, {}
    for name, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        out[name] = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", r.hit_spans, r.key) for r in docs.collect())
    joined = out["n-gram Jaccard join"]
    assert [r[0] for r in joined if r[0] >= 900 or r[0] < 0] == [-1, 900, 901, 902, 903, 904]
    last = {r[0]: r[1] for r in out["secret scan"]}
    assert last[903] == "so it is  said" and last[904] == '[SECRET]"' and last[902] == long and all(r[2:] == (3, "k") for r in out["secret scan"])
    assert cp.STAGES[4][1](spark, docs, str(tmp_path)).count() == len(last)
    found = cp.STAGES[0][1](spark, docs, str(tmp_path))
    assert found.columns == columns and found.count() > 0


def test_blocks_of_items_with_own_names(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y", 5, 6), (2, None, 5, 6)], "doc_id long, text string, hit_spans int, hit_items int")
    items = spark.createDataFrame([(k, f"a b c d e f g h i j z{k}") for k in range(3)], "item_id long, text string")
    for block in (200_000, 5):
        out = {r.doc_id: r for r in decontaminate.remove_spans(docs, items, length_col=None, block_words=block).collect()}
        assert out[1].text == "x  y" and out[2].text is None and out[1].hit_spans == 5 and out[1].hit_items == 6


def test_scores_equal_those_of_single_rows(spark):
    rows, labels = corpus(600, 9)
    docs = spark.createDataFrame([*rows, (10_000, None, None, None, None), rows[3]], DOCS)
    known = spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")
    heads = quality.train(docs, known)
    got = quality.score(docs, known).collect()
    assert len(got) == len(rows) + 2
    by_id = {r[0]: r for r in [*rows, (10_000, None, None, None, None)]}
    for r in got:
        _, text, lang, source, n = by_id[r.doc_id]
        words = words_of(text or "")
        distinct = sorted(set(words))
        lay = quality.layout(text or "", words, len(distinct))
        place = np.zeros(quality.N_META)
        a, b, c = quality.cell(lang, source, n)
        place[[0, 1 + a, 1 + quality.PLACES + b, 1 + 2 * quality.PLACES + c]] = 1
        for h, p in (("quality", r.p_quality), ("toxic", r.p_toxic)):
            m = heads[h]
            seen = [x if m.by_layout or k == 0 else 0 for k, x in enumerate(lay)] + quality.word_features(distinct, m.words)
            z = sum((x - u) / v * w for x, u, v, w in zip(seen, m.mean, m.spread, m.content, strict=True))
            z = m.mixing[0] + m.mixing[1] * z + m.mixing[2] * float(place @ m.meta)
            assert abs(p - 1 / (1 + np.exp(-z))) < 1e-6


def test_views_teach_each_other(spark):
    """A word that only unlabelled documents of a tell-tale source have gets a weight from the metadata view, once it
    has seen enough labelled ones to be sure of that source."""
    rows, labels = corpus(2000, 10)
    rows = [(k, t, "en", "junk" if not q else "good", n) for (k, t, _, _, n), (_, q, _) in zip(rows, labels, strict=True)]
    more = [(5000 + k, rows[k][1] + (" newjunk" if labels[k][1] == 0 else " fresh"), "en", rows[k][3], rows[k][4]) for k in range(2000)]
    docs = spark.createDataFrame(rows + more, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    alone, taught = (quality.train(docs, known, rounds=n)["quality"].words for n in (1, 3))
    assert b"newjunk" not in alone and taught.get(b"newjunk", 0) < 0
