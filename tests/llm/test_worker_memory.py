"""What the stages of the pipeline leave in a Python worker, and how many workers a task needs."""

from pyspark.sql import DataFrame

from strandmill.llm import byte_bpe, common, decontaminate, near_join, quality, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_decontamination_is_one_python_step(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y", "en", "s", 23)], DOCS)
    items = spark.createDataFrame([(k, f"a b c d e f g h i j z{k}") for k in range(3)], "item_id long, text string")
    for out in (decontaminate.remove_spans(docs, items), decontaminate.report(docs, items)):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    for block in (200_000, 5):
        assert [tuple(r)[:2] for r in decontaminate.remove_spans(docs, items, block_words=block).collect()] == [(1, "x  y")]
        assert [(r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, items, block_words=block).collect()] == [(12, 10, 3)]


def test_stages_free_what_the_encoder_keeps(spark, tmp_path, monkeypatch):
    import base64

    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(bytes((b,))) + b" %d\n" % b for b in range(256)))
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    tasks = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, task, *_: tasks.append(task) or self)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, *_: tasks.append(task) or self)
    decontaminate.remove_spans(docs, items)
    secrets.redact(docs)
    near_join._sketched(docs.withColumnRenamed("doc_id", "doc"), 5)
    try:
        quality._judged(docs, {}, frozenset())
    except Exception:  # its columns are those of the documents here, as the task is not in the plan
        assert len(tasks) == 4
    assert len(tasks) == 4
    for task in tasks:
        first = byte_bpe.coders(str(ranks), ".", False)
        assert byte_bpe.coders(str(ranks), ".", False) is first and len(common._HELD) == 1
        list(task(iter([])))
        assert not common._HELD


def test_no_rows_of_the_driver_pass_a_python_worker(spark, monkeypatch):
    from types import SimpleNamespace

    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (2, None, "en", "s", 5)], DOCS)
    rows = [("quality", "word", b"", 50, 50), ("quality", "word", b"a", 40, 1), ("quality", "word", b"b", 2, 2)]
    counts = spark.createDataFrame(rows, "head string, view string, key binary, ones long, zeros long")
    learner = SimpleNamespace(head=quality.Head(words={b"b": 1.0, b"c": 1.0}), knows=True, fit_on=range(200))
    monkeypatch.setattr(quality, "_judged", lambda *_: counts)
    made, create = [], type(spark).createDataFrame

    def noted(self, *args, **options):
        made.append(create(self, *args, **options))
        return made[-1]

    monkeypatch.setattr(type(spark), "createDataFrame", noted)
    assert quality._taught(docs, {"quality": learner}, frozenset())["quality"].words == {b"a": (40, 1), b"b": (2, 2)}
    assert sorted(r.class_id for r in near_join.near_join(docs).collect()) == [1, 2]
    assert near_join.near_join(docs.limit(0)).count() == 0
    for out in made:
        assert "PythonRDD" not in out._jdf.queryExecution().toRdd().toDebugString()
