import numpy as np

from strandmill.llm import lm_score, queries


def test_query_scores_by_trigrams(spark, tmp_path):
    # Both of the last texts have bigrams that occur elsewhere; only the first one's trigrams do.
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "x b d y"), (4, "a b c"), (5, "x b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_backoffs, r.log_score) for r in queries.op1_lm_score(spark, str(tmp_path)).collect()}
    assert got[4][0] == 0 and got[5][0] == 1
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert got == {r.doc_id: (r.n_backoffs, r.log_score) for r in lm_score.score(df, order=3).collect()}


def test_requests_of_one_order_at_a_time(spark):
    """What scoring leaves on disk is batches and answers, not the requests of every order."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 2_000, 100))) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_"))

    before = shuffled()
    assert lm_score.score(df, order=3, batches=8).count() == 2_000
    assert shuffled() - before < 8 * 200_000
