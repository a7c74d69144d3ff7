"""A corpus pipeline of five stages, each over all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the encoded documents.
Its rows are written as Parquet and read again as the docs of the next.

In every stage null and empty texts and null ids pass without a crash: the classifier judges them by their metadata,
the join leaves them alone, the others leave them unchanged or give them no tokens. Repeated rows are judged alike; of
such with one id and text that stand for a group, the join keeps one. An empty table gives an empty table. Columns
beyond those of documents pass through the first four stages, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import byte_bpe, decontaminate, near_join, quality, secrets
from strandmill.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.redact(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become tokens: their number and the digests of the ids and of what they decode to."""
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digest_documents(docs, path, tokenizers.PATTERN, lone_space=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("byte-level BPE", encoding_stage),
]

#: The classifier and the join have no SQL form; tests/llm/test_pipeline_brute.py holds all stages but the classifier
#: against plain forms over what they are given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
