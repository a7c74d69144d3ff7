"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without it (as in tests) gets a folder of its own, a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    set_here = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_here.isDefined():
        return str(set_here.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="strandmill-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives a lost executor."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that no plan still to run reads."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
