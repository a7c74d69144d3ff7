"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: A row without an id counts as later than every row with one.
NO_ID = (1 << 63) - 1


#: Bytes of an Arrow batch between the JVM and Python, however long the rows are (one row at least).
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, as their bound by rows lets long texts pile up."""
    if spark.conf.get(_BATCH_CONF, "64m") != str(BATCH_BYTES):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def settle() -> None:
    """Gives memory that earlier tasks of this worker have freed back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: dict = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """What this worker keeps from task to task, made once; it keeps one thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        settle()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Frees what tasks of another operator have left in this worker."""
    if _HELD:
        _HELD.clear()
        settle()


def byte_slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES // 2) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts take up `limit` bytes together, or of one longer text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if total + n > limit and k > start:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Without one, a local session (as in tests) gets a
    folder of its own; a cluster is refused, as its machines could not read each other's files."""
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


#: Spark deletes the shuffles of a statement when it ends, not when the driver happens to collect its garbage.
_FREE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives a lost executor. free: the shuffles
    that made it are deleted at once; `df` is not to be run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_CONF, "false")
    spark.conf.set(_FREE_CONF, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing reads any more: no plan that is still to run may use them."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(names: list[str], wanted: str) -> str:
    """A column name that none of `names` has, whatever the case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ids_of(column: pa.Array) -> np.ndarray:
    """An id column as int64, nulls as NO_ID."""
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def id_or_none(value: int) -> int | None:
    return None if value == NO_ID else int(value)


def texts_of(column: pa.Array) -> list[str]:
    """A text column with nulls as empty strings."""
    return column.cast(pa.string()).fill_null("").to_pylist()


def hex256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_words(words: list) -> np.ndarray:
    """64-bit hashes of words (str or bytes), the same in every process and on every machine."""
    import pandas as pd

    if not words:
        return np.empty(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return mix64(pd.util.hash_array(values, categorize=True))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n consecutive hashes."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
    return mix64(out)


_CODEC = pa.Codec("zstd", 3)


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte by byte, compressed."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = _CODEC.decompress(data[8:], n * 8, asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel()
