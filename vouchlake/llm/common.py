"""What the operators share: batch bounds, packed arrays, row identity and the query registry."""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLE: dict = {}

#: Bytes of one Arrow batch between the JVM and Python; bounds memory where rows are long.
BATCH_BYTES = 8 << 20


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> SparkSession:
    """Arrow batches limited by bytes as well as by rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


class Shared:
    """A broadcast object whose class travels with it, so executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self):
        return cloudpickle.loads(self.packed.value)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, all first bytes first: small numbers then compress well."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype, count: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, count * size).reshape(size, count).T).view(dtype).ravel()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive integers in a sorted array as (first, last + 1)."""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    return starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]] + 1
