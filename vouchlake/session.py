"""Session settings and the two size/lineage guards the jobs share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Folders of intermediates that this process has named.
WRITTEN: list[str] = []

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "vouchlake", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where driver and executors are one process."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not one_process(context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def forget(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate that no later read needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def durable(df: DataFrame) -> DataFrame:
    """Write a shared intermediate once and read it back, so a lost executor cannot change it.

    A written table is computed one time (an RDD checkpoint computes twice), keeps
    its size for later join choices and is read column by column.
    """
    path = scratch(df.sparkSession, "table")
    untyped = {f.name: F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    (df.withColumns(untyped) if untyped else df).write.parquet(path)
    return df.sparkSession.read.schema(df.withColumns(untyped).schema if untyped else df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediates, on the shared checkpoint storage."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


@contextmanager
def released(spark: SparkSession):
    """Remove, at the end, the intermediates written inside: for jobs whose results are stored elsewhere."""
    start = len(WRITTEN)
    try:
        yield
    finally:
        while len(WRITTEN) > start:
            forget(spark, WRITTEN.pop())


#: Whether the files of a job's shuffles go when the job ends, not when the driver's JVM happens to collect its plan.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):
    """Inside, the shuffle files of a job go as soon as it ends: for long runs of jobs that each write a table."""
    before = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)
        settle(spark)


def settle(spark: SparkSession) -> None:
    """Let the driver's JVM collect the plans of ended jobs, so that its heap does not grow from one stage to the next."""
    spark._jvm.System.gc()


def spread(df: DataFrame, scan: bool = True, rows: int = 20_000) -> DataFrame:
    """Deal out rows for costly parsing, so that a task's share does not grow with the table: about ``rows`` a task, and all cores.

    A scan with enough splits is returned as it is; its rows are counted from the files' footers.
    ``scan=False`` is for a shuffled result that AQE would fold into few tasks by its bytes.
    """
    spark = df.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not scan:
        return df.repartition(width)
    width = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df if df.rdd.getNumPartitions() >= width else df.repartition(width)
