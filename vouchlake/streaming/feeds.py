"""The landing feeds as Structured Streaming queries; T1 is in ``history``.

Every write of a micro-batch goes to a folder named by the batch id and is overwritten on
replay, which keeps results exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F



def open_feed(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder (or glob) of files as a stream with the schema the files have now."""
    schema = spark.read.format(fmt).load(path).schema
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _run(df: DataFrame, handle, checkpoint: str, mode: str = "append") -> None:
    writer = df.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_dedupe(bodies: DataFrame, key: list[str], at: str, delay: str, path: str) -> None:
    """One row per content key within the watermark."""
    unique = bodies.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)
    query = unique.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


#: Parts of a table of latest rows; a micro-batch rewrites the parts that its keys fall into.
PARTS = 16


def _versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """Part -> (batch, folder) of its complete versions, newest first; at most two per part stay stored."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = {s.getPath().getParent().getName() for s in files.globStatus(hadoop(f"{root}/batch_id=*/_SUCCESS")) or ()}
    found: dict[int, list[tuple[int, str]]] = {}
    for status in files.globStatus(hadoop(f"{root}/batch_id=*/part=*")) or ():
        folder = status.getPath()
        batch = int(folder.getParent().getName().split("=")[1])
        if folder.getParent().getName() in whole and (before is None or batch < before):
            found.setdefault(int(folder.getName().split("=")[1]), []).append((batch, folder.toString()))
    return {part: sorted(versions, reverse=True) for part, versions in found.items()}


def stream_latest(observations: DataFrame, key: str, order: list[str], path: str, parts: int = PARTS) -> None:
    """The latest success per key in a table of ``parts`` parts by key hash.

    A micro-batch reads the parts its keys fall into, merges, and writes their next versions in its own
    folder; other parts are neither read nor written. A replayed batch starts from the versions before
    it and writes the same. What two newer versions replace is removed, so the stored files stay as many.
    """
    from vouchlake.session import forget
    from vouchlake.sinks.tables import latest_success

    root = f"{path}/latest"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest_success(batch, key, order).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        held = _versions(spark, root, batch_id)
        touched = [r["part"] for r in new.select("part").distinct().collect()]
        known = [held[p][0][1] for p in touched if p in held]
        if known:
            stored = spark.read.option("basePath", root).schema(new.withColumn("batch_id", F.lit(0)).schema).parquet(*known).drop("batch_id")
            new = latest_success(new.unionByName(stored), key, order)
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/batch_id={batch_id}")
        for part in touched:
            for _, folder in held.get(part, [])[1:]:
                forget(spark, folder)

    _run(observations, handle, f"{path}/checkpoint")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """One row per key: the newest version of every part."""
    root = f"{path}/latest"
    newest = [versions[0][1] for versions in _versions(spark, root).values()]
    return spark.read.option("basePath", root).parquet(*newest).drop("batch_id", "part")


def request_rates(log: DataFrame, at: str, host: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """T4: requests and limited requests per host and window; rows later than the watermark are dropped.

    The same expression serves batch and stream.
    """
    span = F.window(at, width, slide) if slide else F.window(at, width)
    frame = log.withWatermark(at, delay) if log.isStreaming else log
    rates = frame.groupBy(host, span.alias("w")).agg(F.count("*").alias("requests"), F.count_if("limited").alias("limited"))
    return rates.select(host, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "limited", (F.col("limited") > 0).alias("cooling"))


def stream_request_rates(log: DataFrame, path: str, **kwargs) -> None:
    rates = request_rates(log, **kwargs)
    query = rates.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rates").option("checkpointLocation", f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


def stream_progress(journal: DataFrame, path: str) -> None:
    """T5: completed rows per state as the journal grows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/progress/batch_id={batch_id}")

    _run(journal.groupBy("state").agg(F.count("*").alias("n")), handle, f"{path}/checkpoint", "complete")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/progress")
    newest = rows.agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, "batch_id", "left_semi").drop("batch_id")
