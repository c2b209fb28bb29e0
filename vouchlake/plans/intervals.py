"""The facts of all runs as validity intervals, so that any run can be read as of its time.

A run's view has one row per fact it shows, current ones and those kept as last known. An interval opens at the
first run that shows a row and closes at the first that does not show it so. Closed intervals
are appended and never read by a later merge; the open ones are one version per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouchlake.sinks.tables import _exists


def _mark(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def merge_run(spark: SparkSession, view: DataFrame, path: str, at: str, before: str | None) -> None:
    """Merge the view of the run at ``at`` into the intervals; ``before`` is the time of the run before it.

    A merge that is repeated starts from the same open intervals and writes the same.
    """
    columns = view.columns
    shown = view.withColumn("_mark", _mark(columns)).dropDuplicates(["_mark"])
    if before is not None and _exists(spark, f"{path}/open/at={before}"):
        held = spark.read.parquet(f"{path}/open/at={before}")
        gone = held.join(shown.select("_mark"), "_mark", "left_anti").withColumn("valid_to", F.lit(at))
        kept = held.join(shown.select("_mark"), "_mark", "left_semi")
        fresh = shown.join(held.select("_mark"), "_mark", "left_anti").withColumn("valid_from", F.lit(at))
        gone.write.mode("overwrite").parquet(f"{path}/closed/at={at}")
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{path}/open/at={at}")
    else:
        shown.withColumn("valid_from", F.lit(at)).write.mode("overwrite").parquet(f"{path}/open/at={at}")


def as_of(spark: SparkSession, path: str, at: str, newest: str) -> DataFrame:
    """The view of the run at ``at``; ``newest`` is the time of the last merged run. Times are texts that sort by time."""
    rows = spark.read.parquet(f"{path}/open/at={newest}").withColumn("valid_to", F.lit(None).cast("string"))
    if _exists(spark, f"{path}/closed"):
        rows = rows.unionByName(spark.read.parquet(f"{path}/closed").drop("at"))
    seen = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return rows.filter(seen).drop("_mark", "valid_from", "valid_to")
