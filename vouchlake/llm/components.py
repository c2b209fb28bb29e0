"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouchlake.session import forget, scratch


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to the shared folder and read back; the path is returned for ``forget``."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b). Large step: hang larger neighbours on the least one; small step: smaller ones."""
    sides = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        met = sides.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        met = sides.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        met = met.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return met.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its least node.

    ``links`` has longs ``a`` and ``b``. Each round is a written table, so a lost
    executor costs at most one round; the number of rounds grows with the logarithm
    of the longest chain. Nodes without a link do not appear.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links, path = stored(links, "links")
    mark = None
    while True:
        nearer, next_path = stored(_star(_star(links, True), False), "links")
        now = tuple(nearer.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(spark, path)
        links, path = nearer, next_path
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
