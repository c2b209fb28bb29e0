"""Text files as numbered lines, with what only their place in the file can tell: torn ends, and records over several lines.

A line's place is (file, block, seq): files are read in splits, ``block`` is the offset of a split in its file and
``seq`` grows within it. A large file is read by many tasks; nothing here needs a file or a split as one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PLACE = ["file", "block", "seq"]


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, seq, size, line) of every line; only a line feed ends one."""
    meta = lambda name: F.col(f"_metadata.{name}")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), meta("file_size").alias("size"), F.col("value").alias("line"))


def with_torn(lines: DataFrame) -> DataFrame:
    """Add ``torn``: the last line of a file whose last byte is no line feed.

    Told by counting: the lines and one byte for each are the file's size, or one byte more if the
    last line has no end. (The three bytes of a byte order mark are not part of the first line.)
    """
    order = F.struct("block", "seq")
    ends = lines.groupBy("file").agg((F.sum(F.octet_length("line") + 1) - F.max("size")).alias("_over"), F.max(order).alias("_last"))
    ends = ends.filter(F.col("_over").isin(1, -2)).select(F.col("file").alias("_file"), "_last")
    met = (F.col("file") == F.col("_file")) & (order == F.col("_last"))
    return lines.join(ends, met, "left").select(*lines.columns, F.col("_last").isNotNull().alias("torn"))


def quoted_records(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(file, block, seq, record): lines joined where a line feed stands inside quotes.

    A line begins a record if an even number of quotes is before it in its file. Each split counts its own
    quotes; the parity in which it begins is that of the splits before it, so no task has to read what
    another one reads. Only records of several lines are shuffled. A quote left open takes the rest of its file.
    """
    count = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    rows = lines.select(*PLACE, "line", (count % 2).alias("_odd"))
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    splits = rows.groupBy("file", "block").agg(
        F.sum("_odd").alias("_quotes"),
        F.max(F.when(F.col("_inside") == 0, F.col("seq"))).alias("_begin0"), F.max(F.when(F.col("_inside") == 1, F.col("seq"))).alias("_begin1"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_parity", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    begin = F.when(F.col("_parity") == 0, F.col("_begin0")).otherwise(F.col("_begin1"))
    splits = splits.withColumn("_open", F.last(F.when(begin.isNotNull(), F.struct("block", begin.alias("seq"))), True).over(earlier))
    rows = rows.join(splits.select("file", "block", "_parity", "_open"), ["file", "block"])
    begins = F.col("_inside") == F.col("_parity")
    rows = rows.withColumn("_begins", begins)
    here = F.max(F.when(F.col("_begins"), F.col("seq"))).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_head", F.when(here.isNotNull(), F.struct("block", here.alias("seq"))).otherwise(F.col("_open")))
    whole = F.col("_begins") & (F.col("_odd") == 0)
    single = rows.filter(whole).select(*PLACE, F.col("line").alias("record"))
    parts = rows.filter(~whole).groupBy("file", "_head").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("_all"))
    joined = parts.select("file", F.col("_head.block").alias("block"), F.col("_head.seq").alias("seq"), F.array_join(F.transform("_all", lambda x: x["line"]), "\n").alias("record"))
    return single.unionByName(joined)
