"""C19 over an index: postings of three-letter pieces find the few blocks of profiles that can match, whose texts are then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Parts of the postings by hash of the piece; a search reads those of its own pieces.
PARTS = 64
PIECE = 3
#: Texts of one block; it divides 2^33, the distance of two tasks' first ids, so that no block crosses tasks.
BLOCK = 64


def _part(piece) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(PARTS)).cast("int")


def searched_text(texts: list[str], values: str | None = None) -> Column:
    """What a search looks through: the cells and all values of a profile, in lower case."""
    cells = [F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts]
    return F.lower(F.concat_ws(" ", *cells, *([F.array_join(values, " ")] if values else [])))


def _pieces(text) -> Column:
    """All pieces of a text, one from each place; empty where it is shorter than a piece."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1))


def build_index(profiles: DataFrame, key: str, text: Column, path: str) -> None:
    """Write the texts by key and block, and the blocks of every piece: sorted by piece inside its part, so that a part's file is read in places only.

    A block is ``BLOCK`` texts in a row of one task. Pieces that its texts share are one posting, which the task that reads the block finds before anything is shuffled.
    """
    rows = profiles.select(F.col(key).alias("key"), text.alias("text")).withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK))
    rows.write.mode("overwrite").parquet(f"{path}/texts")
    stored = profiles.sparkSession.read.parquet(f"{path}/texts")
    postings = stored.select("block", F.explode(_pieces("text")).alias("piece")).distinct().withColumn("part", _part("piece"))
    postings.repartition(PARTS, "part").sortWithinPartitions("part", "piece", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Keys of the profiles whose text holds the query: the same rows as a scan of all texts.

    Texts of blocks that hold every piece of the query are verified. A query of fewer letters than a piece has no postings and scans.
    """
    asked = spark.range(1).select(F.lower(F.lit(query.strip())).alias("q")).withColumn("pieces", F.array_distinct(_pieces("q")))
    asked = asked.select("q", F.transform("pieces", lambda p: F.struct(p.alias("piece"), _part(p).alias("part"))).alias("pieces")).first()
    texts = spark.read.parquet(f"{path}/texts")
    found = texts
    if asked["pieces"]:
        pieces, parts = [p["piece"] for p in asked["pieces"]], sorted({p["part"] for p in asked["pieces"]})
        postings = spark.read.parquet(f"{path}/postings").filter(F.col("part").isin(parts) & F.col("piece").isin(pieces))
        every = postings.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") >= len(pieces))
        found = texts.join(every, "block", "left_semi")
    return found.filter(F.contains("text", F.lit(asked["q"]))).select("key")
