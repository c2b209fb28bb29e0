"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; rank r of n in a source
with offset u (a hash of the source, 0 <= u < 1) gets the fractional rank (r + u) / n.
All rows in the order of that fraction are cut into equal runs, so every shard holds
every source in the proportion of the whole, to within a row or two, and shard sizes
differ by at most one row (law ``rows``). The offset spreads sources of few rows.

No source is ranked in one task: a source is cut by its hash into buckets of about
``BUCKET`` rows, ranked inside and moved up by the counts of the buckets before; the
fractional ranks, which are evenly spread by construction, likewise. Texts are read once,
for size and checksum, and never shuffled.

Defined cases: a null text has size 16 and checksum 0 like an empty one; null source is a
source of its own; null, repeated and equal rows each get a slot (ties by doc_id, then
checksum and size); fewer rows than shards leave shards empty; an empty table gives an
empty result; other columns are not read. The law keeps no copies together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouchlake.llm.components import stored

BUCKET = 4096


def _unit(text: Column) -> Column:
    """First 32 bits of an md5, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def _numbered(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """0-based rank inside ``keys`` by bucket, then ``order``; the bucket counts are a small table."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_c"))
    starts = counts.select(*keys, bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    return inside.join(starts, [*keys, bucket]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in", bucket)


def interleave(docs: DataFrame, shards: int = 40, seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, source_key, fraction, shard, slot) of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        source.alias("source_key"),
        _unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    )
    base, _ = stored(base, "rows")
    sizes, _ = stored(base.groupBy("source_key").agg(F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ties = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows = base.join(sizes, "source_key").withColumn("b", F.floor(F.col("h") * (F.floor(F.col("n") / BUCKET) + 1) / F.lit(float(1 << 32))))
    rows = _numbered(rows, ["source_key"], "b", [F.col("h"), *ties], "r")
    offset = _unit(F.concat(F.lit(f"{seed}:"), F.col("source_key"))) / F.lit(float(1 << 32))
    rows = rows.withColumn("fraction", (F.col("r").cast("double") + offset) / F.col("n"))
    rows = rows.withColumn("c", F.floor(F.col("fraction") * (total // BUCKET + 1)))
    rows = _numbered(rows, [], "c", [F.col("fraction"), F.col("source_key")], "position")
    # Shard k starts at the first position p with p * shards >= k * total.
    shard = F.expr(f"position * {shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.col("position") - first)
    return rows.select("doc_id", "size", "text_crc32", "source_key", "fraction", F.col("shard").cast("int").alias("shard"), "slot")
