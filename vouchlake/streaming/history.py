"""Change history of a stream on keyed engine state.

Streaming queries over RocksDB state, so that no key's history is ever held by one task:

1. *final*: the engine's own aggregate by (key, time) holds the rows of one time until the watermark has passed it.
   Later rows of the stream are all after what it has put out.
2. *inner*: what became final is laid out in (key, order) ranges (``windows.running``) and each row gets the value before it;
   what stands before a key's first row there is not known here.
3. *edges*: state per key holds the last value met. It sees one row per key and batch of 2 and completes the first rows.

Late rule: a row counts if its time is after the watermark of its micro-batch, which is the
greatest time of all earlier batches less ``delay``; other rows are left out, as are rows without a time.
Whatever the batches and their order within the delay, the result is that of the same rows in
one batch. Rows that the watermark has not passed are held back until it does.
"""

from __future__ import annotations

import pickle
import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from vouchlake.operators.windows import change_history
from vouchlake.session import durable, released

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MULTIPLE = "spark.sql.streaming.statefulOperator.allowMultiple"
HELD = T.StructType([T.StructField("row", T.BinaryType())])


def _kind(known: bool, before, now) -> str:
    return "first" if not known else "same" if before == now else "changed"


class Edges(StatefulProcessor):
    """First rows of buckets with the value that the key had before; rows of a key come by bucket."""

    def __init__(self, columns: list[str], value: str):
        self.columns, self.value = columns, value

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", HELD)

    def handleInputRows(self, key, rows, timerValues):
        found = sorted(rows, key=lambda r: r["bucket"])
        known = self.last.exists()
        held = pickle.loads(self.last.get()[0]) if known else (None, None)
        for r in found:
            if known and r["bucket"] <= held[0]:
                raise RuntimeError(f"bucket {r['bucket']} of {key} comes after {held[0]}")
            kept = {c: r[c] for c in self.columns}
            yield Row(**kept, before=held[1], kind=_kind(known, held[1], r[self.value]))
            held, known = (r["bucket"], r["last"]), True
        self.last.update((pickle.dumps(held),))

    def close(self) -> None:
        pass


def _write_batch(rows: DataFrame, batch: int, keys: list[str], order: list[str], value: str, path: str) -> None:
    """Changes inside one micro-batch of final rows; the first row of a key is an edge and tells the key's last value."""
    told = change_history(rows, keys, order, value)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    same = reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys])
    edges = told.filter("kind = 'first'").alias("e").join(last.alias("l"), same).select("e.*", F.col(f"_last.{value}").alias("last"), F.lit(batch).cast("long").alias("bucket"))
    told.filter("kind <> 'first'").write.mode("overwrite").parquet(f"{path}/inner/{batch}")
    edges.write.mode("overwrite").parquet(f"{path}/first/{batch}")


def _run(rows: DataFrame, path: str) -> None:
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def stream_changes(
    observations: DataFrame, keys: list[str], order: list[str], value: str, path: str, at: str, delay: str = "1 day", bucket: str = "1 day"
) -> None:
    """Every observation of the stream with the value before it, as far as the watermark has come.

    ``at`` is the time column, the first of ``order``. ``bucket`` once bounded the rows of one key that a task sorts; ranges
    do so now, and it has no effect. Continues where an earlier call on the same ``path`` ended.
    """
    spark = observations.sparkSession
    before = {c: spark.conf.get(c) for c in (PROVIDER, MULTIPLE)}
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        columns, kind = observations.columns, observations.schema[value].dataType
        changes = T.StructType([*observations.schema.fields, T.StructField("before", kind), T.StructField("kind", T.StringType())])
        told = T.StructType([*changes.fields, T.StructField("last", kind), T.StructField("bucket", T.LongType())])
        # With one stateful operator the engine drops late rows by the watermark of the batch itself, not of the one before.
        spark.conf.set(MULTIPLE, "false")
        timed = observations.withColumn("_at", F.col(at).cast("timestamp")).filter("_at is not null").withWatermark("_at", delay)
        final = timed.groupBy(*keys, "_at").agg(F.collect_list(F.struct(*columns)).alias("_rows"))
        _run(final, f"{path}/final")
        spark.conf.set(MULTIPLE, before[MULTIPLE])

        def handle(batch: DataFrame, batch_id: int) -> None:
            with released(batch.sparkSession):
                _write_batch(durable(batch.select(F.inline("_rows"))), batch_id, keys, order, value, path)

        writer = spark.readStream.schema(final.schema).parquet(f"{path}/final/rows").writeStream.foreachBatch(handle)
        writer.option("checkpointLocation", f"{path}/inner-checkpoint").trigger(availableNow=True).start().awaitTermination()
        edges = spark.readStream.schema(told).parquet(f"{path}/first/*")
        firsts = edges.groupBy(*keys).transformWithState(Edges(columns, value), changes, "append", "none")
        _run(firsts, f"{path}/edges")
    finally:
        for name, held in before.items():
            spark.conf.set(name, held)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/inner/*").unionByName(spark.read.parquet(f"{path}/edges/rows"))
