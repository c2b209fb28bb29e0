"""Streams over events and conversations, run to the end of the given files."""

from pyspark.sql import functions as F

from vouchlake.session import scratch
from vouchlake.streaming import feeds as T, history

from .common import ORACLE, query, table
from .derive import OBS_SQL


#: Files of one micro-batch, written and read by as many tasks.
FILES = 4


def feed(spark, d, name, columns):
    """The table as files that land in three lots, in the order of the first column between lots.

    A file source reads files by their time, so three writes give three micro-batches; rows
    inside a lot are dealt to its files round robin and are in no order.
    """
    path = scratch(spark, f"feed-{name}")
    rows = table(spark, d, name).select(*columns)
    at = F.col(columns[0]).cast("timestamp").cast("double") if columns[0] == "ts" else F.col(columns[0]).cast("double")
    low, high = rows.agg(F.percentile_approx(at, [0.33, 0.66])).first()[0]
    for part in (at <= low, (at > low) & (at <= high), at > high):
        rows.filter(part).repartition(FILES).write.mode("append").parquet(path)
    return T.open_feed(spark, path, files_per_batch=FILES)


#: Lots of the T1 feed overlap by up to this many seconds of event time, half of the delay it is run with.
OVERLAP = 43_200


def overlapping_feed(spark, d):
    """Observations in four lots: each row lands up to half a day later than its time, in no order.

    A last row far behind all others closes the feed, so that the watermark passes every real one.
    """
    path = scratch(spark, "feed-changes")
    e = table(spark, d, "events")
    obs = e.select("event_id", "user_id", "event_type", "ts", F.floor(F.col("value") / 25).cast("bigint").alias("v"))
    landed = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(OVERLAP))
    low, middle, high = obs.agg(F.percentile_approx(landed, [0.25, 0.5, 0.75])).first()[0]
    for part in (landed <= low, (landed > low) & (landed <= middle), (landed > middle) & (landed <= high), landed > high):
        obs.filter(part).repartition(FILES).write.mode("append").parquet(path)
    end = obs.agg(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"),
                  (F.max("ts") + F.expr("interval 60 days")).alias("ts"), F.lit(0).cast("bigint").alias("v"))
    end.write.mode("append").parquet(path)
    return T.open_feed(spark, path, files_per_batch=FILES)


@query("t1_stream_changes", ORACLE["w7_change_history"])
def _t1(spark, d):
    path = scratch(spark, "changes")
    history.stream_changes(overlapping_feed(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "v", path, "ts", "1 day", "7 days")
    return history.read_changes(spark, path).filter("user_id >= 0").select("event_id", "v", "before", "kind")


@query("t2_stream_dedupe", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour FROM events")
def _t2(spark, d):
    e = feed(spark, d, "events", ["ts", "user_id", "event_type"])
    e = e.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    path = scratch(spark, "dedupe")
    T.stream_dedupe(e, ["user_id", "event_type", "hour"], "ts", "2 hours", path)
    return spark.read.parquet(f"{path}/rows").select("user_id", "event_type", "hour")


@query("t3_stream_latest", ORACLE["k2_latest_success"])
def _t3(spark, d):
    e = feed(spark, d, "events", ["ts", "event_id", "user_id", "event_type"])
    e = e.withColumn("state", F.when(F.col("event_type") == "error", "failed").otherwise("available"))
    path = scratch(spark, "latest")
    T.stream_latest(e, "user_id", ["ts", "event_id"], path)
    return T.read_latest(spark, path).select("user_id", "event_id")


RATES_SQL = """SELECT 'h' || (user_id % 20) AS host, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS requests,
  count(*) FILTER (event_type = 'error') AS limited, count(*) FILTER (event_type = 'error') > 0 AS cooling FROM events GROUP BY 1, 2"""


def _shape(df):
    return df.select("host", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "requests", "limited", "cooling")


def _log(e):
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), (F.col("event_type") == "error").alias("limited"))


@query("t4_request_rates", RATES_SQL)
def _t4(spark, d):
    return _shape(T.request_rates(_log(table(spark, d, "events")), "ts", "host", "1 hour"))


@query(
    "t4_stream_request_rates",
    f"""WITH r AS ({RATES_SQL}), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)
    SELECT r.* FROM r, m WHERE strptime(window_start, '%Y-%m-%d %H:%M') + INTERVAL 1 HOUR <= mark""",
)
def _t4s(spark, d):
    path = scratch(spark, "rates")
    T.stream_request_rates(_log(feed(spark, d, "events", ["ts", "user_id", "event_type"])), path, at="ts", host="host", width="1 hour", delay="2 hours")
    return _shape(spark.read.parquet(f"{path}/rates"))


@query(
    "t4_sliding_rates",
    """WITH s AS (SELECT 'h' || (user_id % 20) AS host, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w, event_type FROM events)
    SELECT host, strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS limited, count(*) FILTER (event_type = 'error') > 0 AS cooling FROM s GROUP BY 1, 2""",
)
def _t4w(spark, d):
    return _shape(T.request_rates(_log(table(spark, d, "events")), "ts", "host", "1 hour", "30 minutes"))


@query("t5_stream_progress", "SELECT role AS state, count(*) AS n FROM conversations GROUP BY 1")
def _t5(spark, d):
    c = feed(spark, d, "conversations", ["conv_id", "turn", "role"])
    path = scratch(spark, "progress")
    T.stream_progress(c.withColumnRenamed("role", "state"), path)
    return T.read_progress(spark, path)
