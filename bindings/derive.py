"""Further landing tables derived from the given ones, with the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import org_key, table

# events as observations: one subject per (user, type), value in steps of 25
OBS_SQL = """obs AS (SELECT event_id, user_id, event_type, ts, CAST(floor(value / 25) AS BIGINT) AS v,
  CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'app' END AS src, strftime(ts, '%Y-%m-%d') AS day FROM events)"""


def observations(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", "event_type", "ts", F.floor(F.col("value") / 25).cast("bigint").alias("v"),
        F.when(F.col("event_type").isin("click", "view"), "web").otherwise("app").alias("src"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


def request_log(spark, d):
    """events as an outbound request log: input = user, host = user's block, 429 = error."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.col("user_id").alias("input_index"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), (F.col("event_type") == "error").alias("limited"), "event_type",
    )


LOG_SQL = """log AS (SELECT event_id, user_id AS input_index, 'h' || (user_id % 20)::VARCHAR AS host, epoch_us(ts) AS at_us,
  event_type = 'error' AS limited, event_type FROM events)"""


def statements(spark, d):
    """orders as yearly statements: one per customer, status and calendar year, in cents."""
    o = table(spark, d, "orders")
    y = F.year("o_orderdate")
    rows = o.groupBy("o_custkey", F.col("o_orderstatus").alias("report_type"), y.alias("y")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")
    )
    return rows.select(
        "o_custkey", "report_type", "y", "cents",
        F.make_date("y", F.lit(1), F.lit(1)).alias("period_start"),
        F.make_date("y", F.lit(12), F.lit(31) - F.col("o_custkey") % 10).alias("period_end"),
    )


STATEMENTS_SQL = """st AS (SELECT o_custkey, o_orderstatus AS report_type, year(o_orderdate) AS y,
    sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents,
    make_date(year(o_orderdate), 1, 1) AS period_start, make_date(year(o_orderdate), 12, (31 - o_custkey % 10)::BIGINT) AS period_end
  FROM orders GROUP BY 1, 2, 3)"""
