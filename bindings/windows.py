"""Ordered work bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.operators import finance, windows as W

from .common import query, table
from .derive import LOG_SQL, OBS_SQL, STATEMENTS_SQL, observations, request_log, statements


@query("w1_keep_first", "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1")
def _w1(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), "page_id")
    return W.keep_first(p, ["host"], [F.col("page_id")])


@query(
    "w2_cap",
    """SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""",
)
def _w2(spark, d):
    l = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.cap(l, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


FAMILY = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'news' WHEN '2' THEN 'jobs' ELSE o_orderpriority END"


@query(
    "w3_interleave",
    f"""WITH f AS (SELECT o_custkey, o_orderkey, {FAMILY} AS family FROM orders),
    r AS (SELECT *, CASE WHEN family IN ('news','jobs') THEN family ELSE '' END AS g FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, g ORDER BY o_orderkey) AS rn FROM r QUALIFY rn <= 30)
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE g WHEN '' THEN 1 ELSE 0 END, rn, CASE g WHEN 'news' THEN 1 ELSE 2 END) AS position FROM n""",
)
def _w3(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr(FAMILY).alias("family"))
    out = W.interleave(o, ["o_custkey"], "family", [F.col("o_orderkey")], ["news", "jobs"], 30)
    return out.select("o_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


@query(
    "w4_latest_per",
    "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1",
)
def _w4(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return W.latest_per(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "w5_year_over_year",
    f"""WITH {STATEMENTS_SQL}, j AS (SELECT a.o_custkey, a.report_type, a.y::BIGINT AS y, a.cents, b.cents AS prior FROM st a JOIN st b USING (o_custkey, report_type)
      WHERE a.y - b.y = 1)
    SELECT o_custkey, report_type, y, round((cents - prior) * 100.0::DOUBLE / abs(prior), 1) AS pct,
      CASE WHEN cents > prior THEN 'up' WHEN cents < prior THEN 'down' ELSE 'unchanged' END AS direction FROM j WHERE prior <> 0""",
)
def _w5(spark, d):
    from vouchlake.operators.joins import comparable_periods

    pairs = comparable_periods(statements(spark, d), ["o_custkey", "report_type"], "period_start", "period_end")
    out = finance.year_over_year(pairs, "cents", "prior_cents").filter(F.col("direction").isNotNull())
    return out.select("o_custkey", "report_type", F.col("y").cast("bigint").alias("y"), F.round("pct", 1).alias("pct"), "direction")


@query(
    "w6_last_wins",
    """SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'assistant'""",
)
def _w6(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "available").otherwise("failed").alias("state"))
    return W.last_wins(c, "conv_id", ["turn"]).select("conv_id", "turn")


@query(
    "w7_change_history",
    f"""WITH {OBS_SQL}, p AS (SELECT event_id, v, lag(v) OVER w AS before, row_number() OVER w AS rn FROM obs WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT event_id, v, before, CASE WHEN rn = 1 THEN 'first' WHEN before IS NOT DISTINCT FROM v THEN 'same' ELSE 'changed' END AS kind FROM p""",
)
def _w7(spark, d):
    obs = observations(spark, d).select("event_id", "user_id", "event_type", "ts", "v")
    return W.change_history(obs, ["user_id", "event_type"], ["ts", "event_id"], "v").select("event_id", "v", "before", "kind")


@query(
    "w8_admit_requests",
    f"""WITH {LOG_SQL}, t AS (SELECT *, at_us < epoch_us(TIMESTAMP '2024-01-20 00:00:00') AS in_time FROM log),
    lim AS (SELECT count(*) // 8 AS n FROM log),
    r AS (SELECT *, CASE WHEN in_time THEN row_number() OVER (PARTITION BY input_index ORDER BY at_us, event_id) END AS rn FROM t),
    c AS (SELECT *, CASE WHEN rn <= 20 THEN sum(CASE WHEN rn <= 20 THEN 1 ELSE 0 END) OVER (ORDER BY at_us, event_id) END AS place FROM r),
    a AS (SELECT *, coalesce(place <= (SELECT n FROM lim), false) AS admitted FROM c),
    u AS (SELECT *, sum(CASE WHEN admitted THEN 1 ELSE 0 END) OVER (PARTITION BY input_index) AS used FROM a)
    SELECT event_id, admitted, CASE WHEN admitted THEN NULL WHEN NOT in_time THEN 'deadline_exhausted' WHEN used >= 20 THEN 'input_request_budget_exhausted'
      ELSE 'global_request_budget_exhausted' END AS reason FROM u""",
)
def _w8(spark, d):
    log = request_log(spark, d)
    limit = log.count() // 8
    deadline = F.unix_micros(F.lit("2024-01-20 00:00:00+00:00").cast("timestamp"))
    out = W.admit_requests(log, "event_id", "input_index", ["at_us", "event_id"], F.col("at_us") < deadline, limit, 20)
    return out.select("event_id", "admitted", "reason")


@query(
    "w9_pace",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), q AS (SELECT *, 1 + length(host) % 3 AS delay FROM p)
    SELECT page_id, host, (sum(delay) OVER (PARTITION BY host ORDER BY page_id) - delay)::BIGINT AS slot FROM q""",
)
def _w9(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    return W.pace(p, "host", ["page_id"], (1 + F.length("host") % 3).cast("bigint"))


@query(
    "w10_short_list",
    """WITH k AS (SELECT user_id, strftime(ts, '%d') AS day FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM k)
    SELECT user_id, string_agg(day, ', ' ORDER BY rn) || CASE WHEN max(n) > 4 THEN ' and ' || (max(n) - 4)::VARCHAR || ' more' ELSE '' END AS text FROM r WHERE rn <= 4 GROUP BY user_id""",
)
def _w10(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "dd").alias("day")).distinct()
    return W.short_list(e, ["user_id"], "day", [F.col("day")])


@query(
    "w11_ordered",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_custkey, o_orderkey) - 1 AS position FROM orders",
)
def _w11(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return W.numbered(o, ["o_orderdate", "o_custkey", "o_orderkey"], "position").select("o_orderkey", "position")


@query(
    "w12_first_verified",
    """WITH u AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
    b AS (SELECT *, min(CASE WHEN l_returnflag = 'A' THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS best FROM u)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = best THEN 'verified' WHEN best IS NULL OR l_linenumber < best THEN 'rejected' ELSE 'unverified' END AS status FROM b""",
)
def _w12(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", F.lit("unverified").alias("status"))
    l = W.keep_first(l.withColumn("ok", F.col("l_returnflag") == "A"), ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])
    return W.first_verified(l, "l_orderkey", "l_linenumber", "ok").select("l_orderkey", "l_linenumber", "status")
