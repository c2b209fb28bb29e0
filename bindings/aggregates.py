"""Aggregations bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.functions import fixed
from vouchlake.operators import rollups as A

from .common import query, sql_list, table
from .derive import OBS_SQL, observations

# event types as availability states
STATE_SQL = "CASE event_type WHEN 'click' THEN 'available' WHEN 'view' THEN 'not_available' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'ambiguous' ELSE 'failed' END"


def event_states(spark, d):
    kind = F.col("event_type")
    state = (
        F.when(kind == "click", "available").when(kind == "view", "not_available").when(kind == "error", "blocked")
        .when(kind == "purchase", "ambiguous").otherwise("failed")
    )
    return table(spark, d, "events").withColumn("state", state)


@query(
    "a1_state_counts",
    f"""SELECT s.state, count(e.event_id) AS n FROM (VALUES ('ambiguous'),('available'),('blocked'),('failed'),('not_applicable'),('not_available')) s(state)
      LEFT JOIN (SELECT event_id, {STATE_SQL} AS state FROM events) e USING (state) GROUP BY s.state""",
)
def _a1(spark, d):
    return A.state_counts(event_states(spark, d))


@query(
    "a2_run_totals",
    """SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS claims, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS requests,
      round(sum(CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END) * 0.005, 6) AS cost FROM lineitem""",
)
def _a2(spark, d):
    l = table(spark, d, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("claims"), F.col("l_quantity").cast("bigint").alias("requests"),
        (F.col("l_returnflag") == "R").alias("resumed"), (F.col("l_linenumber") * 5).cast("bigint").alias("mills"),
    )
    out = A.run_totals(l, ["claims"], ["requests", "mills"], "resumed")
    return out.select("rows", "claims", "requests", F.round(F.col("mills") * F.lit(0.001), 6).alias("cost"))


@query(
    "a3_nearest_rank",
    "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL",
)
def _a3(spark, d):
    return A.nearest_rank(table(spark, d, "events").select("value"), "value", {"p50": 0.5, "p95": 0.95})


@query(
    "a4_merge_evidence",
    """SELECT user_id, min(ts)::VARCHAR AS retrieved_at, max(ts)::VARCHAR AS last_retrieved_at, count(DISTINCT ts) AS n_retrievals,
      count(DISTINCT event_type) > 1 AS identity_conflict FROM events GROUP BY user_id""",
)
def _a4(spark, d):
    e = table(spark, d, "events")
    out = A.merge_evidence(e, "user_id", ["event_type"], "ts")
    return out.withColumns({c: F.col(c).cast("string") for c in ("retrieved_at", "last_retrieved_at")})


@query("a4_retrieval_times", "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H') AS hour FROM events")
def _a4b(spark, d):
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    return A.retrieval_times(e, "user_id", "hour")


@query(
    "a5_claim_spans",
    """WITH f AS (SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY 1, 2)
    SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS claim_span FROM f GROUP BY 1""",
)
def _a5(spark, d):
    return A.claim_spans(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("a6_profile_metrics", "SELECT l_suppkey, count(*) AS facts, count(DISTINCT l_orderkey) AS evidence_records FROM lineitem GROUP BY 1")
def _a6(spark, d):
    return A.profile_metrics(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@query(
    "a7_rollup_state",
    f"""WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS hour, {STATE_SQL} AS state FROM events),
    r AS (SELECT *, list_position([{sql_list(fixed.STATE_PRIORITY)}], state) AS p FROM e)
    SELECT user_id, hour, arg_min(state, p) AS state FROM r GROUP BY 1, 2""",
)
def _a7(spark, d):
    e = event_states(spark, d).select(F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd HH")).alias("k"), "state")
    out = A.rollup_state(e, "k")
    return out.select(F.split("k", r"\|")[0].cast("bigint").alias("user_id"), F.split("k", r"\|")[1].alias("hour"), "state")


@query(
    "a8_single_label",
    """SELECT conv_id, 'user' AS expected, count(role) AS n_labels, min(role) = 'user' AND max(role) = 'user' AS single
      FROM conversations GROUP BY conv_id""",
)
def _a8(spark, d):
    c = table(spark, d, "conversations").withColumn("expected", F.lit("user"))
    return A.single_label(c, "conv_id", "role", "expected")


@query(
    "a9_drop_conflicts",
    """WITH k AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) = 1)
    SELECT o_custkey, y::BIGINT AS y, min(o_orderkey) AS o_orderkey, min(o_orderpriority) AS o_orderpriority
    FROM orders JOIN k USING (o_custkey) WHERE year(o_orderdate) = y GROUP BY 1, 2""",
)
def _a9(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("bigint").alias("y"), "o_orderkey", "o_orderpriority")
    return A.drop_conflicts(o, ["o_custkey", "y"], "o_orderpriority", ["o_orderkey"])


@query("a10_distinct_first", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY 2")
def _a10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return A.distinct_first(docs, ["hash"], [F.col("doc_id")])


@query(
    "a11_rollup_availability",
    f"""SELECT user_id, event_type AS field, arg_max({STATE_SQL}, (ts, event_id)) AS state, arg_max(props, (ts, event_id)) AS reason FROM events GROUP BY 1, 2""",
)
def _a11(spark, d):
    e = event_states(spark, d).select("user_id", F.col("event_type").alias("field"), "state", F.col("props").alias("reason"), "ts", "event_id")
    return A.rollup_availability(e, ["user_id", "field"], ["ts", "event_id"])


@query("a12_query_cost", "SELECT l_suppkey, round(count(*) * 0.005, 6) AS cost FROM lineitem GROUP BY 1")
def _a12(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(A.query_cost(F.count("*")).alias("cost"))


@query("a13_request_counts", "SELECT user_id, count(*) AS requests FROM events GROUP BY ROLLUP(user_id)")
def _a13(spark, d):
    return A.request_counts(table(spark, d, "events").select("user_id"), "user_id")


@query(
    "a14_audit_totals",
    """SELECT count(*) AS claims_checked, count(DISTINCT l_orderkey) AS results_checked, count(*) FILTER (l_quantity > 49) AS violations,
      bool_and(l_quantity <= 49) AS passed FROM lineitem""",
)
def _a14(spark, d):
    return A.audit_totals(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 49)
