"""Set operations bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.operators import sets as U

from .aggregates import STATE_SQL, event_states
from .common import query, table
from .joins import PERIODS_SQL, two_periods

KEYS = ["user_id", "event_type"]


@query("u1_union_claims", "SELECT c_name AS value, c_nationkey AS nation, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def _u1(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return U.union_claims(c, table(spark, d, "supplier").select(F.col("s_name").alias("value"), F.col("s_nationkey").alias("nation")))


@query(
    "u2_union_evidence",
    f"WITH {PERIODS_SQL} SELECT user_id, event_type, v, 'current' AS part FROM cur UNION ALL SELECT user_id, event_type, v, 'history' FROM prior",
)
def _u2(spark, d):
    prior, current = two_periods(spark, d)
    return U.union_evidence(current.withColumn("part", F.lit("current")), prior.withColumn("part", F.lit("history")))


@query("u3_dangling_refs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _u3(spark, d):
    ev = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return U.dangling_refs(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ev, ["l_orderkey"])


@query("u4_subject_keys", f"WITH {PERIODS_SQL} SELECT user_id, event_type FROM prior UNION SELECT user_id, event_type FROM cur")
def _u4(spark, d):
    return U.subject_keys(*two_periods(spark, d), KEYS)


@query("u5_stale", f"WITH {PERIODS_SQL} SELECT user_id, event_type, v FROM prior p WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.user_id = p.user_id AND c.event_type = p.event_type)")
def _u5(spark, d):
    return U.stale(*two_periods(spark, d), KEYS)


@query(
    "u6_fill_gaps",
    f"""WITH a AS (SELECT user_id, event_type AS field, arg_max({STATE_SQL}, event_id) AS state FROM events GROUP BY 1, 2), c AS (SELECT DISTINCT user_id, event_type AS field FROM events WHERE value > 90)
    SELECT user_id, field, NULL::VARCHAR AS value_json, state AS availability, 0.0::DOUBLE AS confidence, '' AS reason FROM a WHERE state <> 'available' AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = a.user_id AND c.field = a.field)""",
)
def _u6(spark, d):
    e = event_states(spark, d)
    a = e.groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("state", "event_id").alias("state")).withColumn("reason", F.lit(None).cast("string"))
    return U.fill_gaps(e.filter("value > 90").select("user_id", F.col("event_type").alias("field")), a, "user_id")
