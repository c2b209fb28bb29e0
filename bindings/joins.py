"""Joins bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.operators import joins as J

from .common import query, table
from .derive import LOG_SQL, OBS_SQL, STATEMENTS_SQL, observations, request_log, statements


@query(
    "j2_keep_wanted",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
)
def _j2(spark, d):
    wanted = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return J.keep_wanted(table(spark, d, "orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


@query("j3_pending", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _j3(spark, d):
    return J.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query(
    "j4_attach_evidence",
    """SELECT l_orderkey, l_linenumber, o_orderstatus, o_custkey IS NULL AS dangling FROM lineitem
       LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW') ON l_orderkey = o_orderkey""",
)
def _j4(spark, d):
    claims = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    ev = table(spark, d, "orders").filter(F.col("o_orderpriority") != "5-LOW")
    ev = ev.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return J.attach_evidence(claims, ev, "l_orderkey")


PERIODS_SQL = f"""{OBS_SQL},
prior AS (SELECT user_id, event_type, arg_max(v, (ts, event_id)) AS v FROM obs WHERE day <= '2024-01-29' GROUP BY 1, 2),
cur AS (SELECT user_id, event_type, arg_max(v, (ts, event_id)) AS v FROM obs WHERE day >= '2024-01-30' GROUP BY 1, 2)"""


def two_periods(spark, d):
    obs = observations(spark, d)
    last = F.max_by("v", F.struct("ts", "event_id")).alias("v")
    prior = obs.filter(F.col("day") <= "2024-01-29").groupBy("user_id", "event_type").agg(last)
    current = obs.filter(F.col("day") >= "2024-01-30").groupBy("user_id", "event_type").agg(last)
    return prior, current


@query(
    "j5_pair_subjects",
    f"""WITH {PERIODS_SQL} SELECT coalesce(p.user_id, c.user_id) AS user_id, coalesce(p.event_type, c.event_type) AS event_type,
      p.v AS before, c.v AS after, p.user_id IS NOT NULL AS had, c.user_id IS NOT NULL AS has
    FROM prior p FULL JOIN cur c ON p.user_id = c.user_id AND p.event_type = c.event_type""",
)
def _j5(spark, d):
    prior, current = two_periods(spark, d)
    return J.pair_subjects(prior, current, ["user_id", "event_type"], "v")


@query(
    "j6_resolve_refs",
    """WITH org AS (SELECT s_nationkey AS page, '#o' || (s_suppkey % 7)::VARCHAR AS id, max(s_suppkey) AS target FROM supplier GROUP BY 1, 2)
    SELECT c_custkey AS node, c_nationkey AS page, '#o' || (c_custkey % 7)::VARCHAR AS publisher, target
    FROM customer LEFT JOIN org ON page = c_nationkey AND id = '#o' || (c_custkey % 7)::VARCHAR""",
)
def _j6(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    tag = lambda k: F.concat(F.lit("#o"), (F.col(k) % 7).cast("string"))
    none = F.lit(None).cast("string")
    nodes = c.select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("page"), none.alias("id"), tag("c_custkey").alias("publisher"))
    nodes = nodes.unionByName(s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("page"), tag("s_suppkey").alias("id"), none.alias("publisher")))
    return J.resolve_refs(nodes, "page", "id", "publisher", "node").drop("id")


@query(
    "j7_comparable_periods",
    f"""WITH {STATEMENTS_SQL}, j AS (SELECT a.o_custkey, a.report_type, a.y::BIGINT AS y, a.cents, b.cents AS prior_cents, b.y::BIGINT AS prior_y
      FROM st a JOIN st b USING (o_custkey, report_type) WHERE year(a.period_end) - year(b.period_end) = 1
        AND abs(date_diff('day', a.period_start, a.period_end) - date_diff('day', b.period_start, b.period_end)) <= 7
        AND abs(date_diff('day', b.period_end + INTERVAL 12 MONTH, a.period_end::TIMESTAMP)) <= 7)
    SELECT * FROM j""",
)
def _j7(spark, d):
    st = statements(spark, d)
    out = J.comparable_periods(st, ["o_custkey", "report_type"], "period_start", "period_end")
    return out.select("o_custkey", "report_type", F.col("y").cast("bigint").alias("y"), "cents", "prior_cents", F.col("prior_y").cast("bigint").alias("prior_y"))


@query(
    "j8_prior_success",
    f"""WITH {OBS_SQL} SELECT event_id, last_value(CASE WHEN event_type <> 'error' THEN v END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM obs""",
)
def _j8(spark, d):
    obs = observations(spark, d).select("event_id", "user_id", "ts", "event_type", "v")
    out = J.prior_success(obs, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", F.col("v"))
    return out.select("event_id", "prior")


@query(
    "j9_in_cooldown",
    f"""WITH {LOG_SQL}, u AS (SELECT event_id, at_us, max(CASE WHEN limited THEN at_us + 3600000000 END)
      OVER (PARTITION BY host ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM log)
    SELECT event_id, coalesce(at_us < until, false) AS cooling FROM u""",
)
def _j9(spark, d):
    out = J.in_cooldown(request_log(spark, d), "host", ["at_us", "event_id"], "at_us", F.col("limited"), F.lit(3600000000))
    return out.select("event_id", "cooling")


@query(
    "j10_match_positions",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.n_chars % 2 AS expected, l.quality::BIGINT AS actual,
      coalesce(d.n_chars % 2 = l.quality, false) AS matches FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def _j10(spark, d):
    expected = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("v"))
    actual = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("v"))
    return J.match_positions(expected, actual, "doc_id", "v")


@query(
    "j11_match_prefix",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT host, regexp_extract(path, '^(/[^/]*)', 1) AS rule, min(page_id) AS line, min(page_id) % 2 = 0 AS allow FROM p GROUP BY 1, 2
      UNION ALL SELECT host, '/', max(page_id) + 100000, false FROM p GROUP BY host)
    SELECT page_id, arg_min(rule, line) AS rule, arg_min(allow, line) AS allow FROM p JOIN r ON p.host = r.host AND starts_with(p.path, r.rule)
    WHERE rule <> '' GROUP BY page_id""",
)
def _j11(spark, d):
    p = table(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path")
    )
    r = p.groupBy("host", F.regexp_extract("path", r"^(/[^/]*)", 1).alias("rule")).agg(F.min("page_id").alias("line"))
    r = r.withColumn("allow", F.col("line") % 2 == 0).filter("rule <> ''")
    r = r.unionByName(p.groupBy("host").agg(F.lit("/").alias("rule"), (F.max("page_id") + 100000).alias("line"), F.lit(False).alias("allow")))
    return J.match_prefix(p, r, "host", "path", "rule", "line").select("page_id", "rule", "allow")


@query(
    "j12_first_alias",
    """SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY lang, sha256(text)) THEN 'duplicate_snapshot_source_skipped' END AS note FROM documents""",
)
def _j12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    return J.first_alias(docs, ["lang", "hash"], ["doc_id"]).select("doc_id", "note")


@query(
    "j13_compare_profiles",
    """WITH c AS (SELECT c_mktsegment AS field, c_name AS value, c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name, c_custkey) - 1 AS ordinal FROM customer),
    l AS (SELECT * FROM c WHERE k = 3), r AS (SELECT * FROM c WHERE k = 7)
    SELECT coalesce(l.field, r.field) AS field, coalesce(l.ordinal, r.ordinal) AS ordinal, l.value AS left_value, r.value AS right_value
    FROM l FULL JOIN r ON l.field = r.field AND l.ordinal = r.ordinal""",
)
def _j13(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("field"), F.col("c_name").alias("value"), "c_custkey")
    return J.compare_profiles(c, "k", 3, 7, "field", "value", "c_custkey")


@query("j14_attach_sources", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _j14(spark, d):
    manifest = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.attach_sources(table(spark, d, "customer").select("c_custkey"), manifest, "c_custkey")
