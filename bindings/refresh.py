"""Refresh and recovery bound to events, orders and conversations."""

from pyspark.sql import functions as F

from vouchlake.plans import intervals, recover, refresh as R
from vouchlake.session import durable, scratch

from .common import key_sql, org_key, query, table
from .derive import OBS_SQL, STATEMENTS_SQL, observations, statements

SPLIT_SQL = f"""{OBS_SQL},
older AS (SELECT user_id, event_type, arg_max(v, (ts, event_id)) AS v, arg_max(event_id, (ts, event_id)) AS ev, any_value(src) AS src FROM obs WHERE day <= '2024-01-26' GROUP BY 1, 2),
prior AS (SELECT user_id, event_type, arg_max(v, (ts, event_id)) AS v, arg_max(event_id, (ts, event_id)) AS ev, any_value(src) AS src FROM obs WHERE day BETWEEN '2024-01-27' AND '2024-01-29' GROUP BY 1, 2),
cur AS (SELECT user_id, event_type, arg_max(v, (ts, event_id)) AS v, arg_max(event_id, (ts, event_id)) AS ev, any_value(src) AS src FROM obs WHERE day >= '2024-01-30' GROUP BY 1, 2),
ent AS (SELECT user_id, user_id % 7 = 0 AS failed FROM (SELECT DISTINCT user_id FROM prior)),
chk AS (SELECT DISTINCT user_id, src FROM cur),
chg AS (SELECT coalesce(p.user_id, c.user_id) AS user_id, coalesce(p.event_type, c.event_type) AS event_type, p.v AS b, c.v AS a, p.ev AS pev,
    CASE WHEN p.v IS NULL THEN 'added' WHEN c.v IS NULL THEN 'no_longer_reported' ELSE 'changed' END AS kind
  FROM prior p FULL JOIN cur c ON p.user_id = c.user_id AND p.event_type = c.event_type
  WHERE coalesce(p.user_id, c.user_id) IN (SELECT user_id FROM ent WHERE NOT failed) AND p.v IS DISTINCT FROM c.v
    AND (c.v IS NOT NULL OR EXISTS (SELECT 1 FROM chk WHERE chk.user_id = p.user_id AND chk.src = p.src)))"""


def split(spark, d):
    obs = observations(spark, d)
    at = F.struct("ts", "event_id")

    def window(lo, hi):
        g = obs.filter(F.col("day").between(lo, hi)).groupBy("user_id", "event_type", "src").agg(F.max_by("v", at).alias("v"), F.max_by("event_id", at).alias("ev"))
        return g.select(
            F.col("user_id").cast("string").alias("organisation_number"), F.col("event_type").alias("field"), F.col("event_type").alias("subject"),
            F.col("v").cast("string").alias("value_json"), F.col("ev").cast("string").alias("evidence_id"), F.col("src").alias("source_class"), F.lit("u").alias("source_url"),
        )

    older, prior, current = window("0000-01-01", "2024-01-26"), window("2024-01-27", "2024-01-29"), window("2024-01-30", "9999-12-31")
    entities = prior.select("organisation_number").distinct().select(
        "organisation_number", F.when(F.col("organisation_number").cast("int") % 7 == 0, "failed").otherwise("available").alias("state"), F.lit("2024-01-29").alias("previous_success_at")
    )
    return older, prior, current, entities


def changes(spark, d):
    _, prior, current, entities = split(spark, d)
    return R.detect_changes(prior, current, entities.filter("state = 'available'"), current)


@query("c1_detect_changes", f"WITH {SPLIT_SQL} SELECT user_id::VARCHAR AS organisation_number, event_type AS subject, kind, b::VARCHAR AS before_json, a::VARCHAR AS after_json FROM chg")
def _c1(spark, d):
    return changes(spark, d).select("organisation_number", "subject", "kind", "before_json", "after_json")


@query(
    "c2_upgrade_subjects",
    f"""WITH {STATEMENTS_SQL}, a AS (SELECT *, {key_sql('o_custkey')} AS org FROM st) SELECT org AS organisation_number,
      'financials:' || report_type || ':' || strftime(period_end, '%Y-%m-%d') || ':revenue' AS subject, CASE WHEN o_custkey % 6 = 5 THEN 'no_longer_reported' WHEN y % 5 = 0 THEN 'added' ELSE 'changed' END AS kind
    FROM a WHERE org IS NOT NULL AND ((o_custkey % 6 = 5 AND y % 5 <> 0) OR (o_custkey % 6 <> 5 AND (y % 5 = 0 OR o_custkey % 4 = 0)))""",
)
def _c2(spark, d):
    st = statements(spark, d).withColumn("organisation_number", org_key(F.col("o_custkey"))).filter("organisation_number is not null")
    end, start, k, y = F.date_format("period_end", "yyyy-MM-dd"), F.date_format("period_start", "yyyy-MM-dd"), F.col("o_custkey"), F.col("y")
    rest = lambda amount, extra: F.concat(
        F.lit('{"'), F.lit(amount[0]), F.lit('":'), amount[1].cast("string"), F.lit(f',"currency":"NOK"{extra},"organisation_number":"'), F.col("organisation_number"), F.lit('","period_end":"'), end,
        F.lit('","period_start":"'), start, F.lit('","report_type":"'), F.col("report_type"), F.lit('"}'),
    )
    common = [F.lit("financials").alias("field"), F.lit("e").alias("evidence_id"), F.lit("official_accounts").alias("source_class"), F.lit("u").alias("source_url")]
    old = st.filter(y % 5 != 0).select("organisation_number", F.concat_ws(":", F.lit("financials"), "report_type", end).alias("subject"), rest(("revenue", F.col("cents")), "").alias("value_json"), *common)
    amount = F.when(k % 4 == 0, F.col("cents") + 1).otherwise(F.col("cents"))
    new = st.filter(k % 6 != 5).select("organisation_number", F.concat_ws(":", F.lit("financials"), "report_type", end, F.lit("revenue")).alias("subject"), rest(("amount", amount), ',"metric":"revenue"').alias("value_json"), *common)
    checked = st.select("organisation_number", F.lit("official_accounts").alias("source_class"), F.lit("u").alias("source_url"))
    return R.detect_changes(old, new, st, checked).select("organisation_number", "subject", "kind")


@query("c3_evidence_history", f"WITH {SPLIT_SQL} SELECT DISTINCT user_id::VARCHAR AS organisation_number, pev::VARCHAR AS id FROM chg WHERE b IS NOT NULL")
def _c3(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("organisation_number"), F.col("event_id").cast("string").alias("id"))
    return R.evidence_history(changes(spark, d), e)


LAST_SQL = f"""WITH {SPLIT_SQL}, h AS (SELECT 0 AS stage, * FROM older UNION ALL SELECT 1, * FROM prior),
g AS (SELECT h.*, ent.failed FROM h JOIN ent USING (user_id)),
k AS (SELECT * FROM g WHERE NOT failed AND event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM cur WHERE cur.user_id = g.user_id AND cur.event_type = g.event_type)
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY stage DESC) = 1)"""


def kept(spark, d):
    older, prior, current, entities = split(spark, d)
    return R.last_known(prior, older, current, entities, ("click", "view", "purchase", "signup", "logout", "login", "search"))


@query("c4_last_known_partial", f"{LAST_SQL} SELECT user_id::VARCHAR AS organisation_number, event_type AS subject, v::VARCHAR AS value_json, stage FROM k WHERE event_type IN ('click','view','purchase','signup','logout','login','search')")
def _c4(spark, d):
    return kept(spark, d).filter("state = 'available'").select("organisation_number", "subject", "value_json", "stage")


@query("c5_last_known_failed", f"{LAST_SQL} SELECT user_id::VARCHAR AS organisation_number, event_type AS subject, v::VARCHAR AS value_json, stage, '2024-01-29' AS as_of FROM g WHERE failed")
def _c5(spark, d):
    return kept(spark, d).filter("state <> 'available'").select("organisation_number", "subject", "value_json", "stage", "as_of")


def journal(spark, d):
    c = table(spark, d, "conversations")
    inputs = c.select(F.col("conv_id").alias("input_index")).distinct().withColumn("organisation_number", F.concat(F.lit("n"), F.col("input_index").cast("string")))
    rows = c.select(
        F.col("conv_id").alias("input_index"), F.concat(F.lit("n"), F.col("conv_id").cast("string")).alias("organisation_number"), "turn",
        F.when(F.col("role") == "user", "blocked").when(F.col("role") == "system", "failed").otherwise("available").alias("state"), F.lit("bulk").alias("source_mode"),
        F.when(F.col("turn") % 2 == 0, "r0").otherwise("r1").alias("run_id"),
        F.concat(F.lit("2024-01-0"), (F.col("turn") % 9 + 1).cast("string"), F.lit("T00:00:00+00:00")).alias("started_at"),
    )
    return inputs, rows


@query("c6_resume_plan", "SELECT conv_id AS input_index, 'n' || conv_id AS organisation_number, arg_max(role, turn) <> 'assistant' AS pending FROM conversations GROUP BY conv_id")
def _c6(spark, d):
    inputs, rows = journal(spark, d)
    recover.check_manifest({"mode": "bulk", "input_count": 1}, {"mode": "bulk"})
    return recover.resume_plan(inputs, rows, ["turn"], "bulk")


@query(
    "c7_finalize",
    """WITH o AS (SELECT conv_id, arg_max(role, turn) AS role FROM conversations WHERE turn % 2 = 1 AND turn % 9 + 1 >= 3 GROUP BY conv_id), i AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT i.conv_id AS input_index, CASE WHEN role IS NULL OR role = 'system' THEN 'failed' WHEN role = 'user' THEN 'blocked' ELSE 'available' END AS state,
      CASE WHEN role IS NULL THEN 'supervisor_time_budget_exhausted' END AS error, CASE WHEN role IS NULL OR role = 'system' THEN 'failed' ELSE 'completed' END AS terminal_status FROM i LEFT JOIN o USING (conv_id)""",
)
def _c7(spark, d):
    inputs, rows = journal(spark, d)
    return recover.finalize(inputs, rows, ["turn"], "bulk", "r1", "2024-01-03T00:00:00+00:00", True).drop("organisation_number")


AS_OF = ("2024-01-05", "2024-01-12", "2024-01-20")


@query(
    "k2_views_as_of",
    f"""WITH {OBS_SQL}, r AS (SELECT unnest([{", ".join(f"'{t}'" for t in AS_OF)}]) AS seen_at)
    SELECT seen_at, user_id, event_type, arg_max(v, (ts, event_id)) AS v FROM obs JOIN r ON day <= seen_at WHERE NOT (seen_at = '{AS_OF[1]}' AND user_id % 3 = 0 AND day > '{AS_OF[0]}') GROUP BY 1, 2, 3""",
)
def _k2v(spark, d):
    """Three runs merged into intervals, each read back as of its time; in the second every third entity failed and keeps what it had."""
    obs, path = durable(observations(spark, d)), scratch(spark, "intervals")
    at = [None, *AS_OF]
    for before, now in zip(at, at[1:]):
        failed = (F.col("user_id") % 3 == 0) & (F.col("day") > AS_OF[0]) if now == AS_OF[1] else F.lit(False)
        seen = obs.filter((F.col("day") <= now) & ~failed)
        view = seen.groupBy("user_id", "event_type").agg(F.max_by("v", F.struct("ts", "event_id")).alias("v"))
        intervals.merge_run(spark, view, path, now, before)
    out = None
    for now in AS_OF:
        rows = intervals.as_of(spark, path, now, AS_OF[-1]).select(F.lit(now).alias("seen_at"), "user_id", "event_type", "v")
        out = rows if out is None else out.unionByName(rows)
    return out
