"""Keys, registry gate, unpivot and the minimum slice."""

from pyspark.sql import functions as F

from vouchlake.functions import keys
from vouchlake.operators import registry_facts as R
from vouchlake.operators import rollups

from .common import REGISTRY_FACTS_SQL, key_sql, org_key, query, registry_responses, table


@query(
    "p1_validate_keys",
    f"""WITH s AS (SELECT c_custkey, {key_sql('c_custkey')} AS good, (80000000 + c_custkey)::VARCHAR AS stem FROM customer),
    t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN coalesce(good, stem || '0') WHEN 1 THEN stem || '7'
          WHEN 2 THEN stem ELSE coalesce(good, stem || '0') || chr(10) END AS organisation_number, good FROM s)
    SELECT c_custkey, organisation_number, coalesce(good = organisation_number, false) AS key_valid,
      CASE WHEN NOT coalesce(good = organisation_number, false) THEN 'invalid_organisation_number' END AS reject_reason FROM t""",
)
def _p1(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    stem = (F.lit(80000000) + k).cast("string")
    good = F.coalesce(org_key(k), F.concat(stem, F.lit("0")))
    number = (
        F.when(k % 4 == 0, good).when(k % 4 == 1, F.concat(stem, F.lit("7"))).when(k % 4 == 2, stem).otherwise(F.concat(good, F.lit("\n")))
    )
    return keys.validate_keys(c.select("c_custkey", number.alias("organisation_number")))


@query(
    "p2_gate_registry",
    f"""WITH b AS (SELECT {key_sql('c_custkey')} AS organisation_number, c_custkey AS k, c_name FROM customer)
    SELECT organisation_number,
      CASE WHEN k % 97 = 0 THEN 'ambiguous' WHEN k % 89 = 0 THEN 'failed' ELSE 'available' END AS state,
      CASE WHEN k % 97 = 0 THEN 'registry_identity_mismatch' WHEN k % 89 = 0 THEN 'ValueError' END AS error,
      CASE WHEN k % 97 <> 0 AND k % 89 <> 0 THEN c_name END AS legal_name
    FROM b WHERE organisation_number IS NOT NULL""",
)
def _p2(spark, d):
    return R.gate_registry(registry_responses(spark, d)).select("organisation_number", "state", "error", "legal_name")


@query(
    "p3_presence_filter",
    f"""WITH {REGISTRY_FACTS_SQL} SELECT field, count(*) AS n,
      sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing,
      sum(CASE WHEN v IN ('0', 'false') THEN 1 ELSE 0 END)::BIGINT AS n_zero_or_false
    FROM facts WHERE field <> 'registered_employees' OR v IS NOT NULL GROUP BY field""",
)
def _p3(spark, d):
    facts = R.registry_facts(registry_responses(spark, d))
    facts = facts.filter(F.coalesce(F.col("reason") != "registry_does_not_confirm_employee_count", F.lit(True)))
    return facts.groupBy("field").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("reason") == "absent_in_registry_response").alias("n_missing"),
        F.count_if(F.col("value_json").isin("0", "false")).alias("n_zero_or_false"),
    )


@query(
    "p4_gate_confirmed",
    f"""WITH b AS (SELECT {key_sql('c_custkey')} AS organisation_number, c_custkey AS k FROM customer)
    SELECT organisation_number,
      CASE WHEN k % 97 = 0 THEN 'ambiguous' WHEN k % 89 = 0 OR (k % 3 <> 0 AND k % 113 = 0) THEN 'failed' ELSE 'available' END AS state,
      k % 3 <> 0 AS count_confirmed
    FROM b WHERE organisation_number IS NOT NULL""",
)
def _p4(spark, d):
    return R.gate_confirmed(R.gate_registry(registry_responses(spark, d))).select(
        "organisation_number", "state", "count_confirmed"
    )


@query(
    "x1_unpivot_claims",
    f"""WITH {REGISTRY_FACTS_SQL} SELECT org AS organisation_number, field, v AS value_json, '/' || key AS json_pointer,
      sha256(org || ':' || field || ':' || v) AS claim_id FROM facts WHERE v IS NOT NULL""",
)
def _x1(spark, d):
    return R.unpivot_claims(registry_responses(spark, d)).select(
        "organisation_number", "field", "value_json", "json_pointer", "claim_id"
    )


@query(
    "x2_registry_candidates",
    f"""WITH {REGISTRY_FACTS_SQL} SELECT org AS organisation_number, 'website' AS kind,
      'www.' || lower(replace(c_name, '#', '-')) || '.example.com' AS value, 'unverified' AS status
    FROM good WHERE k % 5 <> 0""",
)
def _x2(spark, d):
    return R.registry_candidates(registry_responses(spark, d)).select("organisation_number", "kind", "value", "status")


def slice_inputs(spark, d):
    """Orders as the input list: customer keys with duplicates, and some unknown or invalid keys."""
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    stem = (F.lit(80000000) + k).cast("string")
    number = (
        F.when(F.col("o_orderkey") % 50 == 0, org_key(k + 5000000))
        .otherwise(F.coalesce(org_key(k), F.concat(stem, F.lit("0"))))
    )
    return o.select(F.col("o_orderkey").alias("input_index"), F.coalesce(number, F.lit("")).alias("organisation_number"))


SLICE_SQL = f"""
i AS (SELECT o_orderkey AS input_index, o_custkey AS k, o_orderkey % 50 = 0 AS unknown_key,
      CASE WHEN o_orderkey % 50 = 0 THEN coalesce({key_sql('(o_custkey+5000000)')}, '')
      ELSE coalesce({key_sql('o_custkey')}, (80000000 + o_custkey)::VARCHAR || '0') END AS organisation_number,
      CASE WHEN o_orderkey % 50 = 0 THEN {key_sql('(o_custkey+5000000)')} ELSE {key_sql('o_custkey')} END AS good FROM orders),
outcome AS (SELECT i.*, c_name,
      CASE WHEN good IS NULL THEN 'failed' WHEN unknown_key OR c_custkey IS NULL THEN 'not_available' WHEN k % 97 = 0 THEN 'ambiguous'
        WHEN k % 89 = 0 OR (k % 3 <> 0 AND k % 113 = 0) THEN 'failed' ELSE 'available' END AS state,
      CASE WHEN good IS NULL THEN 'invalid_organisation_number'
        WHEN unknown_key OR c_custkey IS NULL THEN 'company_absent_in_frozen_registry'
        WHEN k % 97 = 0 THEN 'registry_identity_mismatch' WHEN k % 89 = 0 OR (k % 3 <> 0 AND k % 113 = 0) THEN 'ValueError' END AS error
      FROM i LEFT JOIN customer ON c_custkey = k)"""


@query(
    "j1_left_outcomes",
    f"WITH {SLICE_SQL} SELECT input_index, organisation_number, state, error FROM outcome",
)
def _j1(spark, d):
    return R.left_outcomes(slice_inputs(spark, d), registry_responses(spark, d), "company_absent_in_frozen_registry").select(
        "input_index", "organisation_number", "state", "error"
    )


@query(
    "e0_registry_slice",
    f"""WITH {SLICE_SQL}, {REGISTRY_FACTS_SQL},
    per AS (SELECT org, count(v) AS n_claims FROM facts GROUP BY org),
    seen AS (SELECT o.state, count(*) AS n_inputs, sum(coalesce(CASE WHEN o.state = 'available' THEN n_claims END, 0))::BIGINT AS n_claims
      FROM outcome o LEFT JOIN per ON per.org = o.organisation_number GROUP BY o.state)
    SELECT s.state, coalesce(n_inputs, 0) AS n_inputs, coalesce(n_claims, 0) AS n_claims
    FROM (VALUES ('ambiguous'),('available'),('blocked'),('failed'),('not_applicable'),('not_available')) s(state) LEFT JOIN seen USING (state)""",
)
def registry_slice(spark, d):
    """Inputs joined to gated records, claims counted per record, states counted with zero rows."""
    responses = registry_responses(spark, d)
    outcomes = R.left_outcomes(slice_inputs(spark, d), responses, "company_absent_in_frozen_registry")
    per_org = R.unpivot_claims(responses).groupBy("organisation_number").agg(F.count("*").alias("n_claims"))
    counted = outcomes.join(per_org, "organisation_number", "left").withColumn(
        "n_claims", F.when(F.col("state") == "available", F.coalesce("n_claims", F.lit(0))).otherwise(F.lit(0))
    )
    return rollups.state_counts(counted, {"n_inputs": F.count("*"), "n_claims": F.sum("n_claims")})


@query(
    "x20_build_evidence",
    """SELECT page_id, sha256(html) AS id, sha256(html) AS content_sha256, 'snapshots/' || sha256(html) || '.html' AS snapshot_path,
      'verified_company_website' AS source_class, 'visible_text_v2' AS extractor_version, url AS source_url, false AS synthetic FROM pages""",
)
def _x20(spark, d):
    p = table(spark, d, "pages").select(
        F.col("page_id").alias("organisation_number"), F.col("html").alias("body"), F.col("url").alias("source_url"),
        F.lit("2024-01-16T00:00:00+00:00").alias("retrieved_at"),
    )
    return (
        R.build_evidence(p, "verified_company_website", "visible_text_v2")
        .withColumnRenamed("organisation_number", "page_id").drop("retrieved_at")
    )
