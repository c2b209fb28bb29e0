"""Audits over documents and registry claims with planted faults."""

from pyspark.sql import functions as F

from vouchlake.operators import registry_facts as RF
from vouchlake.plans import audit as A
from vouchlake.session import durable, scratch
from vouchlake.sinks.bodies import store_bodies

from .common import REGISTRY_FACTS_SQL, key_sql, query, registry_responses, table


@query(
    "c8_audit_snapshots",
    """WITH b AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1), d AS (SELECT doc_id, sha256(text) AS h FROM documents), j AS (SELECT d.*, first FROM d JOIN b USING (h)),
    v AS (SELECT doc_id, 'unknown evidence' AS check_, doc_id % 50 = 1 AS bad FROM j UNION ALL SELECT doc_id, 'retrieval timezone missing', doc_id % 50 = 2 FROM j
      UNION ALL SELECT doc_id, 'wrong snapshot path', doc_id % 50 = 3 FROM j UNION ALL SELECT doc_id, 'unknown source class', doc_id % 50 = 4 FROM j
      UNION ALL SELECT doc_id, 'snapshot hash mismatch', first % 50 = 0 AND doc_id % 50 <> 1 FROM j UNION ALL SELECT doc_id, 'snapshot missing', first % 50 = 5 AND doc_id % 50 <> 1 FROM j)
    SELECT doc_id::VARCHAR AS organisation_number, check_ AS "check" FROM v WHERE bad""",
)
def _c8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    k = F.col("doc_id") % 50
    org = F.col("doc_id").cast("string").alias("organisation_number")
    claims = docs.select(org, F.col("h").alias("evidence_id"), org.alias("claim_id"))
    ev = docs.filter(k != 1).select(
        org, F.col("h").alias("id"), F.col("h").alias("content_sha256"), F.when(k == 4, "rumour").otherwise("verified_company_website").alias("source_class"),
        F.concat(F.lit("snapshots/"), "h", F.when(k == 3, ".json").otherwise(".html")).alias("snapshot_path"), F.when(k == 2, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00+01:00").alias("retrieved_at"),
    )
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.min_by("text", "doc_id").alias("text"))
    snaps = first.filter("first % 50 <> 5").select(
        F.col("h").alias("content_sha256"), F.when(F.col("first") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary").alias("body")
    )
    return A.audit_snapshots(claims, ev, snaps).select("organisation_number", "check")


@query(
    "c9_audit_claims",
    f"""WITH {REGISTRY_FACTS_SQL} SELECT org AS organisation_number, field, CASE WHEN k % 20 = 0 AND field = 'bankrupt' THEN '"true"' ELSE v END AS value_json FROM facts
      WHERE v IS NOT NULL AND ((k % 20 = 0 AND field = 'bankrupt') OR (k % 20 = 1 AND field = 'industry'))""",
)
def _c9(spark, d):
    landed = durable(registry_responses(spark, d).withColumns({
        "source_class": F.lit("official_registry"), "extractor_version": F.lit("registry_v1"), "content_sha256": F.sha2("body", 256), "legal_name": F.lit(None).cast("string"),
    }))
    bodies = store_bodies(landed, scratch(spark, "bodies"))
    derived = durable(A.ready_registry().replay(landed.drop("body"), bodies))
    k = F.substring("organisation_number", 2, 7).cast("int") % 20
    stored = derived.withColumn("value_json", F.when((k == 0) & (F.col("field") == "bankrupt"), F.lit('"true"')).otherwise(F.col("value_json")))
    stored = stored.withColumn("json_pointer", F.when((k == 1) & (F.col("field") == "industry"), F.lit("/navn")).otherwise(F.col("json_pointer")))
    out = A.audit_claims(stored, derived, ["organisation_number", "claim_id", "field", "value_json", "json_pointer", "evidence_id"])
    return out.select("organisation_number", "field", "value_json")


@query(
    "c10_audit_profiles",
    f"""WITH {REGISTRY_FACTS_SQL}, p AS (SELECT org, k FROM good), v AS (
      SELECT org, 'non-available result has current claims' AS c FROM p WHERE k % 20 = 0 UNION ALL SELECT org, 'invalid availability state' FROM p WHERE k % 20 = 1
      UNION ALL SELECT org, 'non-available result has current claims' FROM p WHERE k % 20 = 1
      UNION ALL SELECT org, 'official identity anchor missing' FROM p WHERE k % 20 = 2 UNION ALL SELECT org, 'duplicate claim ids' FROM p WHERE k % 20 = 3
      UNION ALL SELECT org, 'duplicate evidence ids' FROM p WHERE k % 20 = 4 UNION ALL SELECT org, 'refresh change sides do not match kind' FROM p WHERE k % 20 = 5
      UNION ALL SELECT org, 'refresh after claim is not current' FROM p WHERE k % 20 = 6)
    SELECT org AS organisation_number, c AS "check" FROM v""",
)
def _c10(spark, d):
    claims = durable(RF.unpivot_claims(registry_responses(spark, d)))
    k = (F.substring("organisation_number", 2, 7).cast("int") % 20).alias("k")
    claims = claims.withColumn("k", k)
    profiles = claims.select("organisation_number", "k").distinct().withColumn("state", F.when(F.col("k") == 0, "blocked").when(F.col("k") == 1, "gone").otherwise("available"))
    ev = claims.select("organisation_number", F.col("evidence_id").alias("id"), "k").distinct()
    ev = ev.withColumn("source_class", F.when(F.col("k") == 2, "verified_company_website").otherwise("official_registry"))
    ev = ev.unionByName(ev.filter("k = 4"))
    name = claims.filter("field = 'legal_name'")
    claims = claims.unionByName(name.filter("k = 3"))
    ch = name.select(
        "organisation_number", "subject", F.when(F.col("k") == 5, "added").otherwise("changed").alias("kind"), F.lit('"old"').alias("before_json"),
        F.when(F.col("k") == 6, F.lit('"other"')).otherwise(F.col("value_json")).alias("after_json"),
    )
    return A.audit_profiles(profiles, claims, ev, ch)


@query(
    "c11_audit_export",
    """SELECT (SELECT count(*) FROM documents) AS expected_rows, count(*) AS exported_rows, (SELECT count(*) FROM documents) - count(*) + count(*) FILTER (doc_id % 100 = 7) AS mismatches, false AS passed FROM documents WHERE doc_id % 100 <> 9""",
)
def _c11(spark, d):
    docs = table(spark, d, "documents")
    expected = docs.select(F.col("doc_id").alias("input_index"), F.col("source").alias("organisation_number"))
    rows = docs.filter("doc_id % 100 <> 9").select(F.col("doc_id").alias("input_index"), F.when(F.col("doc_id") % 100 == 7, "?").otherwise(F.col("source")).alias("organisation_number"))
    return A.audit_export(expected, rows)
