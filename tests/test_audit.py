"""Bodies as a bucketed table, replay per class and version, and excerpts without repeated bodies."""

import pytest
from pyspark.sql import functions as F

from vouchlake.operators import extract as X
from vouchlake.operators.walk import find_objects, objects_with
from vouchlake.plans import audit as A
from vouchlake.sinks.bodies import in_parts, open_bodies, store_bodies

ORG = "923609016"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_pruned_and_not_shuffled(spark, tmp_path):
    rows = [(c, v, f"{c}{v}{i}", b"x" * 50) for c in ("official_accounts", "legal_news_report") for v in ("v1", "v2") for i in range(30)]
    bodies = store_bodies(spark.createDataFrame(rows * 2, "source_class string, extractor_version string, content_sha256 string, body binary"), str(tmp_path / "b"))
    assert bodies.count() == 120
    again = open_bodies(spark, str(tmp_path / "b"), 8)
    assert again.count() == 120 and again.filter("source_class = 'legal_news_report'").count() == 60
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = again.filter("source_class = 'official_accounts' and extractor_version = 'v1'").select("content_sha256", F.length("body").alias("n"))
        cited = spark.createDataFrame([("official_accountsv11", "a"), ("official_accountsv12", "b")], "content_sha256 string, org string")
        joined = own.join(cited, "content_sha256")
        text = plan(joined)
        assert joined.count() == 2 and text.count("Exchange hashpartitioning") == 1 and "PartitionFilters: [isnotnull(source_class" in text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_hot_keys_are_dealt_into_parts(spark):
    rows = spark.createDataFrame([("hot", str(i)) for i in range(1000)] + [("cold", "x")], "k string, c string")
    parts = in_parts(rows, "k", "c", 100).groupBy("k", "_part").count().collect()
    assert sum(r["count"] for r in parts) == 1001 and max(r["count"] for r in parts) < 200 and len(parts) == 11


def test_both_versions_of_a_class(spark, tmp_path):
    body = '{"g":[{"type":{"beskrivelse":"Leder"},"person":{"navn":{"fornavn":"Kari","etternavn":"Vik"}}}]}'
    landed = spark.createDataFrame(
        [(ORG, "N", "https://r", "2024-01-16T00:00:00+00:00", "official_registry_roles", v, "h" + v, body) for v in ("registry_roles_v1", "registry_roles_v2")],
        "organisation_number string, legal_name string, source_url string, retrieved_at string, source_class string, extractor_version string, content_sha256 string, body string",
    )
    claims = A.ready_registry().replay(landed.drop("body"), store_bodies(landed, str(tmp_path / "b"))).collect()
    assert sorted((c.extraction_method, c.json_pointer) for c in claims) == [("registry_roles_v1", None), ("registry_roles_v2", "/g/0")]
    assert {p[0] for p in A.ready_registry().pairs()} == set(A.fixed.SOURCE_CLASSES)


def test_sources_are_named_rightly(spark):
    rows = [
        (ORG, "1", "official_accounts", "official_accounts_v2", "https://r/a/" + ORG), (ORG, "2", "official_accounts", "official_accounts_v2", "https://r/a/1"),
        (ORG, "3", "official_accounts", "official_accounts_v9", "https://r/a/" + ORG), (ORG, "4", "verified_social_page", "social_identity_v1", "http://linkedin.com/a#b"),
        (ORG, "5", "verified_social_page", "social_identity_v1", "https://linkedin.com/a"),
    ]
    ev = spark.createDataFrame(rows, "organisation_number string, id string, source_class string, extractor_version string, source_url string")
    bad = A.audit_sources(ev, A.ready_registry(), {"official_accounts": "https://r/a/{}"}).collect()
    assert sorted((r.id, r.check) for r in bad) == [("2", "wrong source URL"), ("3", "unknown extractor"), ("4", "unsafe source URL")]


def test_many_claims_of_one_body(spark):
    ev = spark.createDataFrame([("e", '{"a":[' + ",".join(map(str, range(2500))) + "]}", True)], "evidence_id string, body string, is_json boolean")
    ev = ev.withColumns({"text": F.lit(None).cast("string"), "json_ld": F.lit(None).cast("array<string>")})
    span = F.lit(None).cast("struct<start:int,end:int>")
    claims = spark.range(2500).select(
        F.lit("o").alias("organisation_number"), F.col("id").cast("string").alias("claim_id"), F.lit("e").alias("evidence_id"), F.concat(F.lit("/a/"), "id").alias("json_pointer"),
        F.lit(None).cast("int").alias("json_ld_block"), span.alias("text_span"), F.lit('"no"').alias("value_json"))
    out = X.claim_excerpts(claims, ev).collect()
    assert len(out) == 2500 and all(r.excerpt == r.claim_id for r in out)


@pytest.mark.parametrize(("text", "members", "stop", "want"), [
    ('{"a":{"a":{}},"b":1}', {"a": "{"}, False, ["", "/a"]), ('{"a":{"a":{}},"b":1}', {"a": "{"}, True, [""]), ('[{"x/y":[{"a~":1}]}]', {"a~": ""}, False, ["/0/x~1y/0"]),
    ('{"k":"{\\"a\\":{}}"}', {"a": "{"}, False, []), ('{"\\u0061":{}}', {"a": "{"}, False, [""]), ("[]", {}, False, []), ('{"a":"{"}', {"a": "{"}, False, []),
])
def test_objects_with(text, members, stop, want):
    assert [f[0] for f in objects_with(text, members, stop)] == want


def test_deep_and_large_documents(spark):
    deep = "[" * 40 + '{"a":{},"n":7}' + "]" * 40
    many = "[" + ",".join(f'{{"a":{{}},"n":{i}}}' for i in range(50_000)) + "]"
    df = spark.createDataFrame([("d", deep), ("m", many), ("bad", "{"), ("none", None)], "id string, body string")
    rows = find_objects(df, "body", ["id"], {"a": "{", "n": ""}).select("id", "pointer", F.try_variant_get("node", "$.n", "int").alias("n")).collect()
    assert [(r.pointer, r.n) for r in rows if r.id == "d"] == [("/0" * 40, 7)]
    assert sorted((r.pointer, r.n) for r in rows if r.id == "m")[:2] == [("/0", 0), ("/1", 1)] and len(rows) == 50_001
