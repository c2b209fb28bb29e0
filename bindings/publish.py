"""Contract, summary and report jobs bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.operators import registry_facts as RF
from vouchlake.plans import contract as C, report as P, search, summary as S
from vouchlake.session import durable, scratch
from vouchlake.sinks import tables as K

from .aggregates import STATE_SQL, event_states
from .common import REGISTRY_FACTS_SQL, key_sql, org_key, query, registry_responses, table
from .derive import STATEMENTS_SQL, statements


@query(
    "k3_contract_lines",
    """WITH l AS (SELECT l_orderkey, string_agg('{"field":"f' || l_linenumber || '","value":' || l_quantity::BIGINT || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS items FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS input_index, '{"claims":[' || coalesce(items, '') || '],"organisation_number":"' || o_custkey || '","state":"' || o_orderstatus || '"}' AS row_json FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def _k3(spark, d):
    l = table(spark, d, "lineitem")
    item = F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.col("l_quantity").cast("bigint").alias("value"))
    claims = C.nest(l, ["l_orderkey"], item, F.col("l_linenumber"), F.struct("l_partkey", "l_suppkey", "l_quantity"), "claims").withColumnRenamed("l_orderkey", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("input_index"), F.col("o_custkey").cast("string").alias("organisation_number"), F.col("o_orderstatus").alias("state"))
    lines = C.to_contract(o.withColumnRenamed("o_orderkey", "_k"), claims.withColumnRenamed("o_orderkey", "_k"), "input_index", ["_k"])
    lines = lines.withColumn("row_json", F.regexp_replace("row_json", r'"_k":\d+,', ""))
    path = scratch(spark, "contract")
    K.write_contract(lines, path)
    back = spark.read.text(path)
    return lines.select("input_index", "row_json").join(back.withColumnRenamed("value", "row_json").distinct(), "row_json", "left_semi")


@query(
    "c12_contract_claims",
    f"""WITH {REGISTRY_FACTS_SQL}, c AS (SELECT org, k, field, v FROM facts WHERE v IS NOT NULL UNION ALL SELECT org, k, 'website_identity', '"about ' || c_name || '"' FROM good WHERE k % 2 = 0)
    SELECT org AS organisation_number, CASE field WHEN 'website_identity' THEN 'official_website' ELSE field END AS field, CASE field WHEN 'website_identity' THEN '"https://c' || k || '.example.com/"' ELSE v END AS value_json,
      'available' AS availability, CASE field WHEN 'website_identity' THEN 0.9::DOUBLE ELSE 1.0 END AS confidence, CASE field WHEN 'website_identity' THEN v END AS passage FROM c
    UNION ALL SELECT org, field, NULL, 'not_available', 0.0, NULL FROM facts WHERE v IS NULL
    UNION ALL SELECT org, 'registered_employees', NULL, 'not_available', 0.0, NULL FROM good WHERE k % 3 = 0""",
)
def _c12(spark, d):
    responses = registry_responses(spark, d)
    facts = durable(RF.registry_facts(responses))
    k = F.substring("organisation_number", 2, 7).cast("int")
    url = F.concat(F.lit("https://c"), k.cast("string"), F.lit(".example.com/"))
    site = facts.filter((F.col("field") == "legal_name") & (k % 2 == 0))
    site = site.select(
        "organisation_number", F.lit("website_identity").alias("field"), F.concat(F.lit('"about '), F.substring("value_json", 2, 1000)).alias("value_json"),
        F.concat(F.lit("w"), "evidence_id").alias("evidence_id"), F.concat(F.lit("w"), "claim_id").alias("claim_id"),
    )
    claims = facts.filter("state = 'available'").select("organisation_number", "field", "value_json", "evidence_id", "claim_id").unionByName(site)
    ev = facts.select("organisation_number", F.col("evidence_id").alias("id"), F.lit("official_registry").alias("source_class"), F.lit("r").alias("source_url"))
    ev = ev.unionByName(site.select("organisation_number", F.col("evidence_id").alias("id"), F.lit("verified_company_website").alias("source_class"), url.alias("source_url")))
    out = C.contract_claims(claims, ev, facts.select("organisation_number", "field", "state", "reason"))
    return out.select("organisation_number", "field", "value_json", "availability", "confidence", F.col("supporting_passage_json").alias("passage"))


@query(
    "c13_validate_contract",
    """WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber = 1) AS n1, count(*) FILTER (l_quantity = 50) AS n50, count(*) FILTER (l_quantity = 49) AS n49, count(*) FILTER (l_quantity = 48) AS n48 FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderkey AS k FROM orders), v AS (
      SELECT k, 'input/output count mismatch' AS c FROM o WHERE k NOT IN (SELECT k FROM l)
      UNION ALL SELECT k, 'invalid confidence' FROM l WHERE n50 > 0 UNION ALL SELECT k, 'missing value became a fact' FROM l WHERE n49 > 0 UNION ALL SELECT k, 'dangling evidence reference' FROM l WHERE n48 > 0
      UNION ALL SELECT k, 'wrong input order or identity' FROM l WHERE k % 101 = 0 UNION ALL SELECT k, 'invalid run timestamps' FROM l WHERE k % 103 = 0 UNION ALL SELECT k, 'invalid operations metric' FROM l WHERE k % 107 = 0
      UNION ALL SELECT k, 'invalid change kind' FROM l WHERE k % 109 = 0 UNION ALL SELECT k, 'nonterminal result' FROM l WHERE k % 113 = 0)
    SELECT k AS input_index, c AS "check" FROM v""",
)
def _c13(spark, d):
    l, q, k = table(spark, d, "lineitem"), F.col("l_quantity"), F.col("input_index")
    claim = F.struct(
        F.when(q == 49, "blocked").otherwise("available").alias("availability"), F.when(q == 50, 1.5).otherwise(0.9).alias("confidence"),
        F.array(F.when(q == 48, "none").otherwise("e")).alias("evidence_ids"), F.lit("1").alias("value_json"),
    )
    rows = C.nest(l, ["l_orderkey"], claim, F.col("l_linenumber"), F.struct("l_partkey", "l_suppkey", "l_quantity"), "claims").withColumnRenamed("l_orderkey", "input_index")
    rows = rows.select(
        "input_index", F.when(k % 101 == 0, "?").otherwise(k.cast("string")).alias("organisation_number"), F.lit("r").alias("run_id"), F.when(k % 103 == 0, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("started_at"),
        F.lit("2024-01-01T01:00:00+00:00").alias("completed_at"), F.when(k % 113 == 0, "running").otherwise("completed").alias("terminal_status"), "claims", F.array(F.lit("e")).alias("evidence_ids"),
        F.array(F.when(k % 109 == 0, "moved").otherwise("changed")).alias("change_kinds"), F.array(F.lit("e")).alias("change_refs"), F.lit(None).cast("array<string>").alias("last_known_refs"),
        F.when(k % 107 == 0, -1).otherwise(1).alias("requests"), F.lit(1.5).alias("runtime_ms"), F.lit(0).alias("third_party_cost_usd"),
    )
    inputs = table(spark, d, "orders").select(F.col("o_orderkey").alias("input_index"), F.col("o_orderkey").cast("string").alias("organisation_number"))
    return C.validate_contract(rows, inputs)


@query(
    "c14_summaries",
    f"""WITH {REGISTRY_FACTS_SQL}, {STATEMENTS_SQL},
    o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    lead AS (SELECT o_custkey, 'Registered leadership: ' || string_agg('Clerk ' || o_orderkey || ' (' || o_orderpriority || ')', '; ' ORDER BY o_orderkey) AS p FROM o WHERE rn <= 3 GROUP BY 1),
    loc AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
    news AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS ok, max(o_orderdate) AS day FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    chg AS (SELECT o_custkey, 'Latest refresh changes: ' || string_agg('registered address changed', ', ') FILTER (rn <= 4) || CASE WHEN max(n) > 4 THEN ', ' || (max(n) - 4) || ' more' ELSE '' END AS p FROM o GROUP BY 1),
    rev AS (SELECT * FROM st WHERE report_type = 'F'), lat AS (SELECT * FROM rev QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) = 1),
    fin AS (SELECT lat.o_custkey, 'Revenue was ' || format('{{:,}}', lat.cents) || ' NOK in ' || lat.y || ' (company accounts)' || CASE WHEN rev.cents IS NOT NULL THEN ', ' || CASE WHEN lat.cents > rev.cents THEN 'up' WHEN lat.cents < rev.cents THEN 'down' ELSE 'unchanged' END
        || ' ' || printf('%.1f', abs((lat.cents - rev.cents)::DOUBLE / rev.cents * 100)) || '% year over year' ELSE '; no comparable prior period was available' END
        || CASE WHEN lat.o_custkey % 2 = 0 THEN '. Annual result was ' || format('{{:,}}', lat.cents // 10) || ' NOK for the same period' ELSE '' END AS p
      FROM lat LEFT JOIN rev ON rev.o_custkey = lat.o_custkey AND rev.y = lat.y - 1)
    SELECT org AS organisation_number, c_name || CASE WHEN k % 11 <> 0 THEN '. ' || seg || '; ' || n_name ELSE '. Industry: ' || seg END || coalesce('. ' || lead.p, '')
      || coalesce('. ' || loc.n || ' registered operating ' || CASE loc.n WHEN 1 THEN 'location' ELSE 'locations' END, '') || coalesce('. Latest company news (' || strftime(news.day, '%Y-%m-%d') || '): Order ' || news.ok, '')
      || coalesce('. ' || fin.p, '') || '. Not checked in this run: company description, financials, jobs, leadership and 5 more'
      || CASE WHEN k % 3 = 0 OR k % 7 = 0 OR k % 11 = 0 THEN '. Checked but not reported: ' || concat_ws(', ', CASE WHEN k % 11 = 0 THEN 'business activity' END, CASE WHEN k % 7 = 0 THEN 'registered address' END, CASE WHEN k % 3 = 0 THEN 'registered employees' END) ELSE '' END
      || coalesce('. ' || chg.p, '') || '.' AS summary
    FROM good LEFT JOIN lead ON lead.o_custkey = k LEFT JOIN loc ON loc.o_custkey = k LEFT JOIN news ON news.o_custkey = k LEFT JOIN fin ON fin.o_custkey = k LEFT JOIN chg ON chg.o_custkey = k""",
)
def _c14(spark, d):
    responses = registry_responses(spark, d)
    facts = durable(RF.registry_facts(responses))
    names = facts.select("organisation_number", "legal_name").distinct()
    o = table(spark, d, "orders").withColumn("organisation_number", org_key(F.col("o_custkey"))).filter("organisation_number is not null")
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    claim = lambda df, field, value, order: df.select("organisation_number", F.lit(field).alias("field"), value.alias("value_json"), order.alias("ord"))
    st = statements(spark, d).filter("report_type = 'F'").withColumn("organisation_number", org_key(F.col("o_custkey")))
    money = lambda metric, amount: F.to_json(F.struct(
        F.lit(metric).alias("metric"), amount.alias("amount"), F.lit("NOK").alias("currency"), F.lit("SELSKAP").alias("report_type"),
        F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), F.date_format("period_end", "yyyy-MM-dd").alias("period_end"),
    ))
    y = F.col("y").cast("bigint")
    claims = (
        facts.filter("state = 'available'").select("organisation_number", "field", "value_json", F.lit(0).cast("bigint").alias("ord"))
        .unionByName(claim(o, "leadership", F.to_json(F.struct(F.concat(F.lit("Clerk "), key).alias("name"), F.col("o_orderpriority").alias("role"))), F.col("o_orderkey")))
        .unionByName(claim(o.filter("o_orderstatus = 'P'"), "locations", F.to_json(F.struct(key.alias("name"))), F.col("o_orderkey")))
        .unionByName(claim(o.filter("o_orderstatus = 'O'"), "news", F.to_json(F.struct(day.alias("datePublished"), F.concat(F.lit("Order "), key).alias("headline"))), F.col("o_orderkey")))
        .unionByName(claim(st, "financials", money("revenue", F.col("cents")), y))
        .unionByName(claim(st.filter("o_custkey % 2 = 0"), "financials", money("annual_result", F.floor(F.col("cents") / 10)), y))
    )
    claims = durable(claims)  # a stored claim table; the summary reads it several times
    availability = RF.baseline_availability(None, facts).withColumn("ord", F.col("field"))
    changes = o.select("organisation_number", F.lit("registered_address").alias("field"), F.lit("changed").alias("kind"), F.col("o_orderkey").alias("ord"))
    return S.summaries(names, claims, availability, changes)


@query(
    "c15_run_report",
    f"""WITH e AS (SELECT *, {STATE_SQL} AS state, event_id % 10 = 0 AS resumed FROM events)
    SELECT count(*) AS output_count, count(*) FILTER (resumed) AS resumed_count, count(*) FILTER (state = 'ambiguous') AS state_ambiguous, count(*) FILTER (state = 'available') AS state_available, count(*) FILTER (state = 'blocked') AS state_blocked,
      count(*) FILTER (state = 'failed') AS state_failed, 0::BIGINT AS state_not_applicable, count(*) FILTER (state = 'not_available') AS state_not_available, sum(event_id % 7)::BIGINT AS claims, sum(event_id % 3)::BIGINT AS pages_verified, sum(event_id % 2)::BIGINT AS legal_reports,
      sum(event_id % 20)::BIGINT AS requests, sum(event_id % 6) FILTER (NOT resumed)::BIGINT AS website_requests, sum(event_id % 4) FILTER (NOT resumed)::BIGINT AS legal_requests, sum(event_id % 3) FILTER (NOT resumed)::BIGINT AS queries,
      round(sum(event_id % 3) FILTER (NOT resumed) * 0.005, 6) AS cost, quantile_disc(value, 0.5) FILTER (NOT resumed) AS p50_ms, quantile_disc(value, 0.95) FILTER (NOT resumed) AS p95_ms FROM e""",
)
def _c15(spark, d):
    k = F.col("event_id")
    rows = event_states(spark, d).select(
        "state", (k % 10 == 0).alias("resumed"), F.col("value").alias("runtime_ms"), (k % 7).alias("claims"), (k % 20).alias("requests"), (k % 6).alias("website_requests"), (k % 4).alias("legal_requests"),
        (k % 2).alias("legal_reports"), (k % 3).alias("pages_verified"), (k % 3).alias("queries"), (k % 3 * F.lit(0.005)).alias("cost"),
    )
    return P.run_report(rows)


@query("c19_search_profiles", "SELECT doc_id FROM documents WHERE contains(lower(doc_id || ' ' || lang || ' ' || source || ' ' || text), 'en the')")
def _c19(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.array("text").alias("values"))
    return P.search_profiles(docs, " EN the ", ["doc_id", "lang", "source"], "values").select("doc_id")


@query("c19_indexed_search", "SELECT doc_id FROM documents WHERE contains(lower(doc_id || ' ' || lang || ' ' || source || ' ' || text), 'en the')")
def _c19i(spark, d):
    path = scratch(spark, "index")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.array("text").alias("values"))
    search.build_index(docs, "doc_id", search.searched_text(["doc_id", "lang", "source"], "values"), path)
    return search.search_index(spark, path, " EN the ").select(F.col("key").alias("doc_id"))


@query(
    "c20_label_sources",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'JSON-LD block 3 · Pointer: (root)' WHEN 1 THEN 'JSON pointer: /a' WHEN 2 THEN 'Text span: [' || (event_id % 9) || ', ' || (event_id % 9 + 5) || ']' ELSE 'HTML meta description' END AS locator,
      CASE WHEN event_id % 11 = 0 THEN 'Synthetic fixture' WHEN event_type = 'click' THEN 'Registry' WHEN event_type = 'view' THEN 'www.example.com' WHEN event_type = 'error' THEN 'Public filing' ELSE 'Annual accounts' END AS source FROM events""",
)
def _c20(spark, d):
    k, kind = F.col("event_id") % 4, F.col("event_type")
    span = F.struct((F.col("event_id") % 9).alias("start"), (F.col("event_id") % 9 + 5).alias("end"))
    e = table(spark, d, "events").select(
        "event_id", F.when(k == 0, 3).alias("json_ld_block"), F.when(k == 0, "").when(k == 1, "/a").alias("json_pointer"), F.when(k == 2, span).alias("text_span"),
        F.when(k == 3, "company_meta_description_v1").otherwise("x").alias("extraction_method"), (F.col("event_id") % 11 == 0).alias("synthetic"),
        F.when(kind == "click", "https://registry.example.org/e/1").otherwise("https://WWW.example.com:443/x").alias("source_url"),
        F.when(kind == "view", "verified_company_website").when(kind == "error", "legal_filing_report").otherwise("official_accounts").alias("source_class"),
    )
    return e.select("event_id", P.locator_label().alias("locator"), P.source_label("https://registry.example.org/", "Registry").alias("source"))
