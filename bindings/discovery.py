"""Discovery, frontier and verification jobs bound to customers, orders, pages and documents."""

from pyspark.sql import functions as F

from vouchlake.functions import fixed, urls
from vouchlake.plans import discovery as D, verification as V
from vouchlake.session import spread

from .common import key_sql, org_key, query, sql_list, sql_pattern, table


def entities(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").cast("string").alias("organisation_number"), F.col("c_name").alias("legal_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("n_name")).alias("town"), "c_custkey",
    )


RESULTS_SQL = """o AS (SELECT o_custkey AS k, o_orderkey AS ord, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS q,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0 THEN 'social_page' ELSE 'website' END AS kind,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0 THEN 'https://www.facebook.com/o' || (o_orderkey % 3) ELSE 'https://site' || (o_orderkey % 4) || '.example.com/' || (o_orderkey % 5) END AS value,
  CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0 THEN 'www.facebook.com' ELSE 'site' || (o_orderkey % 4) || '.example.com' END AS host FROM orders),
f AS (SELECT * FROM o WHERE q = 1 AND k % 10 <> 0),
ex AS (SELECT c_custkey AS k, 'https://site1.example.com/' AS value, 'site1.example.com' AS host FROM customer WHERE c_custkey % 3 = 0),
need AS (SELECT DISTINCT k FROM f WHERE k NOT IN (SELECT k FROM f WHERE kind = 'social_page'))"""


def results(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    social = (F.col("o_orderpriority") == "2-HIGH") & (k % 5 == 0)
    failed = (F.col("o_custkey") % 10 == 0) & (F.col("o_orderstatus") != "P")
    value = F.when(social, F.concat(F.lit("https://www.facebook.com/o"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("https://site"), (k % 4).cast("string"), F.lit(".example.com/"), (k % 5).cast("string")))
    rows = o.select(
        F.col("o_custkey").cast("string").alias("organisation_number"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("query_no"), k.alias("ord"),
        F.when(social, "social_page").otherwise("website").alias("kind"), value.alias("value"), F.when(social, "www.facebook.com").otherwise(F.concat(F.lit("site"), (k % 4).cast("string"), F.lit(".example.com"))).alias("host"),
        F.when(failed, "search_http_500").alias("error"),
    )
    return rows.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("kind", "value", "host")})


def existing(spark, d):
    e = entities(spark, d).filter("c_custkey % 3 = 0")
    return e.select("organisation_number", F.lit("website").alias("kind"), F.lit("https://site1.example.com/").alias("value"), F.lit("site1.example.com").alias("host"))


@query(
    "c16_queries",
    f"""WITH {RESULTS_SQL}, q AS (SELECT c_custkey AS k, '"' || c_name || '"' || CASE WHEN c_custkey % 4 <> 0 THEN ' ' || n_name ELSE '' END AS query FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT k::VARCHAR AS organisation_number, 1 AS query_no, query FROM q UNION ALL SELECT k::VARCHAR, 2, query || ' Facebook Instagram LinkedIn' FROM q WHERE k IN (SELECT k FROM need)""",
)
def _c16(spark, d):
    e = entities(spark, d)
    first = results(spark, d).filter("query_no = 1")
    return D.first_queries(e).unionByName(D.second_queries(e, existing(spark, d), first))


@query(
    "c16_candidates",
    f"""WITH {RESULTS_SQL}, a AS (SELECT * FROM f UNION ALL SELECT * FROM o WHERE q = 2 AND k IN (SELECT k FROM need)), m AS (SELECT *, CASE kind WHEN 'website' THEN host ELSE value END AS mark FROM a
      QUALIFY row_number() OVER (PARTITION BY k, kind, mark ORDER BY q, ord) = 1)
    SELECT k::VARCHAR AS organisation_number, kind, value FROM m WHERE NOT (kind = 'website' AND host = 'site1.example.com' AND k % 3 = 0)""",
)
def _c16c(spark, d):
    e, r, x = entities(spark, d), results(spark, d), existing(spark, d)
    first = r.filter("query_no = 1")
    second = r.filter("query_no = 2").join(D.needs_social(e, x, first), "organisation_number", "left_semi")
    return D.merge_candidates(x, first.unionByName(second)).select("organisation_number", "kind", "value")


@query(
    "c17_guess_domains",
    """WITH e AS (SELECT s_suppkey, 'supplier' || right(s_name, 9) || 'blaebar' AS name, CASE WHEN s_suppkey % 3 <> 0 THEN replace(lower(n_name), '_', '') || 'aso' END AS town FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey::VARCHAR AS organisation_number, 0::BIGINT AS ord, 'www.' || name || '.no' AS value FROM e UNION ALL SELECT s_suppkey::VARCHAR, 1, name || '.no' FROM e UNION ALL SELECT s_suppkey::VARCHAR, 2, name || '-' || town || '.no' FROM e WHERE town IS NOT NULL""",
)
def _c17(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.select(
        F.col("s_suppkey").cast("string").alias("organisation_number"), F.concat("s_name", F.lit(" BLÆBÂR AS")).alias("legal_name"), F.when(F.col("s_suppkey") % 3 != 0, F.concat("n_name", F.lit(" Åsø"))).alias("town")
    )
    e = e.withColumn("legal_name", F.replace("legal_name", F.lit("BLÆBÂR"), F.lit("Blæbâr")))
    return D.guess_domains(e).select("organisation_number", F.col("ord").cast("bigint").alias("ord"), "value")


FRONTIER_LINKS = {
    "root": ["/contact", "/news", "mailto:a@b", "/karriere", "/blog", "https://other.example.org/news", "/about#x", "/products"],
    "news": ["/news/a", "/news/b?q=1", "b/../c", "/logo.png", "#top", "/privacy", "/news/about-us"],
    "jobs": ["welder", "/karriere/painter/"],
}


@query(
    "c18_plan_frontier",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS v FROM customer), p AS (
      SELECT k, 0 AS v, unnest([1, 2, 3, 4]) AS position, unnest(['/news', '/karriere', '/contact', '/about']) AS path FROM c WHERE v = 0
      UNION ALL SELECT k, 1, unnest([1, 2, 3]), unnest(['/karriere', '/c', '/news/a']) FROM c WHERE v = 1
      UNION ALL SELECT k, 2, unnest([1, 2]), unnest(['/c', '/welder']) FROM c WHERE v = 2)
    SELECT k::VARCHAR AS organisation_number, position, 'https://c' || k || '.example.com' || path AS url FROM p""",
)
def _c18(spark, d):
    """Third of the customers: root only; root and news page; root, news and job page."""
    c = spread(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"), (F.col("c_custkey") % 3).alias("v")), rows=4_000)
    site = F.concat(F.lit("https://c"), "organisation_number", F.lit(".example.com"))
    page = lambda name, path, at: F.when(F.col("v") >= at, F.struct(F.concat(site, F.lit(path)).alias("page_url"), F.lit(path == "/").alias("is_root"), F.array(*[F.lit(x) for x in FRONTIER_LINKS[name]]).alias("links")))
    rows = c.select("organisation_number", F.explode(F.filter(F.array(page("root", "/", 0), page("news", "/news", 1), page("jobs", "/karriere", 2)), lambda x: x.isNotNull())).alias("p"))
    return D.plan_frontier(rows.select("organisation_number", "p.*"), D.FOLLOW_UPS)


HREFS_SQL = """a AS (SELECT page_id AS k, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages),
u AS (SELECT k, unnest(hs) AS h, unnest(range(len(hs))) AS pos FROM a)"""
DETAIL_SQL = f"NOT (lower(h) = '/' OR regexp_extract(lower(h), '([^/]*)/*$', 1) IN ({sql_list(fixed.UTILITY_TAILS)}) OR regexp_matches(lower(h), '{sql_pattern(fixed.ASSET_PATTERN)}'))"
STORY_SQL = "CASE " + " ".join(f"WHEN contains(lower(h), '{w}') THEN {i}" for i, w in enumerate(fixed.LINK_WORDS)) + " ELSE -1 END"


def page_sites(spark, d):
    """A site of each given page: a root, a news index with the links of the page's HTML, and for even ids an archive behind it."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("hrefs"))
    even, list_of = F.col("page_id") % 2 == 0, lambda *xs: F.array(*[F.lit(x) for x in xs])
    page = lambda path, links: F.struct(F.lit(path).alias("path"), links.alias("links"))
    old = F.concat(F.transform("hrefs", lambda h: F.concat(h, F.lit("/old"))), list_of("/news", "/archive/news"))
    news = F.concat("hrefs", F.when(even, list_of("/archive/news")).otherwise(F.array().cast("array<string>")))
    pages = F.array(page("/", list_of("/news", "/karriere", "/about")), page("/news", news), page("/alone/news", list_of("/never")), F.when(even, page("/archive/news", old)))
    rows = p.select(F.col("page_id").cast("string").alias("organisation_number"), F.explode(F.array_compact(pages)).alias("p"))
    site = F.concat(F.lit("https://p"), "organisation_number", F.lit(".example.com"), "p.path")
    return rows.select("organisation_number", site.alias("page_url"), (F.col("p.path") == "/").alias("is_root"), "p.links")


@query(
    "c18_frontier_rounds",
    f"""WITH {HREFS_SQL}, m AS (
      SELECT k, unnest(['/', '/news', '/karriere', '/about']) AS path, unnest([0, 1, 1, 1]) AS round FROM a
      UNION ALL SELECT k, h, 2 FROM u WHERE {DETAIL_SQL} UNION ALL SELECT k, '/archive/news', 2 FROM a WHERE k % 2 = 0
      UNION ALL SELECT k, h || '/old', 3 FROM u WHERE k % 2 = 0)
    SELECT k::VARCHAR AS organisation_number, 'https://p' || k || '.example.com' || path AS url, min(round)::BIGINT AS round,
      path IN ('/', '/news', '/archive/news') AS landed FROM m GROUP BY k, path""",
)
def _c18_rounds(spark, d):
    return D.frontier_rounds(page_sites(spark, d))


@query(
    "c18_plan_pages",
    f"""WITH {HREFS_SQL}, c AS (SELECT k, h AS path, 1 AS phase, {STORY_SQL} AS story, pos FROM u WHERE {DETAIL_SQL}
      UNION ALL SELECT k, unnest(['/karriere', '/about']), unnest([0, 2]), 0, 0 FROM a),
    f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, path ORDER BY phase, story, pos) = 1)
    SELECT k::VARCHAR AS organisation_number, row_number() OVER (PARTITION BY k ORDER BY phase, story, pos) AS position, 'https://p' || k || '.example.com' || path AS url FROM f""",
)
def _c18_pages(spark, d):
    """The whole plan, no limit, behind a root and a news index that holds the links of a given page."""
    landed = page_sites(spark, d).filter(~F.col("page_url").rlike("/(alone|archive)/news$"))
    links = F.filter("links", lambda h: h != "/archive/news")
    return D.plan_frontier(landed.withColumn("links", links))


def order_links(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("organisation_number"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") % 6).alias("u"))


SOCIAL_SQL = """l AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderstatus AS s, o_orderkey % 6 AS u, o_orderpriority < '3' AS social FROM orders),
t AS (SELECT * FROM l WHERE social QUALIFY row_number() OVER (PARTITION BY k, u ORDER BY ord) = 1),
v AS (SELECT *, s = 'F' AS proven, min(CASE WHEN s = 'F' THEN ord END) OVER (PARTITION BY k, u % 2) AS first FROM t),
st AS (SELECT k, ord, CASE WHEN proven AND ord = first THEN 'verified' WHEN NOT proven AND u % 2 = 1 THEN 'rejected' END AS status FROM v)"""


def social(spark, d):
    l = order_links(spark, d).select(
        "organisation_number", "ord", F.concat(F.lit("https://x.com/"), F.col("u").cast("string")).alias("url"), F.when(F.col("p") < "3", "x.com").otherwise("c.example.com").alias("host"),
        (F.col("u") % 2 == 1).alias("listed"), (F.col("u") % 2).cast("string").alias("body_hash"), F.when(F.col("s") == "F", True).when(F.col("s") == "O", False).alias("proven"),
    )
    sites = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("organisation_number"))
    return V.verify_social(l, sites)


@query("c21_social_statuses", f"WITH {SOCIAL_SQL} SELECT k::VARCHAR AS organisation_number, ord, status FROM st")
def _c21(spark, d):
    return social(spark, d)[0].select("organisation_number", "ord", "status")


@query(
    "c21_social_availability",
    f"""WITH {SOCIAL_SQL}, a AS (SELECT k, count(*) FILTER (status = 'verified') AS v FROM st GROUP BY k) SELECT c_custkey::VARCHAR AS organisation_number, CASE WHEN v > 0 THEN 'available' ELSE 'not_available' END AS state,
      CASE WHEN v > 0 THEN NULL WHEN v = 0 THEN 'no_exact_social_identity_on_checked_candidates' ELSE 'no_social_profile_link_on_verified_site' END AS reason FROM customer LEFT JOIN a ON k = c_custkey""",
)
def _c21a(spark, d):
    return social(spark, d)[1].drop("field")


SITES_SQL = """t AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderkey % 6 <> 0 AS allowed, o_orderkey % 7 <> 0 AS opened, CASE WHEN o_orderkey % 7 = 0 THEN 'robots_unavailable' WHEN o_orderkey % 5 = 0 THEN 'html_unavailable' END AS err, o_orderstatus = 'F' AS proven
  FROM orders),
b AS (SELECT *, min(CASE WHEN allowed AND err IS NULL AND proven THEN ord END) OVER (PARTITION BY k) AS best FROM t),
r AS (SELECT *, best IS NULL OR ord <= best AS reached FROM b)"""


def sites(spark, d):
    k = F.col("ord")
    c = order_links(spark, d).select(
        "organisation_number", "ord", F.lit("unverified").alias("status"), (k % 6 != 0).alias("allowed"), (k % 7 != 0).alias("opened"),
        F.when(k % 7 == 0, "robots_unavailable").when(k % 5 == 0, "html_unavailable").alias("error"), (F.col("s") == "F").alias("proven"),
    )
    return V.verify_sites(c)


@query(
    "c22_site_statuses",
    f"""WITH {SITES_SQL} SELECT k::VARCHAR AS organisation_number, ord, CASE WHEN ord = best THEN 'verified' WHEN reached AND allowed AND err IS NULL THEN 'rejected' ELSE 'unverified' END AS status,
      CASE WHEN reached THEN CASE WHEN NOT allowed THEN 'domain_not_in_reviewed_allowlist' ELSE err END END AS note FROM r""",
)
def _c22(spark, d):
    return sites(spark, d)[0].select("organisation_number", "ord", "status", "note")


@query(
    "c22_site_availability",
    f"""WITH {SITES_SQL} SELECT k::VARCHAR AS organisation_number, CASE WHEN max(best) IS NOT NULL THEN 'available' WHEN bool_or(allowed AND opened) THEN 'ambiguous' ELSE 'not_available' END AS state,
      CASE WHEN max(best) IS NOT NULL THEN NULL WHEN bool_or(allowed AND opened) THEN 'exact_entity_proof_not_found' ELSE 'website_candidate_unavailable' END AS reason FROM r GROUP BY k""",
)
def _c22a(spark, d):
    return sites(spark, d)[1].drop("field")


LEGAL_SQL = """e AS (SELECT d.source AS k, d.doc_id AS ord, sha256(text) AS h, d.doc_id % 8 <> 0 AS allowed, CASE d.doc_id % 9 WHEN 1 THEN 'robots_disallowed' WHEN 2 THEN 'TimeoutError' END AS err, l.doc_id IS NOT NULL AS identified,
  coalesce(quality = 1, false) AS reported FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
n AS (SELECT *, CASE WHEN NOT allowed THEN 'legal_source_not_reviewed_or_allowlisted' ELSE err END AS note FROM e),
f AS (SELECT *, min(CASE WHEN note IS NULL AND reported THEN ord END) OVER (PARTITION BY k, h) AS first FROM n),
s AS (SELECT k, ord, CASE WHEN note IN ('robots_disallowed', 'legal_source_not_reviewed_or_allowlisted') THEN 'blocked' WHEN note IS NOT NULL THEN 'failed' WHEN reported AND ord > first THEN NULL WHEN reported THEN 'available' WHEN NOT identified THEN 'ambiguous' ELSE 'not_available' END AS state,
  CASE WHEN note IS NULL AND reported AND ord > first THEN 'duplicate_snapshot_source_skipped' ELSE note END AS note FROM f)"""


def legal(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    k = F.col("doc_id")
    e = docs.select(
        F.col("source").alias("organisation_number"), k.alias("ord"), (k % 8 != 0).alias("allowed"), F.when(k % 9 == 1, "robots_disallowed").when(k % 9 == 2, "TimeoutError").alias("error"),
        F.sha2("text", 256).alias("body_hash"), F.col("hit").isNotNull().alias("identified"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("reported"),
    )
    names = e.select("organisation_number").unionByName(table(spark, d, "nation").select(F.col("n_name").alias("organisation_number")))
    return V.legal_outcomes(e, names)


@query("c23_legal_entries", f"WITH {LEGAL_SQL} SELECT ord, state, note FROM s")
def _c23(spark, d):
    return legal(spark, d)[0].select("ord", "state", "note")


@query(
    "c23_legal_availability",
    f"""WITH {LEGAL_SQL}, p AS (SELECT k, min(list_position([{sql_list(fixed.STATE_PRIORITY)}], state)) AS r FROM s GROUP BY k)
    SELECT k AS organisation_number, [{sql_list(fixed.STATE_PRIORITY)}][r] AS state FROM p UNION ALL SELECT n_name, 'not_available' FROM nation""",
)
def _c23a(spark, d):
    return legal(spark, d)[1].select("organisation_number", "state")


@query(
    "c24_stage_outcomes",
    """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS organisation_number, 'financials' AS field, CASE o_orderkey % 8 WHEN 1 THEN 'not_available' WHEN 2 THEN 'blocked' WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' ELSE CASE WHEN n > 0 THEN 'available' ELSE 'not_available' END END AS state,
      CASE o_orderkey % 8 WHEN 1 THEN 'http_404' WHEN 2 THEN 'http_403' WHEN 3 THEN 'http_500' WHEN 4 THEN 'accounts_response_unavailable' ELSE CASE WHEN n > 0 THEN NULL ELSE 'no_reported_financial_records' END END AS reason FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def _c24(spark, d):
    k = F.col("o_orderkey") % 8
    r = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("organisation_number"), F.when(k == 1, 404).when(k == 2, 403).when(k == 3, 500).otherwise(200).alias("http_status"), F.lit(None).cast("string").alias("error"),
        F.when(k == 4, "<html>").otherwise('{"a":1}').alias("body"),
    )
    facts = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").cast("string").alias("organisation_number"))
    return V.stage_outcomes(r, facts, "financials", "no_reported_financial_records", "accounts_response_unavailable")
