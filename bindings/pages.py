"""Page parsing and identity proofs: the given pages, and company pages derived from customers."""

from pyspark.sql import functions as F

from vouchlake.functions.canon import computed
from vouchlake.operators import extract as X
from vouchlake.session import spread
from vouchlake.operators import identity, pages as P, walk

from .common import key_sql, org_key, query, table

CLEAN = r"trim(regexp_replace({}, '[\s\x{{1c}}-\x{{1f}}\p{{Z}}]+', ' ', 'g'))"
STRIP = r"replace(replace(replace(replace(regexp_replace(regexp_replace({}, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def clean(x):
    return CLEAN.format(STRIP.format(x))


@query(
    "x7_page_features",
    rf"""SELECT page_id, sha256({clean('html')}) AS text_hash, {clean("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")} AS article,
      {clean("regexp_extract(html, '(?is)<article[^>]*>.*?<h1[^>]*>(.*?)</h1>', 1)")} AS article_heading, {clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
      len(regexp_extract_all(html, '<a href="'))::BIGINT AS n_links, 0::BIGINT AS n_ld FROM pages""",
)
def _x7(spark, d):
    p = P.page_features(spread(table(spark, d, "pages")))
    return p.select(
        "page_id", F.sha2("text", 256).alias("text_hash"), F.element_at("article_texts", 1).alias("article"), F.element_at("article_headings", 1).alias("article_heading"),
        F.element_at("headings", 1).alias("title"), F.size("links").cast("bigint").alias("n_links"), F.size("json_ld").cast("bigint").alias("n_ld"),
    )


def spaced(col):
    return F.concat_ws(" ", F.substring(col, 1, 3), F.substring(col, 4, 3), F.substring(col, 7, 3))


def finish(spark, rows):
    """Parse, walk and prove pages with the columns the extractors expect."""
    rows = computed(rows, evidence_id=F.sha2("html", 256))
    return identity.prove(walk.schema_nodes(P.page_features(rows)), strict="strict" if "strict" in rows.columns else None)


def company_pages(spark, d):
    """One page per valid customer in twelve situations (customer id mod 12)."""
    c = spread(table(spark, d, "customer")).select("c_custkey", F.col("c_name").alias("legal_name"))
    c = computed(c, organisation_number=org_key(F.col("c_custkey")), v=F.col("c_custkey") % 12).filter("organisation_number is not null")
    name, org, v = F.col("legal_name"), F.col("organisation_number"), F.col("v")
    h1 = F.when(v.isin(3, 8, 9), name).when(v == 10, F.concat(name, F.lit(" Group"))).otherwise("Home page")
    para = (
        F.when(v == 0, F.concat(name, F.lit(", org.nr: "), spaced(org))).when(v == 1, F.concat(name, F.lit(", organisasjonsnummer 999999999")))
        .when(v == 2, F.concat(name, F.lit(" org nr "), org, F.lit(" and org nr 999999999"))).when(v == 4, F.concat(F.lit("About "), F.upper(name)))
        .when(v == 5, F.concat(F.lit("Org.nr. "), org, F.lit(" only"))).when(v.isin(6, 7), F.concat(name, F.lit(" org.nr: "), org))
        .when(v == 10, F.concat(F.lit("We are "), name)).otherwise("Nothing else")
    )
    ld = (
        F.when(v == 6, F.concat(F.lit('{"@type":["Thing","http://schema.org/Organization"],"legalName":"'), name, F.lit('","taxID":"NO '), org, F.lit('"}')))
        .when(v == 7, F.lit('{"@type":"Organization","name":"Other AS"}'))
        .when(v == 8, F.concat(F.lit('{"@graph":[{"@type":"WebSite","publisher":{"@id":"#o"}},{"@type":"Thing","@id":"#o","name":"'), name, F.lit('"}]}')))
        .when(v == 9, F.lit('[{"@type":"WebSite","publisher":{"@id":"#missing"}}]')).otherwise(F.lit("{broken"))
    )
    html = F.concat(
        F.lit("<html><head><title>Welcome</title><script type='application/ld+json'>"), ld, F.lit("</script></head><body><nav><a href='/news'>News</a></nav><!-- org nr 111111111 --><h1>"),
        h1, F.lit("</h1><p>"), para, F.lit("</p><script>var org='org nr 111111111';</script></body></html>"),
    )
    rows = computed(c, html=html, page_url=F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.com/")), is_root=F.col("c_custkey") % 2 == 0)
    return rows.withColumn("retrieved_at", F.lit("2024-01-16T00:00:00+00:00"))


COMPANY_SQL = f"""c AS (SELECT c_custkey, c_name AS name, {key_sql('c_custkey')} AS org, c_custkey % 12 AS v FROM customer),
t AS (SELECT *, CASE WHEN v IN (3, 8, 9) THEN name WHEN v = 10 THEN name || ' Group' ELSE 'Home page' END AS h1,
  CASE WHEN v = 0 THEN name || ', org.nr: ' || org[1:3] || ' ' || org[4:6] || ' ' || org[7:9] WHEN v = 1 THEN name || ', organisasjonsnummer 999999999'
    WHEN v = 2 THEN name || ' org nr ' || org || ' and org nr 999999999' WHEN v = 4 THEN 'About ' || upper(name) WHEN v = 5 THEN 'Org.nr. ' || org || ' only'
    WHEN v IN (6, 7) THEN name || ' org.nr: ' || org WHEN v = 10 THEN 'We are ' || name ELSE 'Nothing else' END AS para FROM c WHERE org IS NOT NULL),
x AS (SELECT *, 'Welcome News ' || h1 || ' ' || para AS text, CASE WHEN v = 0 THEN 'org.nr: ' || org[1:3] || ' ' || org[4:6] || ' ' || org[7:9]
    WHEN v IN (6, 7) THEN 'org.nr: ' || org WHEN v = 5 THEN 'Org.nr. ' || org END AS label FROM t),
s AS (SELECT *, CASE WHEN label IS NOT NULL THEN strpos(text, label) - 1 END AS ls, CASE WHEN v IN (3, 8, 9) THEN strpos(text, name) - 1 WHEN v = 4 THEN strpos(text, upper(name)) - 1 END AS hs FROM x),
proofs AS (SELECT *, CASE WHEN v IN (0, 6, 7) THEN ls END AS id_start, CASE WHEN v IN (0, 5, 6) THEN ls WHEN v IN (3, 4, 8) THEN hs END AS owner_start,
  CASE WHEN v IN (0, 5, 6) THEN ls + length(label) WHEN v IN (3, 4, 8) THEN hs + length(name) END AS owner_end,
  CASE WHEN v IN (0, 5, 6, 7) THEN ls WHEN v IN (3, 8, 9) THEN hs END AS social_start FROM s)"""


@query("p12_gate_identity", f"WITH {COMPANY_SQL} SELECT org AS organisation_number, id_start AS span_start, (id_start + length(label))::BIGINT AS span_end FROM proofs")
def _p12(spark, d):
    p = finish(spark, company_pages(spark, d))
    return p.select("organisation_number", F.col("identity_span.start").cast("bigint").alias("span_start"), F.col("identity_span.end").cast("bigint").alias("span_end"))


@query(
    "p13_gate_owner",
    f"""WITH {COMPANY_SQL}, b AS (SELECT false AS strict UNION ALL SELECT true)
    SELECT org AS organisation_number, strict, CASE WHEN NOT strict OR v NOT IN (3, 4) THEN owner_start END AS span_start, CASE WHEN NOT strict OR v NOT IN (3, 4) THEN owner_end END AS span_end FROM proofs, b""",
)
def _p13(spark, d):
    rows = company_pages(spark, d).withColumn("strict", F.explode(F.array(F.lit(False), F.lit(True))))
    p = finish(spark, rows)
    return p.select("organisation_number", "strict", F.col("owner_span.start").cast("bigint").alias("span_start"), F.col("owner_span.end").cast("bigint").alias("span_end"))


@query("p14_gate_social", f"WITH {COMPANY_SQL} SELECT org AS organisation_number, social_start AS span_start FROM proofs")
def _p14(spark, d):
    return finish(spark, company_pages(spark, d)).select("organisation_number", F.col("social_span.start").cast("bigint").alias("span_start"))


@query(
    "x13_passages",
    f"""WITH {COMPANY_SQL}, w AS (SELECT *, greatest(owner_start - 150, 0) AS a, least(owner_end + 150, length(text)) AS b,
      CASE WHEN c_custkey % 2 = 0 THEN 'website_identity' ELSE 'company_page' END AS field, 'https://c' || c_custkey || '.example.com/' AS url FROM proofs WHERE owner_start IS NOT NULL)
    SELECT org AS organisation_number, field, field || ':' || url AS subject, '"' || substr(text, a + 1, b - a) || '"' AS value_json, a::BIGINT AS span_start,
      sha256(org || field || url || substr(text, a + 1, b - a)) AS claim_id FROM w""",
)
def _x13(spark, d):
    out = X.extract_passages(finish(spark, company_pages(spark, d)))
    return out.select("organisation_number", "field", "subject", "value_json", F.col("text_span.start").cast("bigint").alias("span_start"), "claim_id")


@query(
    "x18_social",
    f"""WITH {COMPANY_SQL} SELECT org AS organisation_number, 'social_pages:https://c' || c_custkey || '.example.com/' AS subject,
      sha256(org || 'social_pages' || 'https://c' || c_custkey || '.example.com/') AS claim_id FROM proofs WHERE social_start IS NOT NULL""",
)
def _x18(spark, d):
    return X.extract_social(finish(spark, company_pages(spark, d))).select("organisation_number", "subject", "claim_id")
