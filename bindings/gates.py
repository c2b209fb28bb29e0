"""URL, outcome, date and robots gates bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.functions import fixed, urls
from vouchlake.functions.canon import computed
from vouchlake.operators import gates as G

from .common import query, sql_list, sql_pattern, table

PARTS_SQL = r"""p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
u AS (SELECT *, 'https://' || host || CASE path WHEN '' THEN '/' ELSE path END || CASE q WHEN '' THEN '' ELSE '?' || q END AS norm FROM p)"""
LINKS_SQL = r"""l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


def links(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query(
    "p5_normalize_urls",
    rf"""WITH {PARTS_SQL}, v AS (
      SELECT page_id, 0::BIGINT AS form, norm AS norm_url, host, NULL AS reject_reason FROM u WHERE url LIKE 'https:%'
      UNION ALL SELECT page_id, 0, NULL, NULL, 'https_public_urls_only' FROM u WHERE url LIKE 'http:%'
      UNION ALL SELECT page_id, 1, norm, host, NULL FROM u
      UNION ALL SELECT page_id, 2, NULL, NULL, 'https_public_urls_only' FROM u
      UNION ALL SELECT page_id, 3, NULL, NULL, 'https_public_urls_only' FROM u
      UNION ALL SELECT page_id, 4, NULL, NULL, 'ip_literals_not_allowed' FROM u
      UNION ALL SELECT page_id, 5, NULL, NULL, 'non_public_hostname' FROM u
      UNION ALL SELECT page_id, 6, NULL, NULL, 'missing_url' FROM u
      UNION ALL SELECT page_id, 7, NULL, NULL, 'invalid_url' FROM u
      UNION ALL SELECT page_id, 8, NULL, NULL, 'invalid_hostname' FROM u
      UNION ALL SELECT page_id, 9, 'https://' || host || '/a', host, NULL FROM u) SELECT * FROM v""",
)
def _p5(spark, d):
    rest = F.regexp_replace("url", r"^https?://", "")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    p = table(spark, d, "pages").select("page_id", "url")
    forms = F.array(
        F.col("url"), F.concat(F.lit(" "), rest, F.lit("#frag")), F.concat(F.lit("https://me:pw@"), rest), F.concat(F.lit("https://"), host, F.lit(":8443/")),
        F.concat(F.lit("https://10.1.2."), (F.col("page_id") % 256).cast("string")), F.concat(F.lit("https://"), F.substring_index(host, ".", 1), F.lit(".local/")),
        F.lit("  "), F.concat(F.lit("https://"), host, F.lit("/a b")), F.concat(F.lit("https://-"), host), F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(".:443/a")),
    )
    rows = p.select("page_id", F.posexplode(forms).alias("form", "raw"))
    return urls.normalize_urls(rows, "raw").select("page_id", F.col("form").cast("bigint").alias("form"), "norm_url", "host", "reject_reason")


@query(
    "p6_host_class",
    rf"""WITH {PARTS_SQL}, h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'www.linkedin.com' WHEN 1 THEN 'my.facebook.com' ELSE host END AS host FROM p)
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'social_page' ELSE 'website' END AS kind FROM h""",
)
def _p6(spark, d):
    k = F.col("page_id")
    host = F.when(k % 3 == 0, "www.linkedin.com").when(k % 3 == 1, "my.facebook.com").otherwise(F.regexp_extract("url", r"^https?://([^/?#]+)", 1))
    return table(spark, d, "pages").select("page_id", urls.host_class(host).alias("kind"))


@query(
    "p7_url_role",
    rf"""WITH {PARTS_SQL}, r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'news_index' WHEN 1 THEN 'job_index' WHEN 2 THEN 'root' WHEN 3 THEN 'search'
      WHEN 4 THEN CASE WHEN regexp_matches(q, '(^|&)q=[^&]+') THEN 'search' ELSE 'detail' END ELSE 'detail' END AS role FROM p) SELECT * FROM r""",
)
def _p7(spark, d):
    k = F.col("page_id")
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    url = (
        F.when(k % 6 == 0, F.concat(base, F.lit("/x/Aktuelt/"))).when(k % 6 == 1, F.concat(base, F.lit("/ledige-stillinger?q="))).when(k % 6 == 2, F.concat(base, F.lit("//")))
        .when(k % 6 == 3, F.concat(base, F.lit("/find?a=1&query=x"))).when(k % 6 == 5, F.concat(base, F.lit("/find?q=&a=1"))).otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", urls.url_role(url).alias("role"))


@query(
    "p8_detail_links",
    rf"""WITH {LINKS_SQL}, t AS (SELECT page_id, href, lower(split_part(regexp_replace(regexp_replace(regexp_replace(href, '[?#].*$', ''), '^https?://[^/]*', ''), '/+$', ''), '/', -1)) AS tail FROM l)
    SELECT page_id, href, count(*) AS n FROM t WHERE tail <> '' AND tail NOT IN ({sql_list(fixed.UTILITY_TAILS)})
      AND NOT regexp_matches(tail, '{fixed.ASSET_PATTERN}') AND NOT regexp_matches(href, '[?&](q|search|query)=[^&#]') GROUP BY 1, 2""",
)
def _p8(spark, d):
    return links(spark, d).filter(urls.detail_link_allowed("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    "p9_link_priority",
    rf"""WITH {LINKS_SQL}, k AS (SELECT unnest(range({len(fixed.LINK_WORDS)})) AS i, unnest([{sql_list(fixed.LINK_WORDS)}]) AS w),
    d AS (SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2), m AS (SELECT page_id, href, n, min(i) AS hit FROM d LEFT JOIN k ON contains(lower(href), w) GROUP BY 1, 2, 3)
    SELECT page_id, href, n, coalesce(hit, {len(fixed.LINK_WORDS)}) AS priority, coalesce(hit, -1) AS story_priority FROM m""",
)
def _p9(spark, d):
    g = links(spark, d).groupBy("page_id", "href").agg(F.count("*").alias("n"))
    return g.select("page_id", "href", "n", urls.link_priority("href").cast("bigint").alias("priority"), urls.link_priority("href", story=True).cast("bigint").alias("story_priority"))


@query("p10_filter_allowlist", rf"WITH {PARTS_SQL}, a AS (SELECT host FROM p GROUP BY host HAVING count(*) > 4) SELECT page_id, host FROM p WHERE host IN (SELECT host FROM a)")
def _p10(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    return G.filter_allowlist(p, p.groupBy("host").count().filter("count > 4"), "host").select("page_id", "host")


@query(
    "p11_map_outcomes",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 404 WHEN 'click' THEN 200 WHEN 'purchase' THEN 503 ELSE 200 END AS s,
      CASE WHEN event_type NOT IN ('error','view','click','purchase') THEN 'host_rate_limited' END AS err FROM events)
    SELECT event_id, CASE WHEN err IS NOT NULL THEN 'blocked' WHEN s = 404 THEN 'not_available' WHEN s = 429 THEN 'blocked' WHEN s = 503 THEN 'failed' ELSE 'available' END AS state,
      CASE WHEN err IS NOT NULL THEN err WHEN s <> 200 THEN 'http_' || s END AS reason FROM e""",
)
def _p11(spark, d):
    kind = F.col("event_type")
    e = table(spark, d, "events").select(
        "event_id", F.when(kind == "error", 429).when(kind == "view", 404).when(kind == "purchase", 503).otherwise(200).alias("http_status"),
        F.when(~kind.isin("error", "view", "click", "purchase"), "host_rate_limited").alias("error"),
    )
    return G.map_outcomes(e).select("event_id", "state", "reason")


@query(
    "p15_is_active",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      WHERE o_orderdate <= TIMESTAMP '1998-06-01' AND l_linenumber % 3 <> 1 AND (l_linenumber % 3 = 0 OR (l_shipdate >= TIMESTAMP '1998-06-01' AND l_shipdate >= o_orderdate)) GROUP BY 1, 2""",
)
def _p15(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    # line 1, 4: an expiry that is null; 2, 5: a real one; 3, 6: none given
    expiry = F.when(F.col("l_linenumber") % 3 == 2, F.date_format("l_shipdate", "yyyy-MM-dd"))
    active = G.is_active(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), expiry, F.col("l_linenumber") % 3 != 0, F.lit("1998-06-01T10:00:00+00:00"))
    return j.filter(active).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    "p16_consensus_dates",
    """WITH e AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour, CAST(ts AS DATE) AS day, value FROM events)
    SELECT user_id, event_type, hour, CASE WHEN min(day) = max(day) AND sum(CASE WHEN value < 3 THEN 1 ELSE 0 END) = 0 AND max(day) <= DATE '2024-01-20' THEN strftime(min(day), '%Y-%m-%d') END AS published_at
    FROM e GROUP BY 1, 2, 3""",
)
def _p16(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    stamp = F.when(F.col("value") < 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return G.consensus_dates(e.select("user_id", "event_type", "hour", stamp.alias("stamp")), ["user_id", "event_type", "hour"], "stamp", F.lit("2024-01-20"))


@query(
    "p17_mentions",
    rf"""WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Søksmål med saksnummer: AB-' || doc_id || '/2024.' WHEN 1 THEN ' A lawsuit was filed.' WHEN 2 THEN ' Lawsuits differ.' ELSE '' END AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '{sql_pattern(fixed.LEGAL_TERM)}') AS hit,
      nullif(rtrim(regexp_extract(t, '{sql_pattern(fixed.CASE_REFERENCE)}', 1), './-'), '') AS case_reference FROM d""",
)
def _p17(spark, d):
    k, num = F.col("doc_id"), F.col("doc_id").cast("string")
    extra = (
        F.when(k % 4 == 0, F.concat(F.lit(" Søksmål med saksnummer: AB-"), num, F.lit("/2024."))).when(k % 4 == 1, F.lit(" A lawsuit was filed."))
        .when(k % 4 == 2, F.lit(" Lawsuits differ.")).otherwise(F.lit(""))
    )
    docs = computed(table(spark, d, "documents").select("doc_id", "text"), t=F.concat("text", extra))
    return docs.select("doc_id", G.mention("t").alias("m")).select("doc_id", "m.hit", "m.case_reference")


@query(
    "p18_safe_source",
    rf"""WITH {PARTS_SQL} SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN url LIKE 'https:%' AND url = norm
      WHEN 3 THEN true WHEN 4 THEN false ELSE true END AS safe FROM u""",
)
def _p18(spark, d):
    k = F.col("page_id") % 6
    url = (
        F.when(k == 0, F.lit("https://registry.example.org/entities/1")).when(k == 3, F.lit("https://registry.example.org:443/accounts/1"))
        .when(k == 5, F.lit("https://www.youtube.com/c")).otherwise(F.col("url"))
    )
    kind = (
        F.when(k == 0, "official_registry").when(k < 3, "verified_company_website").when(k == 3, "official_accounts").otherwise("verified_social_page")
    )
    ev = table(spark, d, "pages").select("page_id", url.alias("source_url"), kind.alias("source_class"), (k == 1).alias("synthetic"))
    return G.safe_source(ev, "https://registry.example.org/entities/", "registry.example.org").select("page_id", "safe")


@query(
    "p19_filter_robots",
    rf"""WITH {PARTS_SQL}, h AS (SELECT host, length(host) % 4 AS kind FROM p GROUP BY host)
    SELECT page_id, CASE WHEN kind = 0 THEN true WHEN kind = 3 THEN false WHEN kind = 1 THEN NOT starts_with(path, '/fr') ELSE starts_with(path, '/en') OR NOT starts_with(path, '/e') END AS allowed,
      CASE WHEN kind = 3 THEN 'robots_unavailable' WHEN kind = 1 AND starts_with(path, '/fr') THEN 'robots_disallowed'
        WHEN kind = 2 AND starts_with(path, '/e') AND NOT starts_with(path, '/en') THEN 'robots_disallowed' END AS reason,
      CASE kind WHEN 1 THEN 7.0::DOUBLE WHEN 2 THEN 5.0 ELSE 1.0 END AS delay FROM p JOIN h USING (host)""",
)
def _p19(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    kind = F.length("host") % 4
    named = "User-agent: *\nDisallow: /\n\nUser-agent: Other\nUser-agent: vouchlake # us\nCrawl-delay: 7\nDisallow: /fr\n"
    general = "User-agent: *\nAllow: /en\nDisallow: /e\nRequest-rate: 2/10\n\nUser-agent: other\nDisallow: /\n"
    robots = p.select("host").distinct().select(
        "host", F.when(kind == 0, 404).when(kind == 3, 500).otherwise(200).alias("http_status"), F.when(kind == 1, named).otherwise(general).alias("body")
    )
    return G.filter_robots(p, robots, "vouchlake").select("page_id", "allowed", "reason", "delay")


@query(
    "p20_stamp_run",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS terminal_status, 'bulk' AS source_mode, false AS synthetic, 'r1' AS run_id FROM events""",
)
def _p20(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "failed").otherwise("blocked").alias("state"))
    return G.stamp_run(e, "bulk", "r1").drop("state")
