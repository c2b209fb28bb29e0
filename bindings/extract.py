"""Extraction jobs over JSON and page documents that Spark derives from the given tables."""

from pyspark.sql import functions as F

from vouchlake.functions import urls
from vouchlake.functions.canon import computed, json_text
from vouchlake.operators import extract as X
from vouchlake.operators import walk
from vouchlake.session import spread

from .common import key_sql, org_key, query, table
from .derive import STATEMENTS_SQL, statements
from .pages import finish


def _with_org(df, key):
    return computed(df, organisation_number=org_key(F.col(key))).filter("organisation_number is not null")


def account_responses(spark, d):
    """Yearly statements as account documents, one per customer block and year (so documents stay small).

    Status P repeats 1998 with another amount when the key divides by 3 (a conflict);
    status F is repeated unchanged.
    """
    st = _with_org(spread(statements(spark, d), scan=False), "o_custkey")
    kind = F.when(F.col("report_type") == "F", "SELSKAP").when(F.col("report_type") == "O", "KONSERN").otherwise("SELSKAP")
    end = F.when(F.col("report_type") == "P", F.date_add("period_end", 0)).otherwise(F.date_sub("period_end", 1))
    rec = lambda cents: F.to_json(F.struct(
        F.struct("organisation_number").alias("virksomhet_"), F.lit("NOK ").alias("valuta"), kind.alias("regnskapstype"),
        F.struct(F.date_format("period_start", "yyyy-MM-dd").alias("fraDato"), F.date_format(end, "yyyy-MM-dd").alias("tilDato")).alias("regnskapsperiode"),
        F.struct(F.struct(F.struct(cents.alias("sumDriftsinntekter")).alias("driftsinntekter")).alias("driftsresultat"), F.col("y").alias("aarsresultat")).alias("resultatregnskapResultat"),
        F.struct(F.lit("n/a").alias("sumEiendeler")).alias("eiendeler"),
    ))
    fix = lambda c: F.replace(F.replace(c, F.lit('"virksomhet_":{"organisation_number"'), F.lit('"virksomhet":{"organisasjonsnummer"')), F.lit("~"), F.lit("~"))
    clash = (F.col("report_type") == "P") & (F.col("o_custkey") % 3 == 0)
    body = F.concat(
        F.lit('{"data":{"x":[5,"t"],"a/b":['), fix(rec(F.col("cents"))), F.lit(","), F.when(clash, fix(rec(F.col("cents") + 1))).otherwise(fix(rec(F.col("cents")))), F.lit("]}}")
    )
    return computed(st, body=body, evidence_id=F.concat_ws("-", "o_custkey", "report_type", "y"))


ACCOUNTS_SQL = f"""{STATEMENTS_SQL}, a AS (SELECT *, {key_sql('o_custkey')} AS org, CASE report_type WHEN 'O' THEN 'KONSERN' ELSE 'SELSKAP' END AS rt,
  strftime(CASE report_type WHEN 'P' THEN period_end ELSE period_end - 1 END, '%Y-%m-%d') AS e, strftime(period_start, '%Y-%m-%d') AS s, o_custkey || '-' || report_type || '-' || y AS evidence_id FROM st),
  ok AS (SELECT * FROM a WHERE org IS NOT NULL)"""


@query(
    "x3_financials",
    f"""WITH {ACCOUNTS_SQL}, m AS (SELECT *, 'revenue' AS metric, cents::VARCHAR AS amount, '/resultatregnskapResultat/driftsresultat/driftsinntekter/sumDriftsinntekter' AS tail FROM ok
      UNION ALL SELECT *, 'annual_result', y::VARCHAR, '/resultatregnskapResultat/aarsresultat' FROM ok)
    SELECT org AS organisation_number, evidence_id, 'financials:' || rt || ':' || e || ':' || metric AS subject, '/data/a~1b/1' || tail AS json_pointer, s || '/' || e AS reporting_period,
      '{{"amount":' || amount || ',"currency":"NOK","metric":"' || metric || '","organisation_number":"' || org || '","period_end":"' || e || '","period_start":"' || s || '","report_type":"' || rt || '"}}' AS value_json
    FROM m WHERE NOT (report_type = 'P' AND o_custkey % 3 = 0)""",
)
def _x3(spark, d):
    out = X.extract_financials(account_responses(spark, d))
    return out.select("organisation_number", "evidence_id", "subject", "json_pointer", "reporting_period", "value_json")


@query(
    "x4_financials_v1",
    f"""WITH {ACCOUNTS_SQL} SELECT org AS organisation_number, evidence_id, 'financials:' || rt || ':' || e AS subject,
      '{{"currency":"NOK ","organisation_number":"' || org || '","period_end":"' || e || '","period_start":"' || s || '","report_type":"' || rt || '","revenue":' || cents || '}}' AS value_json FROM ok""",
)
def _x4(spark, d):
    return X.extract_financials_v1(account_responses(spark, d)).select("organisation_number", "evidence_id", "subject", "value_json")


@query(
    "x5_roles",
    f"""WITH c AS (SELECT conv_id, turn, role, {key_sql('conv_id')} AS org FROM conversations), g AS (SELECT org, role, conv_id, min(turn) AS t FROM c WHERE org IS NOT NULL GROUP BY 1, 2, 3)
    SELECT org AS organisation_number, '{{"name":"Ada ' || conv_id || '","role":"' || role || '"}}' AS value_json, '/groups/0/' || CASE WHEN t % 2 = 0 THEN 'even' ELSE 'odd' END AS json_pointer FROM g""",
)
def _x5(spark, d):
    c = _with_org(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id")
    num = F.col("conv_id").cast("string")
    person = F.concat(F.lit('{"type":{"beskrivelse":" '), "role", F.lit(' "},"person":{"fodselsnummer":"1","navn":{"fornavn":" Ada ","mellomnavn":" ","etternavn":"'), num, F.lit('"}}}'))
    # a document per turn: the first speaker of a role wins, later copies collapse
    body = F.concat(F.lit('{"groups":[{"'), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd"), F.lit('":'), person, F.lit(',"zz":'), person, F.lit("},{}]}"))
    docs = computed(c, body=body, evidence_id=F.concat_ws("/", "conv_id", "turn"))
    out = X.extract_roles(docs).withColumn("turn", F.split("evidence_id", "/")[1].cast("int"))
    from vouchlake.operators.windows import keep_first

    return keep_first(out, ["organisation_number", "value_json"], [F.col("turn")]).select("organisation_number", "value_json", "json_pointer")


@query(
    "x6_locations",
    f"""WITH s AS (SELECT s_suppkey, s_name, n_name, {key_sql('s_nationkey')} AS org FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT org AS organisation_number, 'location:' || (800000000 + s_suppkey) AS subject, '/_embedded/underenheter/1' AS json_pointer,
      '{{"address":{{"kommune":"' || n_name || '"}},"employees":' || CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 9)::VARCHAR ELSE 'null' END || ',"name":"' || s_name || '","organisation_number":"' || (800000000 + s_suppkey) || '"}}' AS value_json
    FROM s WHERE org IS NOT NULL AND s_suppkey % 5 <> 0""",
)
def _x6(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = _with_org(s, "s_nationkey")
    k = F.col("s_suppkey")
    unit = lambda parent: F.to_json(F.struct(
        (k + 800000000).cast("string").alias("organisasjonsnummer"), parent.alias("overordnetEnhet"), F.col("s_name").alias("navn"),
        F.when(k % 3 == 0, F.struct(F.lit(None).cast("string").alias("kommune"))).otherwise(F.struct(F.col("n_name").alias("kommune"))).alias("beliggenhetsadresse"),
        F.struct(F.col("n_name").alias("kommune")).alias("forretningsadresse"), F.when(k % 2 == 0, k % 9).alias("antallAnsatte"),
    ))
    parent = F.when(k % 5 == 0, F.lit("999999999")).otherwise(F.col("organisation_number"))
    body = F.concat(F.lit('{"_embedded":{"underenheter":[{"navn":"no number"},'), unit(parent), F.lit(","), unit(parent), F.lit("]}}"))
    docs = computed(s, body=body, evidence_id=F.col("s_suppkey").cast("string"))
    return X.extract_locations(docs).select("organisation_number", "subject", "json_pointer", "value_json")


def nested_props(spark, d):
    """events.props wrapped in lists and graphs."""
    e = spread(table(spark, d, "events")).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    ld = F.concat(F.lit('{"@type":"Top","@graph":[{"@type":["'), "event_type", F.lit('","X"],"k":'), "k", F.lit(',"a/b":{"~c":[true,"'), F.col("event_type"), F.lit('"]}},[{"@type":"http://schema.org/'), "event_type", F.lit('"}],7]}'))
    return computed(e, ld=ld)


NODES_SQL = """e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT event_id, '' AS pointer, 'Top' AS t, NULL::BIGINT AS k FROM e UNION ALL SELECT event_id, '/@graph/0', event_type, k FROM e UNION ALL SELECT event_id, '/@graph/1/0', 'http://schema.org/' || event_type, NULL FROM e)"""


@query("x8_schema_nodes", f"WITH {NODES_SQL} SELECT event_id, 0::BIGINT AS block, pointer, t AS first_type, k FROM n")
def _x8(spark, d):
    e = walk.schema_nodes(nested_props(spark, d).select("event_id", F.array("ld").alias("json_ld")))
    rows = walk.explode_nodes(e, ["event_id"])
    return rows.select("event_id", F.col("block").cast("bigint").alias("block"), "pointer", F.try_element_at(walk.node_types(F.col("node")), F.lit(1)).alias("first_type"),
                       F.get_json_object("node_json", "$.k").cast("bigint").alias("k"))


@query("x9_filter_type", f"WITH {NODES_SQL} SELECT event_id, pointer FROM n WHERE t IN ('click', 'http://schema.org/click')")
def _x9(spark, d):
    e = walk.schema_nodes(nested_props(spark, d).select("event_id", F.array("ld").alias("json_ld")))
    rows = walk.explode_nodes(e, ["event_id"])
    return rows.filter(walk.has_type(F.col("node"), ["click", "http://schema.org/click"])).select("event_id", "pointer")


WALK_SQL = """e AS (SELECT event_id, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
w AS (SELECT event_id, unnest(['/@type', '/@graph/0/@type/0', '/@graph/0/@type/1', '/@graph/0/k', '/@graph/0/a~1b/~0c/0', '/@graph/0/a~1b/~0c/1', '/@graph/1/0/@type', '/@graph/2']) AS pointer,
  unnest(['"Top"', '"' || t || '"', '"X"', k::VARCHAR, 'true', '"' || t || '"', '"http://schema.org/' || t || '"', '7']) AS node_json FROM e)"""


@query("x10_walk_json", f"WITH {WALK_SQL} SELECT * FROM w")
def _x10(spark, d):
    rows = walk.walk_json(nested_props(spark, d), "ld", ["event_id"], only_objects=False)
    return rows.filter(~F.col("node_json").rlike(r"\A[\[{]")).select("event_id", "pointer", "node_json")


@query(
    "x11_resolve_pointers",
    f"""WITH {WALK_SQL}, c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '/@graph/0/k' WHEN 1 THEN '/@graph/0/a~1b/~0c/1' ELSE '/@graph/9' END AS json_pointer FROM e)
    SELECT c.event_id, json_pointer, node_json AS resolved_json FROM c LEFT JOIN w ON c.event_id = w.event_id AND json_pointer = pointer""",
)
def _x11(spark, d):
    e = nested_props(spark, d)
    k = F.col("event_id") % 3
    claims = e.select("event_id", F.when(k == 0, "/@graph/0/k").when(k == 1, "/@graph/0/a~1b/~0c/1").otherwise("/@graph/9").alias("json_pointer"))
    return walk.resolve_pointers(claims, walk.walk_json(e, "ld", ["event_id"], only_objects=False), ["event_id"])


def owned_page(spark, d, variants, head, body, path="/detail/1"):
    """Pages owned by a labelled number, with a head and body per situation (customer id mod variants)."""
    c = _with_org(spread(table(spark, d, "customer")).select("c_custkey", F.col("c_name").alias("legal_name")), "c_custkey")
    c = computed(c, v=F.col("c_custkey") % variants)
    html = F.concat(F.lit("<html><head><title>Page</title>"), head(c), F.lit("</head><body><p>"), F.col("legal_name"), F.lit(" org nr "), F.col("organisation_number"), F.lit("</p>"), body(c), F.lit("</body></html>"))
    url = F.concat(F.lit("https://c"), F.col("c_custkey").cast("string"), F.lit(".example.com"), F.lit(path) if isinstance(path, str) else path(c))
    rows = computed(c, html=html, page_url=url, is_root=F.lit(True), retrieved_at=F.lit("2024-01-16T00:00:00+00:00"))
    return finish(spark, rows)


BASE_SQL = "c AS (SELECT c_custkey AS k, c_name AS name, {key} AS org, c_custkey % {n} AS v FROM customer)"


@query(
    "x12_description",
    f"""WITH {BASE_SQL.format(key=key_sql('c_custkey'), n=5)} SELECT org AS organisation_number, 'company_description:https://c' || k || '.example.com/detail/1' AS subject,
      '"We build ' || name || ' machines for every harbour & port."' AS value_json FROM c WHERE org IS NOT NULL AND v IN (0, 2)""",
)
def _x12(spark, d):
    def head(c):
        v, text = F.col("v"), F.concat(F.lit("We build  "), F.col("legal_name"), F.lit(" machines for every harbour &amp; port."))
        meta = lambda key, value: F.concat(F.lit('<meta name="'), F.lit(key), F.lit('" content="'), value, F.lit('">'))
        return (
            F.when(v == 0, meta("Description", text)).when(v == 1, F.concat(meta("description", text), meta("og:description", F.concat(text, F.lit("!")))))
            .when(v == 2, F.concat(meta("description", text), meta("twitter:description", text))).when(v == 3, meta("description", F.lit("Short"))).otherwise("")
        )

    return X.extract_description(owned_page(spark, d, 5, head, lambda c: F.lit(""))).select("organisation_number", "subject", "value_json")


@query(
    "x14_jobs",
    f"""WITH {BASE_SQL.format(key=key_sql('c_custkey'), n=9)} SELECT org AS organisation_number, 'jobs:https://c' || k || '.example.com/detail/1:{{"datePosted":"2024-01-02","jobLocation":null,"title":"Welder ' || k || '"}}' AS subject,
      '2024-01-02' AS effective_date, '/@graph/1' AS json_pointer, 0::BIGINT AS json_ld_block FROM c WHERE org IS NOT NULL AND v IN (0, 8)""",
)
def _x14(spark, d):
    v = F.col("v")
    text = F.lit("You weld the hulls of very large ships in a cold harbour.")

    def head(c):
        employer = F.when(v == 1, F.lit("Other AS")).otherwise(F.col("legal_name"))
        posted = F.when(v == 2, "2024-02-01").otherwise("2024-01-02")
        expiry = F.when(v == 3, F.lit(',"validThrough":"2024-01-10"')).when(v == 4, F.lit(',"validThrough":null')).when(v == 0, F.lit(',"validThrough":"2024-02-01T23:00:00+00:00"')).otherwise("")
        job = F.concat(
            F.lit('{"@type":"JobPosting","url":"'), F.concat(F.lit("https://C"), F.col("c_custkey").cast("string"), F.lit(".example.com/detail/1")), F.lit('","title":"Welder '), F.col("c_custkey").cast("string"),
            F.lit('","description":"<p>You weld the hulls of very large ships</p> in a cold harbour.","datePosted":"'), posted, F.lit('"'), expiry,
            F.lit(',"hiringOrganization":{"name":"x","legalName":"'), employer, F.lit('","taxID":"'), F.col("organisation_number"), F.lit('"}}'),
        )
        second = F.when(v == 5, F.replace(job, F.lit("Welder"), F.lit("Painter"))).when(v == 8, job).otherwise("{}")
        return F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Thing"},'), job, F.lit(","), second, F.lit("]}</script>"))

    p = owned_page(spark, d, 9, head, lambda c: F.concat(F.lit("<p>"), F.when(v == 6, F.lit("Nothing open")).otherwise(text), F.lit("</p>")), lambda c: F.when(v == 7, F.lit("/jobs")).otherwise(F.lit("/detail/1")))
    return X.extract_jobs(p).select("organisation_number", "subject", "effective_date", "json_pointer", F.col("json_ld_block").cast("bigint").alias("json_ld_block"))


def news_pages(spark, d):
    v, name = F.col("v"), F.col("legal_name")

    def head(c):
        when = F.when(v == 5, "2024-03-01").otherwise("2024-01-05")
        about = F.when(v == 6, F.lit("")).otherwise(F.concat(F.lit(',"about":{"@type":"Organization","name":"'), F.when(v == 2, F.lit("Other AS")).otherwise(name), F.lit('"}')))
        date = F.when(v == 1, F.lit("")).otherwise(F.concat(F.lit(',"datePublished":"'), when, F.lit('"')))
        head_text = F.when(v == 7, F.lit("A headline nobody can see")).otherwise(F.lit("New crane in the harbour"))
        node = F.concat(
            F.lit('<script type="application/ld+json">{"@type":"NewsArticle","@id":"https://c'), F.col("c_custkey").cast("string"), F.lit('.example.com/detail/1","headline":"'), head_text, F.lit('"'), date, about,
            F.lit(',"articleBody":"It lifts."}</script>'),
        )
        return F.when(v.isin(3, 4), F.lit("")).otherwise(node)

    def body(c):
        time = F.when(v.isin(4), F.lit("")).otherwise(F.lit('<time datetime="2024-01-05T08:00:00+00:00">5 Jan</time>'))
        art = F.concat(F.lit("<article><h1>New crane in the harbour</h1>"), time, F.lit("<p>"), name, F.lit(" has bought a crane for the quay. It lifts. It is blue and taller than the church.</p></article>"))
        return F.when(v == 8, F.concat(art, art)).otherwise(art)

    return owned_page(spark, d, 9, head, body)


NEWS_SQL = BASE_SQL.format(key=key_sql("c_custkey"), n=9)


@query(
    "x15_news",
    f"""WITH {NEWS_SQL} SELECT org AS organisation_number, CASE WHEN v = 0 THEN 'json_ld_news_v1' ELSE 'visible_html_news_v1' END AS extraction_method, '2024-01-05' AS effective_date,
      'news:https://c' || k || '.example.com/detail/1' AS subject, CASE WHEN v = 0 THEN '{{"@id":"https://c' || k || '.example.com/detail/1","@type":"NewsArticle","about":{{"@type":"Organization","name":"' || name || '"}},"articleBody":"It lifts.","datePublished":"2024-01-05","headline":"New crane in the harbour"}}'
      ELSE '{{"articleBody":"New crane in the harbour 5 Jan ' || name || ' has bought a crane for the quay. It lifts. It is blue and taller than the church.","datePublished":"2024-01-05","headline":"New crane in the harbour"}}' END AS value_json
    FROM c WHERE org IS NOT NULL AND v IN (0, 1, 3, 6, 7)""",
)
def _x15(spark, d):
    return X.extract_news(news_pages(spark, d)).select("organisation_number", "extraction_method", "effective_date", "subject", "value_json")


@query("x16_visible_news", f"WITH {NEWS_SQL} SELECT org AS organisation_number, v IN (1, 3, 6, 7) AS visible FROM c WHERE org IS NOT NULL AND v <> 8")
def _x16(spark, d):
    return X.news_decisions(news_pages(spark, d)).select("organisation_number", (F.col("decision") == "visible").alias("visible"))


def legal_pages(spark, d):
    """Reports on a company: news in an article, or a filing page."""
    v, name = F.col("v"), F.col("legal_name")

    def head(c):
        meta = F.when(v == 5, F.lit('<meta property="article:published_time" content="2024-01-04">')).otherwise(F.lit('<meta property="article:published_time" content="2024-01-05">'))
        node = F.concat(F.lit('<script type="application/ld+json">{"@type":"Article","url":"https://c'), F.col("c_custkey").cast("string"), F.lit('.example.com/detail/1","headline":"Dispute over a crane","datePublished":"2024-01-05"}</script>'))
        return F.concat(meta, F.when(v.isin(2, 3), F.lit("")).otherwise(node))

    def body(c):
        who = F.when(v == 4, F.lit("Someone")).otherwise(F.concat(name, F.lit(" (org nr "), F.col("organisation_number"), F.lit(")")))
        act = F.when(v.isin(1, 3), F.lit(" was sold.")).otherwise(F.lit(" was sued, case no. AB-12/2024."))
        return F.concat(F.lit("<article><p>Dispute over a crane. "), who, act, F.lit("</p></article>"))

    return owned_page(spark, d, 6, head, body).withColumn("kind", F.when(v.isin(2, 3), "filing").otherwise("news"))


@query(
    "x17_legal",
    f"""WITH {BASE_SQL.format(key=key_sql('c_custkey'), n=6)}, p AS (SELECT *, 'Page ' || name || ' org nr ' || org || ' ' AS pre, 'Dispute over a crane. ' || name || ' (org nr ' || org || ') was sued, case no. AB-12/2024.' AS art FROM c WHERE org IS NOT NULL AND v IN (0, 2))
    SELECT org AS organisation_number, CASE WHEN v = 2 THEN 0 ELSE length(pre) END::BIGINT AS span_start, length(pre || art)::BIGINT AS span_end, '2024-01-05' AS effective_date,
      '{{"case_reference":"AB-12/2024","court_outcome":null,"interpretation":"source_report_only","published_at":"2024-01-05","reported_text":"' || CASE WHEN v = 2 THEN pre || art ELSE art END || '","source_kind":"' || CASE WHEN v = 2 THEN 'filing' ELSE 'news' END || '"}}' AS value_json FROM p""",
)
def _x17(spark, d):
    out = X.extract_legal(legal_pages(spark, d))
    return out.select("organisation_number", F.col("text_span.start").cast("bigint").alias("span_start"), F.col("text_span.end").cast("bigint").alias("span_end"), "effective_date", "value_json")


@query(
    "x19_claim_excerpts",
    """WITH c AS (SELECT doc_id, text, doc_id % 4 AS v, length(text) AS n FROM documents)
    SELECT doc_id, CASE v WHEN 0 THEN CASE WHEN n > 5 THEN substr(text, 6) ELSE '"not in the text"' END WHEN 1 THEN '"' || lang_ || '"' WHEN 2 THEN text ELSE '"not in the text"' END AS excerpt FROM (SELECT c.*, lang AS lang_ FROM c JOIN documents USING (doc_id))""",
)
def _x19(spark, d):
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % 4
    ev = docs.select(
        F.col("doc_id").cast("string").alias("evidence_id"), F.when(k == 1, F.to_json(F.struct(F.array(F.struct("lang")).alias("a/b")))).otherwise(F.col("text")).alias("body"),
        (k == 1).alias("is_json"), F.when(k != 1, F.col("text")).alias("text"), F.lit(None).cast("array<string>").alias("json_ld"),
    )
    span = F.struct(F.lit(5).alias("start"), F.char_length("text").cast("int").alias("end"))
    claims = docs.select(
        F.lit("x").alias("organisation_number"), F.col("doc_id").cast("string").alias("claim_id"), F.col("doc_id").cast("string").alias("evidence_id"),
        F.when(k == 1, "/a~1b/0/lang").alias("json_pointer"), F.lit(None).cast("int").alias("json_ld_block"), F.when(k == 0, span).alias("text_span"),
        F.when(k == 2, json_text("text")).otherwise(F.lit('"not in the text"')).alias("value_json"),
    )
    return X.claim_excerpts(claims, ev).select(F.col("claim_id").cast("bigint").alias("doc_id"), "excerpt")
