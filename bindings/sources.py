"""Sources and sinks bound to the given tables."""

from pyspark.sql import functions as F

from vouchlake.functions import fixed, urls
from vouchlake.functions.canon import computed, json_text
from vouchlake.session import scratch
from vouchlake.sinks import tables as K
from vouchlake.sources import bulk, inputs, landing

from .common import key_sql, org_key, query, table


@query(
    "s1_input_lines",
    """WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"organisation_number":"' || doc_id || '"}' WHEN 1 THEN '{"organisasjonsnummer":' || doc_id || '}'
        WHEN 2 THEN 'null' WHEN 3 THEN '{"other":1}' ELSE '{broken' END || chr(10) || chr(10) || text AS body FROM documents),
    l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split_regex(body, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a FROM t))
    SELECT doc_id, line_no, CASE WHEN line_no = 0 AND doc_id % 5 < 2 THEN doc_id::VARCHAR WHEN line_no = 0 AND doc_id % 5 < 4 THEN ''
      ELSE trim(line, ' ' || chr(9)) END AS organisation_number FROM l WHERE trim(line, ' ' || chr(9)) <> ''""",
)
def _s1(spark, d):
    docs = table(spark, d, "documents")
    k, num = F.col("doc_id"), F.col("doc_id").cast("string")
    first = (
        F.when(k % 5 == 0, F.concat(F.lit('{"organisation_number":"'), num, F.lit('"}')))
        .when(k % 5 == 1, F.concat(F.lit('{"organisasjonsnummer":'), num, F.lit("}")))
        .when(k % 5 == 2, F.lit("null")).when(k % 5 == 3, F.lit('{"other":1}')).otherwise(F.lit("{broken"))
    )
    lines = docs.select("doc_id", F.concat(first, F.lit("\n\n"), "text").alias("body"))
    return inputs.parse_input_lines(lines, "body", ["doc_id"]).withColumn("line_no", F.col("line_no").cast("bigint"))


@query(
    "s2_read_bulk_csv",
    f"""SELECT {key_sql('c_custkey')} AS organisasjonsnummer, c_name AS navn, c_mktsegment AS "naeringskode1.beskrivelse"
      FROM customer WHERE {key_sql('c_custkey')} IS NOT NULL AND c_nationkey < 12""",
)
def _s2(spark, d):
    c = table(spark, d, "customer").select(
        org_key(F.col("c_custkey")).alias("organisasjonsnummer"), F.col("c_name").alias("navn"),
        F.col("c_mktsegment").alias("naeringskode1.beskrivelse"), F.col("c_nationkey").alias("nation"),
    ).filter("organisasjonsnummer is not null")
    path = scratch(spark, "csv")
    c.write.csv(path, sep=";", header=True)
    wanted = c.filter("nation < 12").select("organisasjonsnummer")
    out = bulk.assert_unique_keys(bulk.read_bulk_csv(spark, path, wanted))
    return out.drop("nation", "_corrupt")


@query(
    "s3_bulk_jsonl",
    """SELECT conv_id::VARCHAR || '/' || turn AS organisasjonsnummer, '{"organisasjonsnummer":"' || conv_id || '/' || turn || '","role":"' || role || '"}' AS record_json
      FROM conversations WHERE role = 'user'""",
)
def _s3(spark, d):
    c = table(spark, d, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    lines = c.select(F.to_json(F.struct(F.col("role"), F.col("key").alias("organisasjonsnummer"))).alias("value"))
    return bulk.parse_bulk_jsonl(lines, "value", c.filter("role = 'user'").select("key"))


@query(
    "s1_read_inputs",
    """SELECT row_number() OVER (ORDER BY CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END, c_custkey) - 1 AS input_index, c_custkey::VARCHAR AS organisation_number
      FROM customer""",
)
def _s1_files(spark, d):
    """Real files: plain ones and packed ones, as text and as JSON lines."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") < 12).alias("plain"))
    num = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 2 == 0, num).otherwise(F.concat(F.lit('{"organisation_number":"'), num, F.lit('"}')))
    path = scratch(spark, "inputs")
    for name, side, codec in (("a", "plain", "none"), ("b", "not plain", "gzip")):
        rows = c.filter(side).repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
        rows.select(line.alias("value")).write.text(f"{path}/{name}", compression=codec)
    return inputs.read_inputs(spark, f"{path}/*").select(F.col("input_index").cast("bigint").alias("input_index"), "organisation_number")


@query("s4_duplicate_keys", "SELECT o_custkey, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
def _s4(spark, d):
    return bulk.duplicate_keys(table(spark, d, "orders"), "o_custkey")


@query(
    "s5_nest_dotted_columns",
    """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'invalid_bulk_boolean' WHEN c_custkey % 17 = 0 THEN 'invalid_bulk_employee_count' END AS record_error,
      CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 THEN '{' || CASE WHEN c_custkey % 4 <> 0 THEN '"antallAnsatte":' || c_nationkey || ',' ELSE '' END
        || CASE WHEN c_custkey % 3 <> 0 THEN '"forretningsadresse":{"land":"NO","poststed":"' || c_mktsegment || '"},' ELSE '' END
        || '"konkurs":' || CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END || ',"navn":"' || c_name || '"}' END AS record_json FROM customer""",
)
def _s5(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("navn"),
        F.when(k % 13 == 0, "maybe").when(F.col("c_acctbal") < 0, "TRUE").otherwise("false").alias("konkurs"),
        F.when(k % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("forretningsadresse.poststed"),
        F.when(k % 3 != 0, "NO").otherwise("").alias("forretningsadresse.land"),
        F.when(k % 17 == 0, "-4").when(k % 4 != 0, F.col("c_nationkey").cast("string")).otherwise("").alias("antallAnsatte"),
    )
    names = [n for n in c.columns if n != "c_custkey"]
    return bulk.nest_dotted_columns(c, names, ["c_custkey"])


@query(
    "s6_wrap_unwrap",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'invalid_bulk_file_hash' WHEN 2 THEN 'unknown_bulk_encoding' END AS unwrap_error,
      CASE WHEN p_partkey % 5 NOT IN (1, 2) THEN '{"brand":"' || p_brand || '","size":' || p_size || '}' END AS record_json FROM part""",
)
def _s6(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).alias("record"))
    h = F.when(k % 5 == 1, F.lit("zz")).otherwise(F.sha2(F.col("p_partkey").cast("string"), 256))
    wrapped = bulk.wrap_bulk(p, "record", h, "csv").withColumn("body", F.when(k % 5 == 2, F.replace("body", F.lit('"csv"'), F.lit('"xml"'))).otherwise(F.col("body")))
    return bulk.unwrap_bulk(wrapped).select("p_partkey", "unwrap_error", "record_json")


@query(
    "s6_read_bulk",
    f"""WITH l AS (SELECT c_nationkey % 5 AS g, c_custkey, {key_sql('c_custkey')} AS k, '{{"navn":"' || c_name || '","organisasjonsnummer":"' || {key_sql('c_custkey')} || '"}}' AS line FROM customer),
    h AS (SELECT g, sha256(string_agg(line || chr(10), '' ORDER BY c_custkey)) AS file_sha256 FROM l GROUP BY g)
    SELECT k AS organisasjonsnummer, 'jsonl' AS encoding, file_sha256, line AS record_json FROM l JOIN h USING (g) WHERE c_custkey % 3 <> 0""",
)
def _s6_files(spark, d):
    """Five files of JSON lines on disk, each row with the hash of the file it stands in."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("g"), F.col("c_name").alias("navn"), org_key(F.col("c_custkey")).alias("organisasjonsnummer"))
    lines = c.repartition("g").sortWithinPartitions("g", "c_custkey").select("g", F.to_json(F.struct("navn", "organisasjonsnummer")).alias("value"))
    path = scratch(spark, "bulk")
    lines.write.partitionBy("g").text(path)
    out = bulk.read_bulk(spark, f"{path}/g=*", c.filter("c_custkey % 3 <> 0").select("organisasjonsnummer"))
    return out.select("organisasjonsnummer", "encoding", "file_sha256", "record_json")


@query(
    "s7_mark_oversize",
    "SELECT page_id, CASE WHEN strlen(html) * 40 > 1000000 THEN 'response_size_limit' END AS size_error FROM pages",
)
def _s7(spark, d):
    p = table(spark, d, "pages").select("page_id", F.repeat("html", 40).alias("body"))
    return landing.mark_oversize(p, "body", F.lit(True), fixed.HTML_BODY_LIMIT).select("page_id", "size_error")


@query(
    "s8_check_manifest",
    f"""WITH e AS (SELECT {key_sql('o_custkey')} AS k, (80000000 + o_custkey)::VARCHAR AS stem, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord,
        o_orderkey, o_custkey, 'https://court.example.org/' || (o_orderkey % 7)::VARCHAR AS url, CASE WHEN o_orderkey % 19 = 0 THEN 'blog' WHEN o_orderkey % 2 = 0 THEN 'news' ELSE 'filing' END AS kind,
        o_orderkey % 23 <> 0 AS reviewed FROM orders),
    w AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, min(ord) OVER (PARTITION BY o_custkey, url) AS f FROM e)
    SELECT coalesce(k, stem || '0') AS organisation_number, ord, url, kind, CASE WHEN k IS NULL OR n > 5 THEN 'invalid_legal_source_company_or_limit'
      WHEN kind = 'blog' OR NOT reviewed THEN 'legal_source_requires_kind_and_access_review' WHEN ord > f THEN 'duplicate_legal_source_url' END AS fault FROM w""",
)
def _s8(spark, d):
    from vouchlake.operators.windows import numbered

    o, k = table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey")
    o = numbered(o, ["o_orderkey"], "ord", keys=["o_custkey"])
    stem = (F.col("o_custkey") + 80000000).cast("string")
    e = o.select(
        F.coalesce(org_key(F.col("o_custkey")), F.concat(stem, F.lit("0"))).alias("organisation_number"), "ord",
        F.concat(F.lit("court.example.org/"), (k % 7).cast("string"), F.lit("#top")).alias("url"),
        F.when(k % 19 == 0, "blog").when(k % 2 == 0, "news").otherwise("filing").alias("kind"), (k % 23 != 0).alias("access_reviewed"),
    )
    return landing.check_manifest(e, 5)


@query(
    "s9_search_candidates",
    """WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, 0::BIGINT AS ord, 'https://www.facebook.com/p' || k AS value, 'social_page' AS kind, NULL AS error FROM e WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, 1, 'https://site' || k || '.example.com/', 'website', NULL FROM e WHERE event_id % 4 <> 3 AND k % 3 <> 0
    UNION ALL SELECT event_id, NULL, NULL, NULL, 'search_invalid_search_response' FROM e WHERE event_id % 4 = 3""",
)
def _s9(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    body = F.when(
        F.col("event_id") % 4 != 3,
        F.concat(F.lit('{"web":{"results":[{"title":"x","url":"https://www.Facebook.com/p'), "k", F.lit('#a"},{"url":"'),
                 F.when(F.col("k") % 3 != 0, F.lit("https")).otherwise(F.lit("ftp")), F.lit("://site"), "k", F.lit('.example.com","snippet":"y"},{"title":"no url"},5]}}')),
    ).otherwise(F.lit('{"web":{"results":"none"}}'))
    out = landing.candidates_from_search(computed(e.select("event_id", "k"), body=body), ["event_id"])
    return out.select("event_id", F.col("ord").cast("bigint").alias("ord"), "value", F.when(F.col("error").isNull(), F.col("kind")).alias("kind"), "error")


#: What a worker that died while it wrote left behind.
TORN = '{"input_index":0,"ro'


@query("s10_journal_rows", """SELECT conv_id AS input_index, turn, role FROM conversations""")
def _s10(spark, d):
    """Journal files as written by many workers, and one whose last write is torn."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("input_index"), "turn", "role")
    path = scratch(spark, "journal")
    c.select(F.to_json(F.struct(*c.columns))).write.text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-torn.txt")
    cut = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    cut.write(bytearray(TORN.encode()))
    cut.close()
    rows = landing.read_journal(spark, path)
    return rows.select(F.from_json("row_json", "input_index bigint, turn bigint, role string").alias("r")).select("r.*")


@query(
    "s2_breaks_in_quotes",
    f"""SELECT {key_sql('doc_id')} AS organisasjonsnummer, replace(text, chr(13), ' ') AS note FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id % 5 <> 0""",
)
def _s2q(spark, d):
    """Whole texts with their line breaks and quotes as cells of a delivered file."""
    docs = table(spark, d, "documents").filter("text is not null and text <> '' and doc_id % 5 <> 0")
    key = org_key(F.col("doc_id")).alias("organisasjonsnummer")
    quoted = F.concat(F.lit('"'), F.replace(F.translate("text", "\r", " "), F.lit('"'), F.lit('""')), F.lit('"'))
    path = scratch(spark, "csv")
    rows = docs.select(F.concat_ws(",", key, quoted).alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    head = rows.groupBy("p").agg(F.lit("organisasjonsnummer,note").alias("value"), F.lit(-1).cast("bigint").alias("i"))
    rows.unionByName(head).repartition("p").sortWithinPartitions("p", "i").select("p", "value").write.partitionBy("p").text(path)
    return bulk.read_bulk_csv(spark, f"{path}/*/*", multi_line=True).drop("_corrupt")


@query("k1_snapshots", "SELECT sha256(text) AS content_sha256, '.html' AS suffix, strlen(text)::BIGINT AS n FROM documents GROUP BY text")
def _k1(spark, d):
    path = scratch(spark, "snapshots")
    docs = table(spark, d, "documents")
    K.write_snapshots(docs.filter("doc_id % 2 = 0"), path, "text", F.lit(".html"))
    K.write_snapshots(docs, path, "text", F.lit(".html"))
    return spark.read.parquet(path).select("content_sha256", "suffix", F.octet_length("body").cast("bigint").alias("n"))


@query(
    "k2_latest_success",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def _k2(spark, d):
    path = scratch(spark, "observations")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", "failed").otherwise("available").alias("state"))
    K.append_observations(e, path)
    return K.latest_success(spark.read.parquet(path), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query(
    "k4_profiles_report",
    "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1",
)
def _k4(spark, d):
    path = scratch(spark, "report")
    K.write_report(table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("priority STRING, n BIGINT").json(path)
