"""The numbered queries over the given tables, with SQL where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchlake.llm import bpe, language, lexical, licences, quality, secrets, spelling, urlfilter
from vouchlake.llm.common import ORACLE, QUERIES, fold, query, table
from vouchlake.llm.decontaminate import judged, occurrences
from vouchlake.llm.neighbours import search
from vouchlake.llm.sharding import interleave
from vouchlake.llm.simhash import hex_mark, near_groups
from vouchlake.llm.substring import remove_repeats

SPLIT = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    "op1_substring_dedup",
    f"""
WITH d AS (SELECT doc_id, {SPLIT} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM s),
o AS (SELECT k, min(doc_id) AS owner FROM g GROUP BY k),
c AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM g JOIN o USING (k) WHERE doc_id > owner GROUP BY doc_id),
x AS (SELECT d.doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS i FROM d),
gone AS (SELECT doc_id, unnest(gone) AS i FROM c),
k AS (SELECT x.doc_id, any_value(len(w)) AS n, count(gone.i) AS r,
  coalesce(string_agg(w[x.i], ' ' ORDER BY x.i) FILTER (gone.i IS NULL AND x.i > 0), '') AS kept
  FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k""",
)
def op1(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op6_benchmark_decontamination",
    f"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
b AS (SELECT item_id, {TERMS} AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bk ON bk.n = dw.n AND bk.k = array_to_string(dw.w[i:i+dw.n-1], ' ')),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op6(spark, sf_dir):
    out = judged(occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13))
    ids = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_mark(F.col("fp")).alias("fingerprint"), "component_id")


@query("op7_bpe_encoding")
def op7(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


UNIT = "('0x' || substr(md5({}), 1, 8))::BIGINT"


@query(
    "op2_sharding",
    f"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
b AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key FROM documents),
h AS (SELECT doc_id, source_key, octet_length(encode(text)) + 16 AS size,
  xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)::BIGINT AS text_crc32,
  {UNIT.format("'42:' || doc_id")} AS h, {UNIT.format("'42:' || source_key")}::DOUBLE / 4294967296.0::DOUBLE AS u FROM b, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY source_key ORDER BY h, doc_id) - 1 + u) / count(*) OVER (PARTITION BY source_key)::DOUBLE AS f FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY f, source_key, doc_id) - 1 AS p, count(*) OVER () AS n FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p * 40 // n)::INT AS shard,
  (p - ((p * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM p""",
)
def op2(spark, sf_dir):
    out = interleave(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


@query("op5_url_filters")
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    weights = urlfilter.fit(urlfilter.labelled_by_rules(pages, RULES))
    return urlfilter.judge(pages, RULES, weights)


@query(
    "op8_nearest_neighbours",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  list_reduce([0.0::DOUBLE] || list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op8(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op10_secret_scans")
def op10(spark, sf_dir):
    out = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = language.fit(language.learnable(docs, ~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    network = quality.fit(docs, labels.filter(~held))
    out = quality.score(docs, network)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@query("op11_license_scans")
def op11(spark, sf_dir):
    out = licences.scan(table(spark, sf_dir, "documents"), PHRASES)
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", F.flatten("expressions.labels"))).alias("labels"), "score",
    )


@query(
    "op12_ranked_lexical_search",
    f"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents),
n AS (SELECT doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS rows, sum(n)::BIGINT AS total FROM n),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * rows + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * rows) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20""",
)
def op12(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


CRC = (
    "xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({})), '..'), lambda x: ('0x' || x)::BIGINT), "
    "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)::BIGINT"
)


@query(
    "op13_spelling_variants",
    f"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
o AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents) GROUP BY doc_id, run),
h AS (SELECT run, c, {CRC.format("doc_id || ':' || run")} AS h FROM o, crc WHERE length(run) >= 7),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
near AS (SELECT x.word AS a, w.word AS b FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.cut = w.word
  UNION SELECT p.word, q.word FROM x p JOIN x q ON p.i = q.i AND p.cut = q.cut AND p.word <> q.word),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
  FROM near JOIN w ON w.word = near.b),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 10 * w.n THEN b END AS form,
  CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n FROM w LEFT JOIN best ON best.a = w.word AND r = 1),
up AS (SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
ends AS (SELECT up.word, up.root FROM up JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN ends USING (word)""",
)
def op13(spark, sf_dir):
    out = spelling.variants(table(spark, sf_dir, "documents"), spelling.drop_one_in(31), 10)
    return out.select("word", "form", "root", "n", "n_near", "form_n")
