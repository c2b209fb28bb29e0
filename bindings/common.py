"""Registry of queries and the landing tables that Spark derives from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouchlake.functions.canon import computed
from vouchlake.functions.keys import check_digit
from vouchlake.session import spread

def sql_list(words) -> str:
    """Words as SQL text literals, comma-joined."""
    return ",".join(f"'{w}'" for w in words)


def sql_pattern(pattern: str) -> str:
    """A fixed pattern in the dialect of the SQL engine: case folding only, no Unicode classes flag."""
    return pattern.replace("(?iU)", "(?i)")


QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def org_key(number):
    """Nine-digit key of an integer id: an 8, seven digits and the check digit.

    Where that stem has no check digit a 9 leads instead; its weight shifts the sum by 3,
    so one of the two always has one.
    """
    at = lambda lead: (F.lit(lead * 10_000_000) + number).cast("string")
    key = lambda lead: F.concat(at(lead), check_digit(at(lead)).cast("string"))
    return F.coalesce(key(8), key(9))


def key_sql(k: str) -> str:
    def one(lead: int) -> str:
        s = f"({lead * 10_000_000}+{k})"
        weighted = "+".join(f"{w}*(({s}//{10 ** (7 - i)})%10)" for i, w in enumerate((3, 2, 7, 6, 5, 4, 3, 2)))
        r = f"(11-({weighted})%11)"
        return f"(CASE {r} WHEN 10 THEN NULL WHEN 11 THEN {s}::VARCHAR||'0' ELSE {s}::VARCHAR||({r})::VARCHAR END)"

    return f"coalesce({one(8)}, {one(9)})"


def registry_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing rows in the shape of registry records, one per customer with a valid key.

    Remainders of the customer id give every branch: another company's number (97),
    a blank name (89), no address (7), no activity (11), an unconfirmed (3) or
    impossible (113) employee count, no homepage (5).
    """
    c = spread(table(spark, sf_dir, "customer"))
    n = table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = computed(rows, organisation_number=org_key(k)).filter(F.col("organisation_number").isNotNull())
    body = F.to_json(
        F.struct(
            F.when(k % 97 == 0, F.lit("999999999")).otherwise(F.col("organisation_number")).alias("organisasjonsnummer"),
            F.when(k % 89 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("navn"),
            F.struct(F.lit("AS").alias("kode"), F.col("c_mktsegment").alias("beskrivelse")).alias("organisasjonsform"),
            F.when(k % 7 != 0, F.struct(F.col("n_name").alias("poststed"), F.lit("NO").alias("land"))).alias("forretningsadresse"),
            F.struct(F.col("c_nationkey").cast("string").alias("kode"), F.col("c_mktsegment").alias("beskrivelse")).alias("naeringskode1"),
            F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (k % 3650).cast("int")), "yyyy-MM-dd").alias("registreringsdatoEnhetsregisteret"),
            F.when(k % 11 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.col("c_mktsegment"), F.col("n_name"))).alias("aktivitet"),
            (F.col("c_acctbal") < 0).alias("konkurs"),
            F.lit(False).alias("underAvvikling"),
            (k % 3 != 0).alias("harRegistrertAntallAnsatte"),
            F.when(k % 113 == 0, -1).otherwise(k % 50).alias("antallAnsatte"),
            F.when(k % 5 != 0, F.concat(F.lit("www."), F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))), F.lit(".example.com"))).alias("hjemmeside"),
        )
    )
    return computed(rows, body=body).select(
        "organisation_number",
        k.alias("k"),
        "body",
        F.concat(F.lit("https://registry.example.org/entities/"), F.col("organisation_number")).alias("source_url"),
        F.lit("2024-01-16T00:00:00+00:00").alias("retrieved_at"),
    )


# The same rows stated directly: one row per registry field, no JSON round trip.
REGISTRY_FACTS_SQL = f"""
base AS (
  SELECT {key_sql('c_custkey')} AS org, c_custkey AS k, c_name, c_mktsegment AS seg, c_acctbal, c_nationkey, n_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
good AS (
  SELECT * FROM base WHERE org IS NOT NULL AND k % 97 <> 0 AND k % 89 <> 0 AND NOT (k % 3 <> 0 AND k % 113 = 0)
),
facts AS (
  SELECT org, k, 'legal_name' AS field, 'navn' AS key, '"' || c_name || '"' AS v FROM good
  UNION ALL SELECT org, k, 'legal_form', 'organisasjonsform', '{{"beskrivelse":"' || seg || '","kode":"AS"}}' FROM good
  UNION ALL SELECT org, k, 'registered_address', 'forretningsadresse',
    CASE WHEN k % 7 <> 0 THEN '{{"land":"NO","poststed":"' || n_name || '"}}' END FROM good
  UNION ALL SELECT org, k, 'industry', 'naeringskode1', '{{"beskrivelse":"' || seg || '","kode":"' || c_nationkey || '"}}' FROM good
  UNION ALL SELECT org, k, 'registered_at', 'registreringsdatoEnhetsregisteret',
    '"' || strftime(DATE '2000-01-01' + CAST(k % 3650 AS INT), '%Y-%m-%d') || '"' FROM good
  UNION ALL SELECT org, k, 'business_activity', 'aktivitet',
    CASE WHEN k % 11 <> 0 THEN '["' || seg || '","' || n_name || '"]' END FROM good
  UNION ALL SELECT org, k, 'bankrupt', 'konkurs', CASE WHEN c_acctbal < 0 THEN 'true' ELSE 'false' END FROM good
  UNION ALL SELECT org, k, 'in_liquidation', 'underAvvikling', 'false' FROM good
  UNION ALL SELECT org, k, 'registered_employees', 'antallAnsatte', (k % 50)::VARCHAR FROM good WHERE k % 3 <> 0
)"""
