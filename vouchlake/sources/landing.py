"""Fetched responses, reviewed sources, search results and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .lines import PLACE, read_lines, with_torn
from vouchlake.functions import fixed, urls
from vouchlake.functions.canon import computed
from vouchlake.functions.keys import is_valid_key
from vouchlake.session import durable

RESPONSE_COLUMNS = (
    "organisation_number", "source_class", "source_url", "http_status", "error", "body", "retrieved_at", "synthetic",
)


def mark_oversize(df: DataFrame, body: str, is_html: Column, html_limit: int | None = None, json_limit: int | None = None) -> DataFrame:
    """``size_error`` of a body with more bytes than a given limit; every body stays."""
    limit = F.when(is_html, F.lit(html_limit).cast("long")).otherwise(F.lit(json_limit).cast("long"))
    return df.withColumn("size_error", F.when(F.octet_length(body) > limit, F.lit("response_size_limit")))


def read_responses(spark: SparkSession, path: str, html_limit: int | None = None, json_limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path).select(*RESPONSE_COLUMNS)
    return mark_oversize(df, "body", ~F.col("source_class").isin(*fixed.JSON_SOURCE_CLASSES), html_limit, json_limit)


def check_manifest(entries: DataFrame, source_limit: int | None = None) -> DataFrame:
    """Rows (organisation_number, ord, url, kind, access_reviewed) with the reason each one breaks the manifest.

    Given ``source_limit``, the rows of a company with more sources are faults.
    """
    # Normal URLs are stored, so that the counts and the rows read them instead of working them out once each.
    e = durable(urls.normalize_urls(entries, "url"))
    copies = e.groupBy("organisation_number", "norm_url").agg(F.min("ord").alias("_first"), F.count("*").alias("_rows"))
    counts = copies.groupBy("organisation_number").agg(F.sum("_rows").alias("_n"))
    joined = e.join(counts, "organisation_number").join(copies.drop("_rows"), ["organisation_number", "norm_url"], "left")
    over = F.lit(False) if source_limit is None else F.col("_n") > source_limit
    fault = (
        F.when(~is_valid_key("organisation_number") | over, "invalid_legal_source_company_or_limit")
        .when(
            ~F.coalesce(F.col("kind").isin(*fixed.LEGAL_KINDS), F.lit(False)) | ~F.coalesce("access_reviewed", F.lit(False)),
            "legal_source_requires_kind_and_access_review",
        )
        .when(F.col("norm_url").isNull(), F.col("reject_reason"))
        .when(F.col("ord") > F.col("_first"), "duplicate_legal_source_url")
    )
    return joined.select("organisation_number", "ord", F.coalesce("norm_url", "url").alias("url"), "kind", fault.alias("fault"))


def accepted_manifest(entries: DataFrame, company_limit: int | None = None) -> DataFrame:
    """All or nothing; one fault rejects the whole manifest."""
    checked = check_manifest(entries)
    faults = checked.filter(F.col("fault").isNotNull()).select("fault").limit(1).collect()
    if faults:
        raise ValueError(faults[0][0])
    if company_limit is not None and checked.select("organisation_number").distinct().count() > company_limit:
        raise ValueError("legal_sources_must_be_company_map")
    return checked.drop("fault")


def read_source_manifest(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    shape = "map<string,array<struct<url:string,kind:string,access_reviewed:boolean>>>"
    companies = text.select(F.explode(F.from_json("value", shape)).alias("organisation_number", "list"))
    rows = companies.select("organisation_number", F.posexplode_outer("list").alias("ord", "e"))
    return accepted_manifest(rows.select("organisation_number", "ord", "e.url", "e.kind", "e.access_reviewed"))


def candidates_from_search(responses: DataFrame, keep: list[str], body: str = "body") -> DataFrame:
    """Only result URLs survive; titles and snippets are never read."""
    r = computed(responses, _v=F.try_parse_json(body))
    r = computed(r, _list=F.try_variant_get("_v", "$.web.results", "array<variant>"), _raw=F.try_variant_get("_v", "$.web.results", "variant"))
    error = F.when(F.col("_v").isNull() | (F.col("_raw").isNotNull() & F.col("_list").isNull()), F.lit("search_invalid_search_response"))
    rows = r.withColumn("error", error).select(*keep, "error", F.posexplode_outer("_list").alias("ord", "_item"))
    rows = computed(rows, raw_url=F.try_variant_get("_item", "$.url", "string"))
    out = urls.normalize_urls(rows.drop("_item"), "raw_url")
    return out.filter(F.col("norm_url").isNotNull() | F.col("error").isNotNull()).select(
        *keep, "ord", F.col("norm_url").alias("value"), "host", urls.host_class("host").alias("kind"),
        F.lit("discovered").alias("status"), F.lit("web_search").alias("discovery_source"), "error",
    )


def read_journal(spark: SparkSession, path) -> DataFrame:
    """Completion lines of journal files as (file, block, seq, row_json); a torn last write of a file is dropped, other damage is fatal."""
    lines = with_torn(read_lines(spark, path))
    return journal_rows(lines.filter(F.trim("line") != ""), PLACE, "line", F.col("torn"))


def journal_rows(lines: DataFrame, order: list[str], text: str, torn: Column) -> DataFrame:
    """Usable lines; only an unfinished last write may be dropped, other damage is fatal."""
    parsed = computed(lines.filter(~torn), _v=F.try_parse_json(text))
    fault = F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), F.raise_error(F.lit("resume_checkpoint_invalid")))
    return parsed.select(*order, F.coalesce(fault.cast("string"), F.to_json("_v")).alias("row_json"))
