"""The run report, directory search and source labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions import fixed
from vouchlake.operators.rollups import nearest_rank


def run_report(rows: DataFrame) -> DataFrame:
    """One row. ``rows``: state, resumed, runtime_ms, claims, requests, website_requests,
    legal_requests, legal_reports, pages_verified, queries, cost."""
    fresh = ~F.col("resumed")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    spent = lambda c: F.coalesce(F.sum(F.when(fresh, F.col(c))), F.lit(0)).alias(c)
    one = rows.agg(
        F.count("*").alias("output_count"), F.count_if("resumed").alias("resumed_count"),
        *[F.count_if(F.col("state") == s).alias(f"state_{s}") for s in fixed.STATES],
        total("claims"), total("pages_verified"), total("legal_reports"), total("requests"),
        spent("website_requests"), spent("legal_requests"), spent("queries"),
        F.round(F.coalesce(F.sum(F.when(fresh, F.col("cost"))), F.lit(0.0)), 6).alias("cost"),
    )
    ranks = nearest_rank(rows.filter(fresh).select("runtime_ms"), "runtime_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).first()
    return one.withColumns({"p50_ms": F.lit(ranks["p50_ms"]), "p95_ms": F.lit(ranks["p95_ms"])})


def search_profiles(profiles: DataFrame, query: str, texts: list[str], values: str | None = None) -> DataFrame:
    """Profiles whose number, state, name, summary or any claim value holds the query."""
    cells = [F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts]
    if values:
        cells.append(F.array_join(values, " "))
    return profiles.filter(F.contains(F.lower(F.concat_ws(" ", *cells)), F.lit(query.strip().lower())))


def locator_label() -> Column:
    """C20: where in its source a claim was found."""
    span = F.concat(F.lit("["), F.col("text_span.start").cast("string"), F.lit(", "), F.col("text_span.end").cast("string"), F.lit("]"))
    return (
        F.when(F.col("json_ld_block").isNotNull(), F.concat(F.lit("JSON-LD block "), F.col("json_ld_block").cast("string"), F.lit(" · Pointer: "), F.coalesce(F.nullif(F.col("json_pointer"), F.lit("")), F.lit("(root)"))))
        .when(F.col("extraction_method") == "company_meta_description_v1", "HTML meta description")
        .when(F.col("json_pointer").isNotNull(), F.concat(F.lit("JSON pointer: "), "json_pointer"))
        .when(F.col("extraction_method").isin("official_accounts_v1", "registry_roles_v1", "registry_subunits_v1"), "Structured source record")
        .otherwise(F.concat(F.lit("Text span: "), F.coalesce(span, F.lit("missing"))))
    )


def source_label(registry_base: str, registry_name: str) -> Column:
    """C20: a reader's name for the source of a claim."""
    host = F.lower(F.regexp_extract("source_url", r"\A[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    kind = F.col("source_class")
    named = lambda fallback: F.coalesce(F.nullif(host, F.lit("")), F.lit(fallback))
    return (
        F.when(F.coalesce("synthetic", F.lit(False)), "Synthetic fixture")
        .when(F.col("source_url").startswith(registry_base), registry_name)
        .when(kind == "verified_company_website", named("Verified company site"))
        .when(kind == "official_accounts", "Annual accounts")
        .when(kind == "official_registry_roles", "Registered roles")
        .when(kind == "official_registry_locations", "Operating locations")
        .when(kind == "verified_social_page", named("Verified social profile"))
        .when(kind == "legal_news_report", "Attributed news report")
        .when(kind == "legal_filing_report", "Public filing")
        .otherwise("Source record")
    )
