"""Gates on outcomes, links, dates, robots rules and published sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions import fixed, urls
from vouchlake.functions.canon import as_col, computed, utc_date
from .joins import match_prefix
from .windows import keep_first


def filter_allowlist(df: DataFrame, allowed: DataFrame, host: str = "host") -> DataFrame:
    """P10"""
    return df.join(allowed.select(host).distinct(), host, "left_semi")


def outcome_state(status, error) -> Column:
    """State of a failed lookup."""
    status, error = as_col(status), as_col(error)
    return (
        F.when(error == "host_rate_limited", "blocked").when(status == 404, "not_available")
        .when(status.isin(401, 403, 429), "blocked").when((status != 200) | error.isNotNull(), "failed").otherwise("available")
    )


def map_outcomes(df: DataFrame, status: str = "http_status", error: str = "error") -> DataFrame:
    reason = F.when(F.col(error).isNotNull(), F.col(error)).when(
        F.col(status) != 200, F.concat(F.lit("http_"), F.col(status).cast("string"))
    )
    return df.withColumns({"state": outcome_state(status, error), "reason": reason})


def is_active(posted, expires, has_expiry, today) -> Column:
    """Posted by today; a given expiry must parse and lie after both dates."""
    posted, today = utc_date(posted), utc_date(today)
    end = utc_date(expires)
    lasting = ~as_col(has_expiry) | (end.isNotNull() & (end >= today) & (end >= posted))
    return F.coalesce((posted <= today) & lasting, F.lit(False))


def consensus_date(values, cutoff) -> Column:
    """The one date that all values agree on, not after the cutoff; else NULL."""
    dates = F.transform(as_col(values), lambda v: utc_date(v))
    one = F.array_distinct(dates)
    day = F.try_element_at(one, F.lit(1))
    return F.when((F.size(one) == 1) & day.isNotNull() & (day <= utc_date(cutoff)), F.date_format(day, "yyyy-MM-dd"))


def consensus_dates(df: DataFrame, keys: list[str], value: str, cutoff: Column) -> DataFrame:
    """P16 over rows: extremes decide, so no group of dates is ever collected."""
    day = utc_date(value)
    agg = df.groupBy(*keys).agg(
        F.min(day).alias("_lo"), F.max(day).alias("_hi"), F.count_if(day.isNull()).alias("_bad")
    )
    ok = (F.col("_lo") == F.col("_hi")) & (F.col("_bad") == 0) & (F.col("_hi") <= utc_date(cutoff))
    return agg.select(*keys, F.when(ok, F.date_format("_lo", "yyyy-MM-dd")).alias("published_at"))


def mention(passage) -> Column:
    """STRUCT<hit, reference> of a passage."""
    ref = F.regexp_replace(F.regexp_extract(as_col(passage), fixed.CASE_REFERENCE, 1), r"[./\-]+\z", "")
    return F.struct(as_col(passage).rlike(fixed.LEGAL_TERM).alias("hit"), F.nullif(ref, F.lit("")).alias("case_reference"))


def safe_source(df: DataFrame, registry_base: str, registry_host: str) -> DataFrame:
    """May this evidence URL be shown as a link?"""
    n = urls.normalize_urls(df, "source_url")
    same = F.coalesce(F.col("norm_url") == F.col("source_url"), F.lit(False))
    kind, url = F.col("source_class"), F.col("source_url")
    official = url.rlike(r"\A(?i:https)://" + registry_host.replace(".", r"\.") + r"(?::443)?(?:[/?#]|\z)")
    safe = (
        F.when(F.coalesce("synthetic", F.lit(False)), False)
        .when(url.startswith(registry_base), True)
        .when(kind.isin("verified_company_website", "legal_news_report", "legal_filing_report"), same)
        .when(kind.isin("official_accounts", "official_registry_roles", "official_registry_locations"), official)
        .when(kind == "verified_social_page", same & (urls.host_class("host") == "social_page"))
        .otherwise(False)
    )
    return n.select(*df.columns, safe.alias("safe"))


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """Lines of robots files as rules (host, line, rule, allow) and delays for one agent.

    ``robots``: host, http_status, body. Groups are runs of user-agent lines; the
    group naming the agent wins, else the group for every agent.
    """
    lines = robots.filter(F.col("http_status") == 200).select(
        "host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "_raw")
    )
    text = F.trim(F.regexp_replace("_raw", r"#.*\z", ""))
    lines = computed(lines, _k=F.lower(F.trim(F.substring_index(text, ":", 1))), _v=F.trim(F.regexp_extract(text, r"\A[^:]*:(.*)\z", 1)))
    lines = lines.filter(F.col("_k").isin("user-agent", "allow", "disallow", "crawl-delay", "request-rate"))
    from pyspark.sql import Window

    # One robots file is one short document (under 1 MB), so a window per host stays small.
    w = Window.partitionBy("host").orderBy("line")
    is_agent = F.col("_k") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag("_k").over(w) == "user-agent", F.lit(False))
    lines = lines.withColumn("_open", opens.cast("int"))
    lines = lines.withColumn("_group", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    heads = lines.filter(is_agent).groupBy("host", "_group").agg(
        F.max(F.when((F.col("_v") != "*") & (F.col("_v") != "") & F.contains(F.lit(agent.lower()), F.lower(F.col("_v"))), 2).when(F.col("_v") == "*", 1)).alias("_fit")
    )
    fitting = heads.filter(F.col("_fit").isNotNull())
    chosen = fitting.groupBy("host").agg(F.min_by("_group", F.struct(-F.col("_fit"), F.col("_group"))).alias("_group"))
    return lines.join(chosen, ["host", "_group"], "left_semi").filter(~is_agent).select("host", "line", "_k", "_v")


def filter_robots(frontier: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """State, allowance and pacing of every frontier URL (host, path)."""
    # Of several answers of one host the latest counts.
    newest = [F.col("retrieved_at").desc()] if "retrieved_at" in robots.columns else []
    robots = keep_first(robots, ["host"], [*newest, F.col("http_status"), F.col("body")])
    lines = robots_rules(robots, agent)
    paths = lines.filter(F.col("_k").isin("allow", "disallow"))
    rules = paths.select(
        "host", "line", F.when((F.col("_v") == "*"), F.lit("/")).otherwise(F.col("_v")).alias("rule"),
        ((F.col("_k") == "allow") | (F.col("_v") == "")).alias("allow"),
    )
    rules = rules.withColumn("rule", F.when(F.col("rule") == "", F.lit("/")).otherwise(F.col("rule")))
    pace = lines.filter(F.col("_k").isin("crawl-delay", "request-rate"))
    wait = F.when(F.col("_k") == "crawl-delay", F.col("_v").try_cast("double")).otherwise(
        F.try_divide(
            F.regexp_extract("_v", r"\A\s*(\d+)\s*/\s*(\d+)", 2).try_cast("double"), F.regexp_extract("_v", r"\A\s*(\d+)\s*/\s*(\d+)", 1).try_cast("double")
        )
    )
    delays = pace.groupBy("host").agg(F.max(wait).alias("_wait"))
    asked = frontier.select("host", "path").distinct()
    hits = match_prefix(asked, rules, "host", "path", "rule", "line").select("host", "path", "allow")
    out = frontier.join(hits, ["host", "path"], "left").join(robots.select("host", "http_status"), "host", "left").join(delays, "host", "left")
    reason = F.when(F.col("http_status") == 404, F.lit(None).cast("string")).when(
        F.coalesce(F.col("http_status") != 200, F.lit(True)), F.lit("robots_unavailable")
    ).when(F.coalesce(~F.col("allow"), F.lit(False)), F.lit("robots_disallowed"))
    return out.select(
        *frontier.columns, reason.isNull().alias("allowed"), reason.alias("reason"),
        F.greatest(F.lit(1.0), F.coalesce("_wait", F.lit(0.0))).alias("delay"),
    )


def stamp_run(df: DataFrame, mode: str, run_id: str) -> DataFrame:
    """P20"""
    return df.withColumns(
        {
            "terminal_status": F.when(F.col("state") == "failed", "failed").otherwise("completed"),
            "source_mode": F.lit(mode),
            "synthetic": F.lit(mode == "fixture"),
            "run_id": F.lit(run_id),
        }
    )
