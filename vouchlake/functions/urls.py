"""URL normalisation, host classes and page roles as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .canon import as_col, computed, fold
from . import fixed

PARTS = r"(?s)\A([a-zA-Z][a-zA-Z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
LABEL = fixed.HOST_LABEL
PRIVATE = rf"(?:{'|'.join(s.replace('.', chr(92) + '.') for s in fixed.PRIVATE_SUFFIXES)})\z"


@F.pandas_udf(T.StringType())
def _ascii_host(hosts: pd.Series) -> pd.Series:
    def one(host):
        if not host:
            return host
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return hosts.map(one)


EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def normalize_urls(df: DataFrame, column: str, idna: bool = True) -> DataFrame:
    """P5: add norm_url, host, path, query and reject_reason.

    Exactly one of norm_url and reject_reason is set. With ``idna`` only hosts that
    hold non-ASCII letters travel to Python.
    """
    names = [c for c in df.columns if c not in ("norm_url", "host", "path", "query", "reject_reason")]
    trimmed = F.regexp_replace(F.col(f"`{column}`"), EDGES, "")
    out = computed(df.select(*names), _t=trimmed)
    out = computed(out, _full=F.when(F.contains("_t", F.lit("://")), F.col("_t")).otherwise(F.concat(F.lit("https://"), "_t")))
    out = computed(
        out,
        _scheme=F.lower(F.regexp_extract("_full", PARTS, 1)),
        _auth=F.regexp_extract("_full", PARTS, 2),
        _path=F.regexp_extract("_full", PARTS, 3),
        _query=F.regexp_extract("_full", PARTS, 4),
    )
    out = computed(
        out, _user=F.regexp_extract("_auth", r"\A(.*)@", 1), _hp=F.regexp_replace("_auth", r"\A.*@", "")
    )
    out = computed(
        out,
        _port=F.regexp_extract("_hp", r":([^:\]]*)\z", 1),
        _host=F.regexp_replace(F.lower(F.regexp_replace("_hp", r":[0-9]*\z", "")), r"\.+\z", ""),
    )
    if idna:
        foreign = F.col("_host").rlike(r"[^\x00-\x7f]")
        out = out.withColumn("_ascii", _ascii_host(F.when(foreign, F.col("_host"))))
        out = computed(out, _host=F.when(foreign, F.coalesce("_ascii", F.lit(""))).otherwise(F.col("_host"))).drop("_ascii")
    host = F.col("_host")
    reject = (
        F.when(F.col("_t").isNull() | (F.col("_t") == ""), F.lit("missing_url"))
        .when((F.col("_scheme") != "https") | ~F.col("_user").isin("", ":") | ~F.col("_port").isin("", "443"), F.lit("https_public_urls_only"))
        .when(
            (host == "") | F.col("_full").rlike(r"[\x00-\x20]") | F.contains(host, F.lit("%")) | F.contains("_full", F.lit("\\")),
            F.lit("invalid_url"),
        )
        .when(host.rlike(rf"\A(?:{OCTET}\.){{3}}{OCTET}\z|\A\["), F.lit("ip_literals_not_allowed"))
        .when(~F.contains(host, F.lit(".")) | host.rlike(PRIVATE), F.lit("non_public_hostname"))
        .when((F.length(host) > 253) | ~host.rlike(rf"\A{LABEL}(?:\.{LABEL})*\z"), F.lit("invalid_hostname"))
    )
    out = computed(out, reject_reason=reject)
    ok = F.col("reject_reason").isNull()
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))
    tail = F.when(F.col("_query") == "", F.lit("")).otherwise(F.concat(F.lit("?"), "_query"))
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(ok, F.concat(F.lit("https://"), host, path, tail)).alias("norm_url"),
        F.when(ok, host).alias("host"),
        F.when(ok, path).alias("path"),
        F.when(ok, F.col("_query")).alias("query"),
        "reject_reason",
    )


def bare_host(host) -> Column:
    return F.regexp_replace(as_col(host), r"\Awww\.", "")


def host_class(host) -> Column:
    """social_page for the known social hosts, else website."""
    return F.when(bare_host(host).isin(*fixed.SOCIAL_HOSTS), F.lit("social_page")).otherwise(F.lit("website"))


def url_path(url) -> Column:
    return F.regexp_replace(F.regexp_replace(as_col(url), r"(?s)[?#].*\z", ""), r"\A(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/]*", "")


def url_query(url) -> Column:
    return F.regexp_extract(as_col(url), r"(?s)\A[^?#]*\?([^#]*)", 1)


def last_segment(path) -> Column:
    return fold(F.element_at(F.split(F.regexp_replace(as_col(path), r"/+\z", ""), "/"), -1))


def has_search_query(query) -> Column:
    return as_col(query).rlike(fixed.SEARCH_QUERY_PATTERN)


def url_role(url) -> Column:
    """Root, news_index, job_index, search or detail."""
    path, tail = url_path(url), last_segment(url_path(url))
    return (
        F.when(F.regexp_replace(path, "/", "") == "", F.lit("root"))
        .when(tail.isin(*fixed.NEWS_INDEXES), F.lit("news_index"))
        .when(tail.isin(*fixed.JOB_INDEXES), F.lit("job_index"))
        .when((tail == "search") | has_search_query(url_query(url)), F.lit("search"))
        .otherwise(F.lit("detail"))
    )


def detail_link_allowed(href) -> Column:
    """No utility pages, no assets, no search results."""
    tail = last_segment(url_path(href))
    return ~(
        (tail == "") | tail.isin(*fixed.UTILITY_TAILS) | tail.rlike(fixed.ASSET_PATTERN) | has_search_query(url_query(href))
    )


def link_priority(href, story: bool = False) -> Column:
    """Index of the first keyword found; unmatched links last, or first for stories."""
    text = fold(href)
    out = F.lit(-1 if story else len(fixed.LINK_WORDS))
    for index in range(len(fixed.LINK_WORDS) - 1, -1, -1):
        out = F.when(F.contains(text, F.lit(fixed.LINK_WORDS[index])), F.lit(index)).otherwise(out)
    return out


def resolve_href(base, href) -> Column:
    """Join a link to its page URL, dropping '.' and '..' path steps."""
    base, href = as_col(base), F.trim(as_col(href))
    origin = F.regexp_extract(base, r"\A([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"\A([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    base_path = F.regexp_replace(url_path(base), r"\A\z", "/")
    href_path = F.regexp_replace(href, r"(?s)[?#].*\z", "")
    rest = F.regexp_extract(href, r"(?s)\A[^?#]*(.*)\z", 1)
    folder = F.regexp_replace(base_path, r"[^/]*\z", "")
    merged = F.when(href_path.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    steps = F.split(F.regexp_replace(merged, r"\A/", ""), "/")
    kept = F.aggregate(
        steps,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == "..", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail_slash = F.when(merged.rlike(r"/\.{1,2}\z") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    path = F.concat(F.lit("/"), F.array_join(kept, "/"), tail_slash)
    return (
        F.when(href.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*\z", ""), href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .otherwise(F.concat(origin, path, rest))
    )
