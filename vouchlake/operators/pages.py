"""HTML to text, links, headings, articles, dates, descriptions and JSON-LD."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vouchlake.functions import fixed
from vouchlake.functions.canon import BLANK, computed

HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
TAG = (
    r"(?s)<[a-zA-Z/!?][^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>"
    r"|<[a-zA-Z/!?][^>]*>"
)
LD_SCRIPT = r"(?is)\A<script\b[^>]*\stype\s*=\s*[\"']?application/ld\+json[\"'\s>].*</script\s*>\z"
HEADING = r"(?is)<(title|h1)\b[^>]*>(.*?)</\1\s*>"
FIRST_HEADING = r"(?is)<(h1)\b[^>]*>(.*?)</\1\s*>"
OTHER_REFERENCE = rf"&(?!(?:{'|'.join(fixed.CHARACTER_REFERENCES)});)[#A-Za-z]"


def open_tag(name: str) -> str:
    """Start tags of one element; a '>' inside quotes does not end them."""
    return (
        rf"(?is)<{name}\s[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>|<{name}\b[^>]*>"
    )


def strip_tags(markup) -> Column:
    return F.regexp_replace(markup, TAG, " ")


def attribute(tag: Column, name: str) -> Column:
    found = lambda g: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", g)
    return F.concat(found(1), found(2), found(3))


def _basic_unescape(text: Column) -> Column:
    out = text
    for name, char in fixed.CHARACTER_REFERENCES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _unescape(packs: pd.Series) -> pd.Series:
    one = lambda v: None if v is None else _html.unescape(v)
    return packs.map(lambda pack: None if pack is None else [[one(v) for v in group] for group in pack])


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def _articles(visible: Column) -> Column:
    """Outermost article elements, in order; one without an end tag is not an article."""
    pieces = F.split(visible, r"(?i)(?=</?article\b)")
    start = F.expr("named_struct('depth', 0, 'buf', '', 'done', cast(array() as array<string>))")

    def step(acc, piece):
        opens = piece.rlike(r"(?i)\A<article\b")
        closes = piece.rlike(r"(?i)\A</article\b") & (acc["depth"] > 0)
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ends = closes & (depth == 0)
        buf = F.when(depth == 0, F.lit("")).when(opens & (acc["depth"] == 0), piece).otherwise(F.concat(acc["buf"], piece))
        done = F.when(ends, F.concat(acc["done"], F.array(acc["buf"]))).otherwise(acc["done"])
        return F.struct(depth.alias("depth"), buf.alias("buf"), done.alias("done"))

    return F.aggregate(pieces, start, step)["done"]


def page_features(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the parsed page as columns; everything but unusual character references stays in the JVM."""
    keep = [c for c in pages.columns]
    p = computed(
        pages,
        _visible=F.regexp_replace(html, HIDDEN, " "),
        _hidden=F.when(F.lower(html).contains("ld+json"), F.regexp_extract_all(html, F.lit(HIDDEN), F.lit(0))),
    )
    blocks = F.filter(F.coalesce("_hidden", F.expr("cast(array() as array<string>)")), lambda t: t.rlike(LD_SCRIPT))
    bodies = F.transform(blocks, lambda t: F.regexp_extract(t, r"(?is)\A<script\b[^>]*>(.*)</script\s*>\z", 1))
    all_of = lambda pattern, group=0: F.regexp_extract_all("_visible", F.lit(pattern), F.lit(group))
    p = computed(p, _articles=_articles(F.col("_visible")), _metas=all_of(open_tag("meta")), json_ld=F.transform(bodies, lambda b: F.to_json(F.try_parse_json(b))))
    meta_key = lambda t, a, b: F.lower(F.coalesce(F.nullif(attribute(t, a), F.lit("")), attribute(t, b)))
    content = lambda t: attribute(t, "content")
    dated = F.filter("_metas", lambda t: meta_key(t, "property", "name").isin("article:published_time", "datepublished"))
    described = F.filter("_metas", lambda t: meta_key(t, "name", "property").isin("description", "og:description", "twitter:description"))
    pack = F.array(
        F.array(strip_tags(F.col("_visible"))),
        F.filter(F.transform(all_of(open_tag("a")), lambda t: attribute(t, "href")), lambda h: h != ""),
        F.transform(all_of(HEADING, 2), lambda h: strip_tags(h)),
        F.transform("_articles", lambda a: strip_tags(a)),
        F.flatten(F.transform("_articles", lambda a: F.transform(F.regexp_extract_all(a, F.lit(FIRST_HEADING), F.lit(2)), lambda h: strip_tags(h)))),
        F.filter(
            F.flatten(F.transform("_articles", lambda a: F.transform(F.regexp_extract_all(a, F.lit(open_tag("time")), F.lit(0)), lambda t: attribute(t, "datetime")))),
            lambda v: v != "",
        ),
        F.transform(dated, content),
        F.transform(described, content),
    )
    p = computed(p, _pack=pack)
    p = p.withColumn("_full", _unescape(F.when(F.col(html).rlike(OTHER_REFERENCE), F.col("_pack"))))
    plain = F.transform("_pack", lambda g: F.transform(g, _basic_unescape))
    p = computed(p, _pack=F.coalesce("_full", plain))
    part = lambda i: F.element_at("_pack", i + 1)
    clean = lambda i: F.transform(part(i), _clean)
    return computed(
        p, text=F.element_at(clean(0), 1), links=part(1), headings=clean(2), article_texts=clean(3), article_headings=clean(4),
        article_dates=part(5), publication_dates=part(6), descriptions=part(7),
    ).select(
        *keep, "text", "links", "headings", "article_texts", "article_headings", "article_dates", "publication_dates", "descriptions", "json_ld"
    )


def visible_text(markup) -> Column:
    """Text of a markup fragment whose character references are the basic ones."""
    return _clean(_basic_unescape(strip_tags(F.regexp_replace(markup, HIDDEN, " "))))
