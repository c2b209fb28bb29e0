"""URL filters: rules first, then logistic regression on hashed character n-grams.

A rule ``host/path`` fits its host and all subdomains where the url's path starts with the
rule's; the longest rule wins. Where none fits, a logistic regression over the hashed
character n-grams of host and path decides. It is fitted on a small labelled table of at
most ``TRAINING_URLS`` urls (those of least hash, if more are given); the weights enter
the plan as one literal, so scoring is an expression over the row: no join, no shuffle,
no Python.

Defined cases: a null url or one without ``://`` has empty host and path and is left to
the regression; repeated and null page_ids give a row each; an empty table gives an empty
result; with no labelled url at all everything undecided is allowed; other columns are
not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, functions as F


TRAINING_URLS = 2000
FEATURES = 4096
GRAM = 4
EPOCHS = 8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule: host suffixes by whole labels, path prefixes of the lengths that rules use."""
    if not rules:
        return F.lit(None).cast("string")
    sizes = sorted({len(r) - len(r.split("/")[0]) for r in rules})
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefixes = F.array(*[F.substring(path, 1, n) for n in sizes])
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    fitting = F.array_intersect(keys, F.array(*[F.lit(r) for r in sorted(rules)]))
    longest = F.sort_array(F.transform(fitting, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))), asc=False)
    return F.get(longest, F.lit(0))["r"]


def features(host: Column, path: Column) -> Column:
    """Feature numbers of all character n-grams, ends marked, host and path apart."""

    def grams(kind: str, text: Column) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        count = F.greatest(F.length(marked) - GRAM + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), count), lambda i: F.pmod(F.xxhash64(F.concat(F.lit(kind), marked.substr(i, F.lit(GRAM)))), F.lit(FEATURES)).cast("int"))

    return F.concat(grams("h", host), grams("p", path))


def fit(labelled: DataFrame, seed: int = 7) -> list[float]:
    """Weights (the last is the bias) from (url, blocked boolean); stochastic gradient descent on the driver.

    The table is small by contract: at most ``TRAINING_URLS`` rows are fetched.
    """
    url = F.col("url").cast("string")
    rows = labelled.filter("url is not null and blocked is not null").select(F.col("blocked").cast("int").alias("y"), features(host_of(url), path_of(url)).alias("x"), F.xxhash64(url).alias("o"))
    rows = [(r["y"], r["x"]) for r in rows.orderBy("o", "y", "x").limit(TRAINING_URLS).collect()]
    weights = [0.0] * (FEATURES + 1)
    rng = random.Random(seed)
    for epoch in range(EPOCHS):
        rate = 1.0 / (1 + epoch)
        rng.shuffle(rows)
        for y, x in rows:
            scale = 1 / math.sqrt(len(x))
            z = weights[-1] + scale * sum(weights[k] for k in x)
            step = rate * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for k in x:
                weights[k] += step * scale
            weights[-1] += step
    return weights


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability of block."""
    table = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")
    x = features(host, path)
    total = F.aggregate(x, F.lit(0.0), lambda s, k: s + F.element_at(table, k + 1))
    return 1 / (1 + F.exp(-(F.lit(weights[-1]) + total / F.sqrt(F.size(x)))))


def judge(pages: DataFrame, rules: dict[str, str], weights: list[float] | None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each page; ``rules`` maps rule to allow or block."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("score", score(F.col("host"), F.col("path"), weights) if weights else F.lit(0.0))
    by_rule = F.create_map(*[F.lit(x) for pair in sorted(rules.items()) for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The small labelled table of this repository's data: urls that a rule decides."""
    by_rule = judge(pages.select(F.col("url").alias("page_id"), "url"), rules, None).filter("rule is not null")
    return by_rule.select(F.col("page_id").alias("url"), (F.col("verdict") == "block").alias("blocked")).distinct()
