"""Joins between stages. Sides are left to AQE, which broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions.canon import computed
from .windows import cap, latest_per, numbered, running


def keep_wanted(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """J2"""
    return df.join(wanted.select(key), key, "left_semi")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """J3"""
    return inputs.join(done.select(key), key, "left_anti")


def attach_evidence(claims: DataFrame, evidence: DataFrame, on: str) -> DataFrame:
    """Claims with their evidence; a dangling claim is kept and marked."""
    marked = evidence.withColumn("_found", F.lit(True))
    return claims.join(marked, on, "left").withColumn("dangling", F.col("_found").isNull()).drop("_found")


def pair_subjects(prior: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """J5 + U4: both observations of every subject side by side."""
    old = prior.select(*keys, F.col(value).alias("before"), F.lit(True).alias("had"))
    new = current.select(*keys, F.col(value).alias("after"), F.lit(True).alias("has"))
    return old.join(new, keys, "full_outer").withColumns(
        {"had": F.coalesce("had", F.lit(False)), "has": F.coalesce("has", F.lit(False))}
    )


def resolve_refs(nodes: DataFrame, page: str, node_id: str, ref: str, order: str) -> DataFrame:
    """Each reference with the last node of that id on the same page, if any."""
    targets = latest_per(nodes.filter(F.col(node_id).isNotNull()), [page, node_id], [order])
    targets = targets.select(F.col(page).alias("_p"), F.col(node_id).alias("_i"), F.col(order).alias("target"))
    refs = nodes.filter(F.col(ref).isNotNull())
    return refs.join(targets, (F.col(page) == F.col("_p")) & (F.col(ref) == F.col("_i")), "left").drop("_p", "_i")


def comparable_before(start, end, prior_start, prior_end, length_tol=7, end_tol=7) -> Column:
    """J7 of two statements side by side: is the prior one comparable to the other, a year later?"""
    days = lambda a, b: F.datediff(b, a)
    lengths = F.abs(days(start, end) - days(prior_start, prior_end)) <= length_tol
    return (F.year(end) == F.year(prior_end) + 1) & lengths & (F.abs(F.datediff(end, F.add_months(prior_end, 12))) <= end_tol)


def comparable_periods(statements: DataFrame, keys: list[str], start: str, end: str, length_tol=7, end_tol=7) -> DataFrame:
    """Each statement with the latest comparable one of the year before.

    Statements of one period (keys, start, end) are one: the pair cannot tell them apart, so a hot key shrinks to its
    periods before it is shuffled. Year ends and lengths are bucketed by the width of their tolerances; this
    is an equi-join on (keys, year, both buckets) in which a statement meets at most four buckets, and a bucket holds
    no more periods than days squared, whatever the number of rows.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bucket = lambda days, tol: F.floor(days / (2 * tol + 1))
    both = lambda days, tol: F.explode(F.array_distinct(F.array(bucket(days - tol, tol), bucket(days + tol, tol))))
    s = cap(statements, [*keys, end, start], [F.xxhash64(*[F.col(f"`{c}`") for c in statements.columns])], 1)
    s = computed(s, _year=F.year(end), _len=F.datediff(end, start), _day=day(F.col(end)))
    new = s.withColumn("_at", both(F.col("_day"), end_tol)).withColumn("_long", both(F.col("_len"), length_tol))
    old = computed(s, _ann=F.add_months(end, 12))
    old = old.select(
        *keys, (F.col("_year") + 1).alias("_year"), bucket(day(F.col("_ann")), end_tol).alias("_at"), bucket(F.col("_len"), length_tol).alias("_long"),
        F.col("_ann").alias("prior__ann"), *[F.col(c).alias(f"prior_{c}") for c in s.columns if c not in keys],
    )
    joined = new.join(old, [*keys, "_year", "_at", "_long"])
    fits = (F.abs(F.col("_len") - F.col("prior__len")) <= length_tol) & (F.abs(F.datediff(end, "prior__ann")) <= end_tol)
    best = cap(joined.filter(fits), [*keys, end, start], [F.col(f"prior_{end}").desc(), F.col(f"prior_{start}").desc()], 1)
    return best.drop("_year", "_len", "_day", "_at", "_long", "prior__year", "prior__len", "prior__day", "prior__ann")


def prior_success(observations: DataFrame, keys: list[str], order: list[str], ok: Column, keep: Column) -> DataFrame:
    """For every observation, the latest earlier one that succeeded."""
    return running(observations, keys, order, F.when(ok, keep), "prior", how="last", inclusive=False)


def in_cooldown(log: DataFrame, host: str, order: list[str], at: str, limited: Column, wait: Column) -> DataFrame:
    """Does a request fall into a pause that an earlier limited request opened?

    ``at`` is a numeric time; the furthest pause end so far is a running maximum.
    """
    ends = F.when(limited, F.col(at) + wait)
    out = running(log, [host], order, ends, "_until", how="max", inclusive=False)
    return out.withColumn("cooling", F.coalesce(F.col(at) < F.col("_until"), F.lit(False))).drop("_until")


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds named by a Retry-After header (a number or an HTTP date), else 60."""
    number = header.try_cast("double")
    dated = F.try_to_timestamp(
        F.regexp_extract(header, r"\A[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\z", 1),
        F.lit("dd MMM yyyy HH:mm:ss"),
    )
    until = F.unix_micros(dated) / 1e6 - now
    usable = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
    return F.when(usable, number).when(number.isNotNull(), 60.0).when(until.isNotNull(), F.greatest(until, F.lit(0.0))).otherwise(60.0)


def match_positions(expected: DataFrame, actual: DataFrame, index: str, value: str) -> DataFrame:
    """Positions where the expected and actual value differ or one is absent."""
    e = expected.select(index, F.col(value).alias("expected"))
    a = actual.select(index, F.col(value).alias("actual"))
    both = e.join(a, index, "full_outer")
    return both.withColumn("matches", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def match_prefix(urls: DataFrame, rules: DataFrame, host: str, path: str, rule: str, order: str) -> DataFrame:
    """The first rule of the host, in file order, that begins the path.

    Paths are cut at the rule lengths the host really uses, which turns the
    prefix test into an equi-join and never pairs every path with every rule.
    """
    r = computed(rules, _len=F.char_length(rule))
    lengths = r.select(host, "_len").distinct()
    cut = urls.join(lengths, host).filter(F.char_length(path) >= F.col("_len"))
    cut = computed(cut, _cut=F.substring(F.col(path), F.lit(1), F.col("_len")))
    hits = cut.join(r.withColumnRenamed(rule, "_cut"), [host, "_len", "_cut"])
    ids = [c for c in urls.columns]
    first = cap(hits, ids, [F.col(order)], 1)
    return first.select(*ids, F.col("_cut").alias(rule), *[c for c in rules.columns if c not in (host, rule)])


def first_alias(bodies: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first URL of one body per owner, note the later ones."""
    lead = bodies.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_lead"))
    note = F.when(F.struct(*order) != F.col("_lead"), F.lit("duplicate_snapshot_source_skipped"))
    return bodies.join(lead, keys).withColumn("note", note).drop("_lead")


def compare_profiles(claims: DataFrame, key: str, left, right, field: str, value: str, tie: str) -> DataFrame:
    """The facts of two profiles, field by field, aligned by ordinal."""
    def side(which, name):
        rows = claims.filter(F.col(key) == which).select(field, value, tie)
        return numbered(rows, [value, tie], "ordinal", keys=[field]).select(field, "ordinal", F.col(value).alias(name))

    return side(left, "left_value").join(side(right, "right_value"), [field, "ordinal"], "full_outer")


def attach_sources(entities: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """J14"""
    return entities.join(manifest, key, "left")
