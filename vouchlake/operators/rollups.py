"""Aggregations. All reduce before the shuffle, so a hot key costs one row per map task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.functions import fixed
from .windows import cap, keep_first, running


def state_counts(df: DataFrame, measures: dict[str, Column] | None = None, states=fixed.STATES) -> DataFrame:
    """A1: one row for every state, absent states as zero."""
    measures = measures or {"n": F.count("*")}
    counted = df.groupBy("state").agg(*[m.alias(n) for n, m in measures.items()])
    frame = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("state"))
    return frame.join(counted, "state", "left").select(
        "state", *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in measures]
    )


def run_totals(df: DataFrame, sums: list[str], fresh_only: list[str], resumed: str, cost: str | None = None) -> DataFrame:
    """A2: totals of a run; the columns in ``fresh_only`` skip resumed rows."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    aggs += [F.coalesce(F.sum(F.when(~F.col(resumed), F.col(c))), F.lit(0)).alias(c) for c in fresh_only]
    if cost:
        aggs.append(F.round(F.coalesce(F.sum(F.when(~F.col(resumed), F.col(cost))), F.lit(0.0)), 6).alias(cost))
    return df.agg(F.count("*").alias("rows"), *aggs)


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """A3: exact nearest-rank percentiles, NULL when there are no rows.

    Counts per distinct value, then a running count over value ranges: no task
    ever holds all values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    below = running(counts, [], [value], F.col("_n"), "_cum")
    total = below.agg(F.max("_cum")).first()[0] or 0
    return below.agg(
        *[F.min(F.when(F.col("_cum") >= math.ceil(total * p), F.col(value))).alias(name) for name, p in shares.items()]
    )


def merge_evidence(evidence: DataFrame, key: str, identity: list[str], seen_at: str) -> DataFrame:
    """A4: one row per id with first and last retrieval; disagreeing identities are marked."""
    mark = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})
    return evidence.groupBy(key).agg(
        F.min(seen_at).alias("retrieved_at"),
        F.max(seen_at).alias("last_retrieved_at"),
        F.count_distinct(seen_at).alias("n_retrievals"),
        (F.min(mark) != F.max(mark)).alias("identity_conflict"),
    )


def retrieval_times(evidence: DataFrame, key: str, seen_at: str) -> DataFrame:
    """A4: the distinct retrieval times of each id, as rows."""
    return evidence.select(key, seen_at).distinct()


def claim_spans(excerpts: DataFrame, key: str, ordinal: str, text: str) -> DataFrame:
    """A5: ordered distinct excerpts per evidence row, joined by newlines into one value."""
    first = keep_first(excerpts, [key, text], [F.col(ordinal)])
    return (
        first.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(text).alias("t")))).alias("_all"))
        .select(key, F.array_join(F.transform("_all", lambda x: x["t"]), "\n").alias("claim_span"))
    )


def profile_metrics(claims: DataFrame, key: str, evidence: str) -> DataFrame:
    """Facts and distinct evidence per profile."""
    return claims.groupBy(key).agg(F.count("*").alias("facts"), F.count_distinct(evidence).alias("evidence_records"))


def rollup_state(states: DataFrame, key: str, priority=fixed.STATE_PRIORITY) -> DataFrame:
    """The strongest state per key; none of the known states means not_available."""
    rank = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col("state"))
    best = F.min(F.when(rank > 0, rank))
    names = F.array(*[F.lit(s) for s in priority])
    return states.groupBy(key).agg(best.alias("_r")).select(
        key, F.coalesce(F.try_element_at(names, F.col("_r").cast("int")), F.lit("not_available")).alias("state")
    )


def drop_conflicts(df: DataFrame, keys: list[str], fingerprint: str, order: list[str], last: bool = False) -> DataFrame:
    """Keys whose rows disagree vanish; agreeing duplicates collapse to the first (or last) row.

    One aggregation decides both, so the rows above it are computed once.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    merged = df.groupBy(*keys).agg(F.min(fingerprint).alias("_lo"), F.max(fingerprint).alias("_hi"), pick.alias("_row"))
    return merged.filter(F.col("_lo").eqNullSafe(F.col("_hi"))).select(*keys, "_row.*").select(*df.columns)


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A10: the first row of every distinct value."""
    return keep_first(df, keys, order)


def rollup_availability(df: DataFrame, keys: list[str], stage: list[str]) -> DataFrame:
    """The state of the last stage that spoke about a field."""
    return cap(df, keys, [F.col(s).desc() for s in stage], 1).select(*keys, "state", "reason")


def query_cost(queries: Column, unit: float = fixed.QUERY_PRICE) -> Column:
    """A12"""
    return F.round(queries * F.lit(unit), 6)


def request_counts(log: DataFrame, source: str) -> DataFrame:
    """Requests per input and, with a NULL input, in total."""
    return log.rollup(source).agg(F.count("*").alias("requests"))


def audit_totals(checks: DataFrame, results: str, failed: Column) -> DataFrame:
    """A14"""
    return checks.agg(
        F.count("*").alias("claims_checked"),
        F.count_distinct(results).alias("results_checked"),
        F.count_if(failed).alias("violations"),
        F.coalesce(F.bool_and(~failed), F.lit(True)).alias("passed"),
    )


def single_label(labels: DataFrame, page: str, number: str, expected: str) -> DataFrame:
    """Does the set of labelled numbers on a page equal the one expected number?"""
    return labels.groupBy(page, expected).agg(
        F.count(number).alias("n_labels"),
        F.coalesce((F.min(number) == F.col(expected)) & (F.max(number) == F.col(expected)), F.lit(False)).alias("single"),
    )
