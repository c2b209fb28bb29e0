"""Ordered work per key that survives a key holding a large share of all rows.

``cap`` and its variants keep at most n rows per key; Spark prunes to n per key
before the shuffle. Running values cannot be pruned, so ``running`` lays rows out
in (key, order) ranges, works inside each range and carries one value per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vouchlake.functions.canon import as_col, computed
from vouchlake.session import durable


def cap(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows per key."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in discovery order."""
    return cap(df, keys, order, 1)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key."""
    return cap(df, keys, [F.col(c).desc() for c in order], 1)


def slices(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in (keys, order) ranges of similar size, stored once, numbered by ``_slice``."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(count, *[F.col(c) for c in [*keys, *order]])
    return durable(laid.withColumn("_slice", F.spark_partition_id()))


def running(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, how: str = "sum", inclusive: bool = True
) -> DataFrame:
    """Running sum, max or last non-null of ``value`` per key in ascending order.

    Only a key that began in an earlier slice needs a carried value, and a slice
    can continue one key at most, so the carry table has no more rows than slices.
    """
    laid = slices(computed(df, _value=value), keys, order)
    within = Window.partitionBy("_slice", *keys).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*[F.col(c) for c in order])
    if how == "sum":
        total, carry, local = F.sum("_value"), F.sum("_total").over(across), F.sum("_value").over(within)
    elif how == "max":
        total, carry, local = F.max("_value"), F.max("_total").over(across), F.max("_value").over(within)
    elif how == "last":
        total = F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), at))
        carry, local = F.last("_total", True).over(across), F.last("_value", True).over(within)
    else:
        raise ValueError(f"unknown running aggregate: {how}")
    per_slice = laid.groupBy(*keys, "_slice").agg(total.alias("_total"))
    carried = per_slice.withColumn("_carry", carry).filter(F.col("_carry").isNotNull())
    carried = carried.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_at"), "_carry")
    match = F.col("_slice") == F.col("_at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = laid.withColumn("_local", local).join(F.broadcast(carried), match, "left")
    if how == "sum":
        result = F.when(
            F.col("_local").isNotNull() | F.col("_carry").isNotNull(),
            F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0)),
        )
    elif how == "max":
        result = F.greatest("_local", "_carry")
    else:
        result = F.coalesce("_local", "_carry")
    return joined.withColumn(out, result).select(*df.columns, out)


def numbered(df: DataFrame, order: list[str], out: str, keys: list[str] | None = None) -> DataFrame:
    """Zero-based position in ascending order, over all rows or per key."""
    return running(df, keys or [], order, F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) - 1)


def ordered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """A distributed range sort."""
    return df.orderBy(*keys)


def interleave(df: DataFrame, keys: list[str], family: str, rank: list[Column], first: list[str], limit: int | None = None) -> DataFrame:
    """Alternate the families in ``first`` by rank, then everything else.

    With ``limit`` at most so many links per key and family enter.
    """
    known = F.col(family).isin(*first)
    turn = F.when(known, F.array_position(F.array(*[F.lit(f) for f in first]), F.col(family))).otherwise(F.lit(99))
    rows = computed(df, _group=F.when(known, F.col(family)).otherwise(F.lit("")), _turn=turn)
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_group").orderBy(*rank)))
    if limit is not None:
        ranked = ranked.filter(F.col("_rn") <= limit)
    position = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.when(F.col("_turn") == 99, 1).otherwise(0), "_rn", "_turn")
    )
    return ranked.withColumn("position", position).drop("_group", "_turn", "_rn")


def last_wins(journal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last journal row per input; a failed or blocked one removes an earlier success."""
    return latest_per(journal, [key], order).filter(~F.col("state").isin("failed", "blocked"))


def change_history(observations: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each observation with the value before it and the kind of change."""
    seen = F.struct(F.col(value).alias("v"))
    out = running(observations, keys, order, seen, "_before", how="last", inclusive=False)
    before = F.col("_before.v")
    kind = (
        F.when(F.col("_before").isNull(), F.lit("first"))
        .when(before.eqNullSafe(F.col(value)), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return out.select(*observations.columns, before.alias("before"), kind.alias("kind"))


def admit_requests(
    log: DataFrame, request: str, source: str, order: list[str], in_time: Column, limit: int, per_input: int
) -> DataFrame:
    """Admit requests in order under a deadline, a per-input and a global budget."""
    eligible = cap(log.filter(in_time), [source], [F.col(c) for c in order], per_input)
    placed = running(eligible, [], order, F.lit(1).cast("bigint"), "_place")
    admitted = placed.filter(F.col("_place") <= limit).select(request, source)
    used = admitted.groupBy(source).agg(F.count("*").alias("_used"))
    rows = (
        log.withColumn("_in_time", in_time)
        .join(admitted.select(request, F.lit(True).alias("_ok")), request, "left")
        .join(used, source, "left")
    )
    ok = F.coalesce("_ok", F.lit(False))
    reason = (
        F.when(ok, F.lit(None).cast("string"))
        .when(~F.col("_in_time"), F.lit("deadline_exhausted"))
        .when(F.col("_used") >= per_input, F.lit("input_request_budget_exhausted"))
        .otherwise(F.lit("global_request_budget_exhausted"))
    )
    return rows.select(*log.columns, ok.alias("admitted"), reason.alias("reason"))


def pace(frontier: DataFrame, host: str, order: list[str], delay: Column) -> DataFrame:
    """Start second of each request when one host is asked strictly in turn."""
    out = running(frontier, [host], order, delay, "_end")
    return out.withColumn("slot", F.col("_end") - delay).drop("_end")


def short_list(df: DataFrame, keys: list[str], label: str, order: list[Column], n: int = 4) -> DataFrame:
    """The first n labels, then how many more there are."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    top = cap(df, keys, order, n, rank="_rn").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rn", F.col(label).alias("label")))).alias("_top")
    )
    more = F.when(F.col("_n") > n, F.concat(F.lit(" and "), (F.col("_n") - n).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    text = F.concat(F.array_join(F.transform("_top", lambda x: x["label"]), ", "), more)
    return top.join(counts, keys).select(*keys, text.alias("text"))


def first_verified(candidates: DataFrame, key: str, order: str, verified: str) -> DataFrame:
    """Earlier candidates rejected, the first proven one verified, later ones untouched."""
    best = candidates.groupBy(key).agg(F.min(F.when(F.col(verified), F.col(order))).alias("_best"))
    status = (
        F.when(F.col(order) == F.col("_best"), F.lit("verified"))
        .when(F.col("_best").isNull() | (F.col(order) < F.col("_best")), F.lit("rejected"))
        .otherwise(F.col("status"))
    )
    return candidates.join(best, key).withColumn("status", status).drop("_best")
