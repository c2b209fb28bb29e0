"""Annual statements: growth between comparable periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def year_over_year(pairs: DataFrame, now: str, before: str) -> DataFrame:
    """Percent change and direction; none when the earlier amount is zero or absent."""
    change = (F.col(now) - F.col(before)) * F.lit(100.0) / F.abs(F.col(before))
    usable = F.col(before).isNotNull() & (F.col(before) != 0) & F.col(now).isNotNull()
    return pairs.withColumn("pct", F.when(usable, change)).withColumn(
        "direction",
        F.when(F.col("pct") > 0, "up").when(F.col("pct") < 0, "down").when(F.col("pct") == 0, "unchanged"),
    )
