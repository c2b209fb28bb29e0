"""Nine-digit organisation keys with a weighted modulo-11 check digit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .canon import as_col
from .fixed import KEY_WEIGHTS


def _check_char(stem: Column) -> Column:
    """Check character of an eight-digit stem; 'X' where no digit exists."""
    weighted = [(F.ascii(F.substring(stem, i + 1, 1)) - 48) * w for i, w in enumerate(KEY_WEIGHTS)]
    return F.substring(F.lit("0X987654321"), reduce(lambda a, b: a + b, weighted) % 11 + 1, F.lit(1))


def check_digit(stem) -> Column:
    """Check digit of an eight-digit stem as text; NULL when the stem has no valid key."""
    return F.nullif(_check_char(as_col(stem)), F.lit("X"))


def is_valid_key(number) -> Column:
    number = as_col(number)
    stem = F.substring(number, 1, 8)
    shaped = number.rlike(r"\A[0-9]{9}\z")
    return F.coalesce(shaped & (_check_char(stem) == F.substring(number, 9, 1)), F.lit(False))


def validate_keys(df: DataFrame, column: str = "organisation_number") -> DataFrame:
    """Keep every row, say whether its key is valid and why not."""
    ok = is_valid_key(column)
    return df.withColumn("key_valid", ok).withColumn(
        "reject_reason", F.when(~ok, F.lit("invalid_organisation_number"))
    )
