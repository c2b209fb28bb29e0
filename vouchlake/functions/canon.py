"""Column expressions shared by the jobs: hashes, canonical JSON, names, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Unicode whitespace plus the separators Python also treats as blank.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once per row.

    A one-element generator stands between the expressions and later filters, so
    Catalyst cannot copy a long expression into every place that reads the column.
    """
    fresh = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fresh)))


def whole_json(text) -> Column:
    """The VARIANT of a text that is one JSON value and nothing else.

    Spark's parser stops after the first value. What follows it breaks the text in brackets, or the
    text as a member where it begins by closing the bracket.
    """
    text = as_col(text)
    holds = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return F.when(holds("[", "]") & holds('{"v":', "}"), F.try_parse_json(text))


def canonical_json(text) -> Column:
    """Sorted keys, compact, NULL for anything that is not strict JSON."""
    return F.to_json(whole_json(text))


def json_text(value) -> Column:
    """A plain column value written as canonical JSON; NULL stays NULL."""
    text = F.regexp_extract(F.to_json(F.struct(as_col(value).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(as_col(value).isNotNull(), text)


def digest(*parts) -> Column:
    return F.sha2(F.concat(*[as_col(p) for p in parts]), 256)


def is_missing_json(value_json) -> Column:
    """Only null, '', [] and {} are missing; 0 and false are facts."""
    value = as_col(value_json)
    return value.isNull() | value.isin("null", '""', "[]", "{}")


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(as_col(text), BLANK, " "))


def fold(text) -> Column:
    return F.replace(F.lower(as_col(text)), F.lit("ß"), F.lit("ss"))


def normal_name(text) -> Column:
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def contains_name(text_norm, name_norm) -> Column:
    """Whole-token containment of one normalised name in a normalised text."""
    pad = lambda c: F.concat(F.lit(" "), as_col(c), F.lit(" "))
    return (F.length(as_col(name_norm)) > 0) & F.contains(pad(text_norm), pad(name_norm))


def digits(text) -> Column:
    return F.regexp_replace(as_col(text), "[^0-9]", "")


def code_points(text) -> Column:
    return F.char_length(as_col(text))


def slice_text(text, start, end) -> Column:
    """text[start:end] in code points, zero based."""
    start, end = as_col(start), as_col(end)
    return F.substring(as_col(text), start + 1, F.greatest(end - start, F.lit(0)))


def utc_date(text) -> Column:
    """Strict ISO date, or the UTC date of a datetime that names its offset; else NULL."""
    text = as_col(text)
    plain = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))
    zoned = F.when(
        text.rlike(r"\A\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})\z"),
        F.date_add(
            F.lit("1970-01-01").cast("date"),
            F.floor(F.unix_seconds(text.try_cast("timestamp")) / 86400).cast("int"),
        ),
    )
    return F.coalesce(plain, zoned)


def has_offset(text) -> Column:
    return as_col(text).rlike(r"(Z|[+-]\d{2}:\d{2})\z") & as_col(text).try_cast("timestamp").isNotNull()


def pointer_token(text) -> Column:
    return F.replace(F.replace(as_col(text), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def iso_date(value) -> Column:
    return F.date_format(as_col(value), "yyyy-MM-dd")
