"""Organisation numbers as text or JSON lines, order and duplicates kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vouchlake.functions.canon import as_col, computed, whole_json
from vouchlake.operators.registry_facts import unquoted
from vouchlake.operators.windows import numbered
from .files import all_lines
from .lines import PLACE

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def input_number(line) -> Column:
    """The number a line names: its text, a JSON scalar, or a field of a JSON object."""
    raw = F.regexp_replace(as_col(line), EDGES, "")
    v = whole_json(raw)
    whole = F.to_json(v)
    scalar = lambda j: F.when(j == "null", F.lit("")).when(j == "true", F.lit("True")).when(j == "false", F.lit("False")).otherwise(
        F.coalesce(unquoted(j), j)
    )
    field = F.coalesce(
        F.to_json(F.try_variant_get(v, "$.organisation_number", "variant")),
        F.to_json(F.try_variant_get(v, "$.organisasjonsnummer", "variant")),
        F.lit('""'),
    )
    return F.when(v.isNull(), raw).when(whole.startswith("{"), scalar(field)).when(whole.startswith("["), raw).otherwise(scalar(whole))


def parse_input_lines(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Every non-blank line of a text column, with its number."""
    lines = df.select(*order, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("line_no", "line"))
    lines = lines.filter(F.regexp_replace("line", EDGES, "") != "")
    return computed(lines, organisation_number=input_number("line")).drop("line")


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Input files to (input_index, organisation_number); gzip is told by its first bytes."""
    # Splits of one file are ordered by their offset, lines of a split by their running id.
    rows = parse_input_lines(all_lines(spark, path), "line", PLACE)
    return numbered(rows, [*PLACE, "line_no"], "input_index").select("input_index", "organisation_number")
