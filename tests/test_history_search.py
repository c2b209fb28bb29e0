"""Validity intervals against each run's own view, and the search index against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from vouchlake.plans import intervals, report, search

VIEW = "org string, subject string, value string, status string"


def test_every_run_is_rebuilt(spark, tmp_path):
    """Three runs, the second failed for one entity: values change, vanish and come back; a repeated merge changes nothing."""
    views = {
        "2024-01-01": [("a", "s", "1", "current"), ("a", "t", "2", "current"), ("b", "s", None, "current")],
        "2024-01-02": [("a", "s", "1", "last_known"), ("a", "t", "2", "last_known"), ("b", "s", "5", "current")],
        "2024-01-03": [("a", "s", "1", "current"), ("b", "s", None, "current"), ("c", "s", "9", "current")],
    }
    path, before = str(tmp_path), None
    for at, rows in views.items():
        for _ in range(2):
            intervals.merge_run(spark, spark.createDataFrame(rows, VIEW), path, at, before)
        before = at
    for at, rows in views.items():
        got = intervals.as_of(spark, path, at, before).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, rows)), at
    assert spark.read.parquet(f"{path}/closed").count() == 6


@pytest.mark.parametrize("query", ["en the", "É", "", "ab", "aba", "ABAB", "zzz", "ø x", "  b a "])
def test_index_gives_the_rows_of_a_scan(spark, tmp_path, query):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abÉéø xEN the") for _ in range(rng.choice([0, 2, 30, 200]))), ["q", None, "ab"]) for i in range(150)] + [(200, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, vals array<string>")
    search.build_index(df, "id", search.searched_text(["id", "name"], "vals"), str(tmp_path))
    got = sorted(r.key for r in search.search_index(spark, str(tmp_path), query).collect())
    want = sorted(r.id for r in report.search_profiles(df.withColumn("vals", F.col("vals")), query, ["id", "name"], "vals").collect())
    assert got == want


def test_postings_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(i, f"name {i} of somebody") for i in range(50)], "id long, name string")
    search.build_index(df, "id", search.searched_text(["name"]), str(tmp_path))
    text = search.search_index(spark, str(tmp_path), "body")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in text and "PushedFilters: [In(piece" in text
