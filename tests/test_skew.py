"""Ordered work must give the same answer when one key holds most rows and spans many ranges."""

import random

from pyspark.sql import functions as F

from vouchlake.operators import joins, rollups, walk, windows
from vouchlake.session import spread


def hot(spark, n=3000):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"k{i % 17}", i // 2, rng.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, t long, v long").repartition(5)


def test_running_sum_max_last(spark):
    rows, df = hot(spark)
    got = {r.id: (r.s, r.m, r.p) for r in _all(df).collect()}
    state = {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        total, top, last = state.get(k, (0, None, None))
        assert got[i] == (total + v, top, last)
        state[k] = (total + v, v if top is None else max(top, v), v if v > 4 else last)


def _all(df):
    out = windows.running(df, ["k"], ["t", "id"], F.col("v"), "s")
    out = windows.running(out, ["k"], ["t", "id"], F.col("v"), "m", how="max", inclusive=False)
    return windows.running(out, ["k"], ["t", "id"], F.when(F.col("v") > 4, F.col("v")), "p", how="last", inclusive=False)


def test_hot_key_is_spread_over_slices(spark):
    _, df = hot(spark)
    laid = windows.slices(df, ["k"], ["t", "id"])
    share = laid.groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert share < df.count() / 3


def test_null_keys_carry_too(spark):
    df = spark.createDataFrame([(i, None, i, 1) for i in range(200)], "id long, k string, t long, v long")
    out = windows.running(df, ["k"], ["t"], F.col("v"), "s").agg(F.max("s")).first()[0]
    assert out == 200


def test_numbered_is_dense(spark):
    _, df = hot(spark)
    got = sorted(r.n for r in windows.numbered(df, ["t", "id"], "n").collect())
    assert got == list(range(3000))


def test_nearest_rank_empty_and_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    row = rollups.nearest_rank(df, "v", {"a": 0.5, "b": 0.95}).first()
    assert (row.a, row.b) == (2.0, 4.0)
    assert rollups.nearest_rank(df.filter("v > 9"), "v", {"a": 0.5}).first().a is None


def test_leap_year_anniversary(spark):
    rows = [("o", "2023-03-01", "2024-02-29", 5), ("o", "2022-03-01", "2023-02-28", 4), ("o", "2022-01-01", "2023-12-31", 3)]
    df = spark.createDataFrame(rows, "k string, s string, e string, v int").selectExpr("k", "cast(s as date) s", "cast(e as date) e", "v")
    got = joins.comparable_periods(df, ["k"], "s", "e").select("v", "prior_v").collect()
    assert [tuple(r) for r in got] == [(5, 4)]


def test_retry_after(spark):
    df = spark.createDataFrame([("30",), ("-1",), ("inf",), (None,), ("Tue, 16 Jan 2024 00:02:00 GMT",), ("soon",)], "h string")
    now = F.lit(1705363200.0)
    got = [r[0] for r in df.select(joins.retry_after_seconds(F.col("h"), now)).collect()]
    assert got == [30.0, 60.0, 60.0, 60.0, 120.0, 60.0]


def test_admission_reasons(spark):
    rows = [(i, 0 if i < 5 else 1, i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, src long, t long")
    out = windows.admit_requests(df, "id", "src", ["t"], F.col("t") < 9, 5, 3)
    got = {r.id: r.reason for r in out.collect()}
    assert [got[i] for i in range(10)] == [None, None, None, "input_request_budget_exhausted", "input_request_budget_exhausted", None, None, "global_request_budget_exhausted", "global_request_budget_exhausted", "deadline_exhausted"]


def test_resolved_nodes_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, '{"a":[5,{"b":"x"}]}'), (2, '{"a":7}')], "id long, body string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))  # its size is known, and small
    claims = spark.createDataFrame([(1, "/a/1/b"), (1, "/a/9"), (2, "/a")], "id long, json_pointer string")
    out = walk.resolve_pointers(claims, walk.walk_json(docs, "body", ["id"], only_objects=False), ["id"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.json_pointer, r.resolved_json) for r in out.collect()) == [(1, "/a/1/b", '"x"'), (1, "/a/9", None), (2, "/a", "7")]


def test_costly_rows_are_dealt_by_their_number(spark):
    assert spread(spark.range(0, 1000, 1, 8), rows=10).rdd.getNumPartitions() == 100
    assert spread(spark.range(0, 1000, 1, 8), rows=1000).rdd.getNumPartitions() == 8
