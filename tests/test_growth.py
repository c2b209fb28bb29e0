"""Work that grew faster than its tables: what plans and stored tables must not hold again."""

import random

from pyspark.sql import functions as F

from bindings import discovery as bound
from vouchlake.operators import joins
from vouchlake.plans import search, summary
from vouchlake.sources import landing
from vouchlake.streaming import feeds, history


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_manifest_urls_are_normalised_once(spark):
    rows = [("810000009", i, f"court.example.org/{i % 3}#top", "news", True) for i in range(6)]
    out = landing.check_manifest(spark.createDataFrame(rows, "organisation_number string, ord long, url string, kind string, access_reviewed boolean"))
    assert "ArrowEvalPython" not in plan(out)
    assert sorted(r.url for r in out.collect()) == sorted(f"https://court.example.org/{i % 3}" for i in range(6))


def test_frontier_pages_are_dealt_out(spark, tmp_path):
    spark.range(9_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert "RoundRobinPartitioning" in plan(bound._c18(spark, str(tmp_path)))


def test_posting_names_a_block_of_texts(spark, tmp_path):
    """Texts that share their pieces share postings; each text is found, also one that only a part of its block holds."""
    rows = [(i, "the same words" if i % 7 else f"other words {i}") for i in range(640)]
    df = spark.createDataFrame(rows, "id long, name string").coalesce(1)
    search.build_index(df, "id", search.searched_text(["name"]), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings").filter("piece = 'ame'").count() == 640 / search.BLOCK
    assert sorted(r.key for r in search.search_index(spark, str(tmp_path), "other words 14").collect()) == [14, *range(140, 150, 7)]


def test_latest_statement_meets_the_periods_that_j7_pairs(spark):
    """The summary's own comparison names the same prior statement as J7 over all of them, without a window per period."""
    rng, day = random.Random(12), lambda y, m, d: f"{y}-{m:02d}-{d:02d}"
    rows = []
    for org in range(60):
        for n in range(rng.randint(1, 7)):
            y = rng.randint(2018, 2023)
            rows.append((str(org), rng.choice(["S", "K"]), rng.choice(["NOK", "EUR"]), rng.choice([day(y, 1, 1), day(y, 1, 6), day(y - 1, 12, 30)]), rng.choice([day(y, 12, 31), day(y, 12, 25), day(y, 6, 30)]), rng.randint(1, 9) * 100, n))
    f = spark.createDataFrame(rows, "organisation_number string, report_type string, currency string, period_start string, period_end string, amount long, ord long")
    value = F.to_json(F.struct(F.lit("revenue").alias("metric"), "amount", "currency", "report_type", "period_start", "period_end"))
    got = summary._finance(f.select(summary.ORG, F.lit("financials").alias("field"), value.alias("value_json"), "ord"))
    assert "Window" not in plan(got) and "WindowGroupLimit" not in plan(got)
    s = f.withColumns({c: F.col(c).cast("date") for c in ("period_start", "period_end")})
    keys = [summary.ORG, "report_type", "currency"]
    single = s.groupBy(*keys, "period_end", "period_start").agg(F.min_by("amount", "ord").alias("amount"))
    before = joins.comparable_periods(single, keys, "period_start", "period_end").select(*keys, "period_end", "period_start", "prior_amount")
    last = s.groupBy(summary.ORG).agg(F.max_by(F.struct("report_type", "currency", "period_start", "period_end", "amount"), F.struct("period_end", -F.col("ord"))).alias("l")).select(summary.ORG, "l.*")
    want = {r[0]: (r.amount, r.prior_amount) for r in last.join(before, [*keys, "period_end", "period_start"], "left").collect()}
    told = {r[0]: r.p_revenue for r in got.collect()}
    assert set(told) == set(want) and sum(p is not None for _, p in want.values()) > 3
    for org, (amount, prior) in want.items():
        tail = "; no comparable prior period was available" if prior is None else f"{abs((amount - prior) / prior * 100):.1f}% year over year"
        assert told[org].startswith(f"Revenue was {amount} ") and told[org].endswith(tail), (org, amount, prior, told[org])


def test_only_first_rows_of_keys_reach_python_state(spark, tmp_path):
    """One row per key and batch, over however many days the key's rows lie."""
    rows = [(i, f"k{i % 3}", (i + 1) * 86_400, i % 2) for i in range(30)] + [(99, "end", 9_000_000, 0)]
    df = spark.createDataFrame(rows, "id long, k string, s long, v long").select("id", "k", F.timestamp_seconds("s").alias("ts"), "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    history.stream_changes(feeds.open_feed(spark, f"{tmp_path}/in"), ["k"], ["ts", "id"], "v", f"{tmp_path}/out", "ts", "1 day", "1 day")
    assert spark.read.parquet(f"{tmp_path}/out/first/*").count() == 3
    assert history.read_changes(spark, f"{tmp_path}/out").count() == 30
