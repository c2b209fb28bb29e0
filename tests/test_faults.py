"""Cases that once gave wrong answers: bulk files, dotted columns, hosts, robots, conflicts, repeated contract rows."""

import json

import pytest

from vouchlake import session
from vouchlake.functions import urls
from vouchlake.operators import gates, rollups
from vouchlake.plans import contract
from vouchlake.sources import bulk


def test_bulk_csv_guard_and_headers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("organisasjonsnummer;navn\n1;A\n2;B;extra\n")
    rows = bulk.read_bulk_csv(spark, str(tmp_path / "a"))
    with pytest.raises(Exception, match="invalid_bulk_columns"):
        rows.select("navn").collect()
    wanted = spark.createDataFrame([("1",)], "k string")
    assert [r.navn for r in bulk.read_bulk_csv(spark, str(tmp_path / "a"), wanted).collect()] == ["A"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.csv").write_text("organisasjonsnummer;navn\n1;A\n")
    (tmp_path / "b" / "2.csv").write_text("navn;organisasjonsnummer\nB;2\n")
    with pytest.raises(Exception):
        bulk.read_bulk_csv(spark, str(tmp_path / "b")).collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text('organisasjonsnummer;navn\n1;"A\nB"\n')
    assert bulk.read_bulk_csv(spark, str(tmp_path / "c"), multi_line=True).first().navn == "A\nB"


def test_dotted_columns_keep_values(spark):
    df = spark.createDataFrame([("1", "a,}b", None, "x"), ("2", '"q":{},', "y", None)], "k string, navn string, `a.b.c` string, `a.d` string")
    out = {r.k: json.loads(r.record_json) for r in bulk.nest_dotted_columns(df, ["navn", "a.b.c", "a.d"], ["k"]).collect()}
    assert out == {"1": {"navn": "a,}b", "a": {"d": "x"}}, "2": {"navn": '"q":{},', "a": {"b": {"c": "y"}}}}


def test_foreign_hosts(spark):
    df = spark.createDataFrame([("https://www.blåbær.no/",), ("https://ærø.dk/x",)], "u string")
    assert {r.reject_reason for r in urls.normalize_urls(df, "u").collect()} == {None}


def test_robots_answered_twice(spark):
    frontier = spark.createDataFrame([("h.no", "/a"), ("h.no", "/b"), (None, "/c")], "host string, path string")
    robots = spark.createDataFrame([("h.no", 200, "User-agent: *\nDisallow: /a", "2024-01-02"), ("h.no", 500, None, "2024-01-01")], "host string, http_status int, body string, retrieved_at string")
    out = sorted((str(r.host), r.path, str(r.reason)) for r in gates.filter_robots(frontier, robots, "bot").collect())
    assert out == [("None", "/c", "robots_unavailable"), ("h.no", "/a", "robots_disallowed"), ("h.no", "/b", "None")]


def test_evidence_conflict_sees_nulls(spark):
    df = spark.createDataFrame([("e", "a", None, "1"), ("e", None, "a", "2"), ("f", "a", None, "1"), ("f", "a", None, "2")], "id string, p string, q string, t string")
    assert {r.id: r.identity_conflict for r in rollups.merge_evidence(df, "id", ["p", "q"], "t").collect()} == {"e": True, "f": False}


def test_long_lists_stay_in_order(spark):
    df = spark.range(2500).selectExpr("'k' as k", "id", "concat('f', lpad(id, 5, '0')) as f")
    rows = contract.nest(df, ["k"], df.f, df.id, df.f, "claims").collect()
    assert len(rows) == 1 and rows[0].claims == [f"f{i:05d}" for i in range(2500)]


def test_shared_folder_is_asked_for():
    assert session.one_process("local[8]") and session.one_process("local")
    assert not session.one_process("local-cluster[3,2,1000]") and not session.one_process("yarn")

    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session)


def test_nothing_is_too_large_unless_the_caller_says_so(spark):
    from pyspark.sql import functions as F

    from vouchlake.sources import landing

    big = spark.range(1).select(F.repeat(F.lit("a"), 2_500_000).alias("body"))
    for html in (True, False):
        out = landing.mark_oversize(big, "body", F.lit(html)).select("size_error", F.length("body").alias("n")).first()
        assert (out.size_error, out.n) == (None, 2_500_000)
        out = landing.mark_oversize(big, "body", F.lit(html), 1000, 2_000_000).select("size_error", F.length("body").alias("n")).first()
        assert (out.size_error, out.n) == ("response_size_limit", 2_500_000)
    entries = spark.createDataFrame([("923609016", i, f"https://court.example.org/{i}", "news", True) for i in range(9)], "organisation_number string, ord int, url string, kind string, access_reviewed boolean")
    assert landing.accepted_manifest(entries).count() == 9
    assert landing.check_manifest(entries, 5).filter("fault is not null").count() == 9
    lines = big.select(F.concat(F.lit('{"organisasjonsnummer":"1","x":"'), "body", F.lit('"}')).alias("value"))
    rows = bulk.parse_bulk_jsonl(lines, "value")
    assert rows.select(F.length("record_json")).first()[0] > 2_500_000
    assert bulk.wrap_bulk(rows, "record_json", F.lit("0" * 64), "jsonl").select(F.length("body")).first()[0] > 2_500_000
