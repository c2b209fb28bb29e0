import gzip
import json

import pytest
from pyspark.sql import functions as F

from vouchlake.functions import canon, keys, urls
from vouchlake.sources import bulk, inputs, landing


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("r")).first()[0]


def test_known_keys(spark):
    rows = spark.createDataFrame([("923609016",), ("923609017",), ("923609016\n",), ("92360901",), ("",), (None,), ("９２３６０９０１６",)], "n string")
    got = [r[0] for r in rows.select(keys.is_valid_key("n")).collect()]
    assert got == [True, False, False, False, False, False, False]


def test_canonical_json_and_missing(spark):
    rows = spark.createDataFrame([('{"b":1,"a":[true,null]}',), ("NaN",), ('{"a":1',), ("0",), ("false",), ('""',), ("{}",)], "j string")
    got = rows.select(canon.canonical_json("j"), canon.is_missing_json(canon.canonical_json("j"))).collect()
    assert [g[0] for g in got] == ['{"a":[true,null],"b":1}', None, None, "0", "false", '""', "{}"]
    assert [g[1] for g in got] == [False, True, True, False, False, True, True]


@pytest.mark.parametrize(
    "text,want",
    [("2024-01-02", "2024-01-02"), ("2024-01-02T23:30:00-02:00", "2024-01-03"), ("2024-01-02T10:00:00", None), ("2024-02-30", None), ("2. jan", None), ("2024-01-02T10:00:00Z", "2024-01-02")],
)
def test_utc_date(spark, text, want):
    got = one(spark, text, canon.utc_date("v"))
    assert (str(got) if got else None) == want


def test_names_and_slices(spark):
    assert one(spark, "  Blåbær-Gården A/S, Straße ", canon.normal_name("v")) == "blåbær gården a s strasse"
    assert one(spark, "😀 x org", canon.slice_text("v", F.lit(2), F.lit(5))) == "x o"
    assert one(spark, "a \n b", canon.collapse("v")) == "a b"


URLS = [
        ("example.no", "https://example.no/", None), ("https://Example.NO:443/a?b=c#d", "https://example.no/a?b=c", None), ("http://example.no", None, "https_public_urls_only"),
        ("https://u@example.no", None, "https_public_urls_only"), ("https://@example.no", "https://example.no/", None), ("https://example.no:x/", None, "https_public_urls_only"),
        ("https://127.0.0.1/", None, "ip_literals_not_allowed"), ("https://[::1]/", None, "ip_literals_not_allowed"), ("https://999.1.1.1/", "https://999.1.1.1/", None),
        ("https://intranet/", None, "non_public_hostname"), ("https://a.local/", None, "non_public_hostname"), ("https://a..no/", None, "invalid_hostname"),
        ("https://exa_mple.no/", None, "invalid_hostname"), ("https://example.no/a\\b", None, "invalid_url"), (None, None, "missing_url"), ("https://blåbær.no/", "https://xn--blbr-roah.no/", None),
    ]


def test_normalize_urls(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(URLS)], "i int, u string")
    got = {r.i: (r.norm_url, r.reject_reason) for r in urls.normalize_urls(df, "u", idna=True).collect()}
    assert got == {i: c[1:] for i, c in enumerate(URLS)}


HREFS = [
        ("https://a.no/x/y", "z", "https://a.no/x/z"), ("https://a.no/x/y", "../z?q=1", "https://a.no/z?q=1"), ("https://a.no/x/", "./", "https://a.no/x/"),
        ("https://a.no", "b", "https://a.no/b"), ("https://a.no/x?q", "?r=1", "https://a.no/x?r=1"), ("https://a.no/x", "//b.no/c", "https://b.no/c"), ("https://a.no/x", "mailto:q@a.no", "mailto:q@a.no"),
    ]


def test_resolve_href(spark):
    df = spark.createDataFrame(HREFS, "b string, h string, want string")
    for r in df.select("want", urls.resolve_href("b", "h").alias("got")).collect():
        assert r.got == r.want


def test_read_inputs(spark, tmp_path):
    lines = ["923609016", "", '{"organisation_number":"1"}', '{"organisasjonsnummer":2}', "null", "923609016", "{bad", "true"]
    want = ["923609016", "1", "2", "", "923609016", "{bad", "True"]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.bin").write_bytes(gzip.compress("\n".join(lines).encode()))
    for name in ("a.txt", "b.bin"):
        rows = inputs.read_inputs(spark, str(tmp_path / name)).orderBy("input_index").collect()
        assert [r.organisation_number for r in rows] == want
        assert [r.input_index for r in rows] == list(range(len(want)))


def test_bulk_csv_guards(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿organisasjonsnummer;navn\n1;A\n2;B\n2;C\n3;D;extra\n", encoding="utf-8")
    wanted = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert [r.navn for r in bulk.assert_unique_keys(bulk.read_bulk_csv(spark, str(path), wanted("1", "9"))).collect()] == ["A"]
    with pytest.raises(Exception, match="duplicate_bulk_company"):
        bulk.assert_unique_keys(bulk.read_bulk_csv(spark, str(path), wanted("2"))).collect()
    with pytest.raises(Exception, match="invalid_bulk_columns"):
        bulk.read_bulk_csv(spark, str(path), wanted("3")).collect()
    path.write_text("nope,navn\n1,A\n")
    with pytest.raises(ValueError, match="invalid_bulk_header"):
        bulk.read_bulk_csv(spark, str(path))


def test_bulk_jsonl_guards(spark):
    lines = spark.createDataFrame([('{"organisasjonsnummer":"1"}',), ("[1]",)], "value string")
    with pytest.raises(Exception, match="invalid_bulk_record"):
        bulk.parse_bulk_jsonl(lines, "value").collect()


def test_journal_damage_is_fatal_but_a_torn_end_is_not(spark):
    rows = spark.createDataFrame([(1, '{"a":1}', False), (2, '{"a"', True)], "n int, line string, torn boolean")
    assert landing.journal_rows(rows, ["n"], "line", F.col("torn")).count() == 1
    with pytest.raises(Exception, match="resume_checkpoint_invalid"):
        landing.journal_rows(rows.withColumn("torn", F.lit(False)), ["n"], "line", F.col("torn")).collect()


def test_manifest_is_all_or_nothing(spark, tmp_path):
    good = {"923609016": [{"url": "https://court.example.org/a", "kind": "news", "access_reviewed": True}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(good))
    assert landing.read_source_manifest(spark, str(path)).count() == 1
    good["923609016"].append({"url": "court.example.org/a", "kind": "filing", "access_reviewed": True})
    path.write_text(json.dumps(good))
    with pytest.raises(ValueError, match="duplicate_legal_source_url"):
        landing.read_source_manifest(spark, str(path))
