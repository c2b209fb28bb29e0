"""Files read in pieces: hashes, first bytes, lines of packed files, and bulk files as delivered."""

import gzip
import hashlib
import json
import random

import pytest

from vouchlake.operators import joins
from vouchlake.sources import bulk
from vouchlake.sources.files import all_lines, file_facts


def test_facts_of_files(spark, tmp_path):
    rng = random.Random(1)
    many = gzip.compress(b'  {"a":1}\n' + b"x" * 5000) + gzip.compress(b"second member\n") + b"\0" * 9
    bodies = {
        "empty": b"", "a.csv": b"\xef\xbb\xbforganisasjonsnummer;navn\n1;A\n", "b": many, "c d.jsonl": b'{"k":1}\r\n', "blank.csv": b"\n{}\n",
        "big.bin": rng.randbytes(40_000), "one": b"x", "fake.gz": gzip.compress(b"a,b\n"),
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    bodies.pop("empty")
    # Pieces of 7 bytes: no file is a value, so the limit stands for files of any size.
    rows = {r.file.rsplit("/", 1)[1].replace("%20", " "): r for r in file_facts(spark, str(tmp_path), chunk=7).collect()}
    assert {k: r.sha256 for k, r in rows.items()} == {k: hashlib.sha256(b).hexdigest() for k, b in bodies.items()}
    assert {k: r.size for k, r in rows.items()} == {k: len(b) for k, b in bodies.items()}
    assert {k for k, r in rows.items() if r.gzip} == {"b", "fake.gz"}
    kinds = {k: r.kind for k, r in rows.items() if k != "big.bin"}
    assert kinds == {"a.csv": "csv", "b": "jsonl", "c d.jsonl": "jsonl", "blank.csv": "csv", "one": "csv", "fake.gz": "csv"}
    assert rows["a.csv"].head == "organisasjonsnummer;navn"


def test_lines_of_packed_files(spark, tmp_path):
    rng = random.Random(2)
    text = {n: ["".join(rng.choice("aé 世\r") for _ in range(rng.choice([0, 3, 900]))) for _ in range(300)] for n in ("plain", "odd", "named.gz")}
    (tmp_path / "plain").write_bytes("\n".join(text["plain"]).encode() + b"\n")
    (tmp_path / "odd").write_bytes(gzip.compress("\n".join(text["odd"][:150]).encode() + b"\n") + gzip.compress("\n".join(text["odd"][150:]).encode() + b"\n"))
    (tmp_path / "named.gz").write_bytes(gzip.compress("\n".join(text["named.gz"]).encode() + b"\n"))
    got = {}
    for r in all_lines(spark, str(tmp_path), chunk=11).orderBy("file", "block", "seq").collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(r.line)
    assert got == text


@pytest.mark.parametrize("packed", [False, True])
def test_bulk_as_delivered(spark, tmp_path, packed):
    wrap = gzip.compress if packed else bytes
    wanted = spark.createDataFrame([("1",), ("3",), ("9",)], "k string")
    sheet = wrap("﻿organisasjonsnummer;navn;naeringskode1.kode\r\n1;\"A\nB\";62\r\n2;C;\r\n".encode())
    other = wrap(b"organisasjonsnummer;navn;naeringskode1.kode\n3;D;\n")
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "one").write_bytes(sheet)
    (tmp_path / "csv" / "two").write_bytes(other)
    (tmp_path / "csv" / "none").write_bytes(b"")
    rows = {r.organisasjonsnummer: r for r in bulk.read_bulk(spark, str(tmp_path / "csv"), wanted).collect()}
    assert {k: json.loads(r.record_json) for k, r in rows.items()} == {
        "1": {"organisasjonsnummer": "1", "navn": "A\nB", "naeringskode1": {"kode": "62"}}, "3": {"organisasjonsnummer": "3", "navn": "D"}}
    assert {k: r.file_sha256 for k, r in rows.items()} == {"1": hashlib.sha256(sheet).hexdigest(), "3": hashlib.sha256(other).hexdigest()}
    assert json.loads(rows["3"].body) == {"_format": bulk.FORMAT, "encoding": "csv", "file_sha256": rows["3"].file_sha256, "record": json.loads(rows["3"].record_json)}

    lines = wrap(b'{"organisasjonsnummer":"1","a":{"b":[1,2]}}\n\n{"organisasjonsnummer":"2"}\n')
    (tmp_path / "rows").write_bytes(lines)
    (row,) = bulk.read_bulk(spark, str(tmp_path / "rows"), wanted).collect()
    assert (row.organisasjonsnummer, row.encoding, row.file_sha256) == ("1", "jsonl", hashlib.sha256(lines).hexdigest())
    (tmp_path / "csv" / "three").write_bytes(lines)
    with pytest.raises(ValueError, match="mixed_bulk_files"):
        bulk.read_bulk(spark, str(tmp_path / "csv"), wanted)
    (tmp_path / "twice").write_bytes(wrap(b'{"organisasjonsnummer":"1"}\n' * 2))
    with pytest.raises(Exception, match="duplicate_bulk_company"):
        bulk.read_bulk(spark, str(tmp_path / "twice"), wanted).collect()
    (tmp_path / "bare").write_bytes(b"")
    with pytest.raises(ValueError, match="invalid_bulk_header"):
        bulk.read_bulk(spark, str(tmp_path / "bare"), wanted)


def test_periods_of_a_hot_key(spark):
    """A third of the rows repeat one period: pairs grow with periods, and every pair is that of a plain search."""
    import datetime as dt

    rng = random.Random(3)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", day(s := rng.randint(0, 500)), day(s + rng.choice([180, 187, 188, 364, 366, 371])), i) for i in range(1500)]
    rows += [("hot", day(0), day(364), 9000 + i) for i in range(800)] + [("hot", day(366), day(730), 9900 + i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, s date, e date, v int")
    periods = {r[:3] for r in rows}

    def year_on(d):
        last = (dt.date(d.year + 1 + d.month // 12, d.month % 12 + 1, 1) - dt.timedelta(1)).day
        return dt.date(d.year + 1, d.month, min(d.day, last))

    want = set()
    for k, s, e in periods:
        fit = [(e2, s2) for k2, s2, e2 in periods if k2 == k and e.year - e2.year == 1 and abs((e - s).days - (e2 - s2).days) <= 7 and abs((e - year_on(e2)).days) <= 7]
        if fit:
            want.add((k, s, e, *reversed(max(fit))))
    got = joins.comparable_periods(df, ["k"], "s", "e").select("k", "s", "e", "prior_s", "prior_e").collect()
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want
