"""Records and torn ends told from the places of lines, with splits of a few bytes."""

import csv
import random

import pytest

from vouchlake.sources import inputs
from vouchlake.sources import bulk, landing
from vouchlake.sources.lines import quoted_records, read_lines


@pytest.fixture
def tiny_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def sheet(path, seed, n=120):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["x", "", "a,b", 'say "hi"', "two\nlines", "\n\n", "é;ø", '"', "long " * 20 + "\n" * 3])
    rows = [[str(i), cell(), cell()] for i in range(n)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(["organisasjonsnummer", "navn", "note"])
        out.writerows(rows)
    return rows


def test_breaks_inside_quotes(spark, tmp_path, tiny_splits):
    want = sheet(tmp_path / "a.csv", 1) + sheet(tmp_path / "b.csv", 2)
    lines = read_lines(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 20
    assert quoted_records(lines).count() == 2 + len(want)
    rows = bulk.read_bulk_csv(spark, str(tmp_path), multi_line=True).drop("_corrupt").collect()
    plain = lambda r: tuple(x or "" for x in r)
    assert sorted(map(plain, rows)) == sorted(map(plain, want))


def test_headers_and_wide_rows_are_judged(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text('organisasjonsnummer,navn\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("organisasjonsnummer,name\n2,z\n")
    with pytest.raises(Exception, match="invalid_bulk_header"):
        bulk.read_bulk_csv(spark, str(tmp_path), multi_line=True).collect()
    (tmp_path / "b.csv").write_text("organisasjonsnummer,navn\n2,z,more\n")
    with pytest.raises(Exception, match="invalid_bulk_columns"):
        bulk.read_bulk_csv(spark, str(tmp_path), multi_line=True).collect()


@pytest.mark.parametrize(("end", "kept"), [("\n", 41), ("", 40), ('\n{"n": 4', 41), ("\n\n", 41)])
def test_torn_last_line(spark, tmp_path, tiny_splits, end, kept):
    """Only the unfinished last write is dropped, also where it happens to be a whole object."""
    text = "\n".join(f'{{"n": {i}, "é": "å"}}' for i in range(41)) + end
    (tmp_path / "journal.jsonl").write_text(text, encoding="utf-8")
    assert landing.read_journal(spark, str(tmp_path)).count() == kept


def test_damage_elsewhere_is_fatal(spark, tmp_path):
    (tmp_path / "journal.jsonl").write_text('{"n": 1}\n{"n": \n{"n": 3}\n')
    with pytest.raises(Exception, match="resume_checkpoint_invalid"):
        landing.read_journal(spark, str(tmp_path)).collect()


def test_a_number_before_words_is_a_text(spark):
    texts = ["4801146876264569 Thing one. To", '"a"] rest', '"a"} rest', '{"organisation_number":"1"} {', "1, 2", '1,"a":2', " 7 ", '{"organisation_number":"8"}', "[1] [2]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, line string")
    got = dict(rows.select("id", inputs.input_number("line")).collect())
    assert [got[i] for i in range(len(texts))] == [*texts[:6], "7", "8", "[1] [2]"]
