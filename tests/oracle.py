"""Compare each query with its SQL on DuckDB: row count, columns, values.

Usage: python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return f"{type(value).__name__}:{value}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got), "rows only"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        have, need = set(got), set(want)
        extra = [r for r in got if r not in need][:2]
        lost = [r for r in want if r not in have][:2]
        return False, len(got), f"rows {len(got)} vs {len(want)}\n   cols {sorted(cols)}\n   spark {extra}\n   sql   {lost}"[:1800]
    return True, len(got), ""


def main(argv):
    import __spark_entry__ as entry
    from vouchlake.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    bad = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, n, note = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, n, note = False, -1, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += ok is False
        print(f"{'ok  ' if ok else 'ROWS' if ok is None else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
