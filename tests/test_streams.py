"""Streams against the batch result of the same rows, whatever the lots."""

import datetime
import glob
import random

from pyspark.sql import functions as F

from vouchlake.operators.windows import change_history
from vouchlake.streaming import feeds, history

SCHEMA = "id long, k string, ts timestamp_ntz, v long, extra string"
START = datetime.datetime(2024, 1, 1)


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def observation(i, key, minutes, value):
    return (i, key, None if minutes is None else START + datetime.timedelta(minutes=minutes), value, "x")


def plain(df):
    return sorted((r.id, r.v, r.before, r.kind) for r in df.collect())


def run(spark, base, files=1):
    feed = feeds.open_feed(spark, f"{base}/in", files_per_batch=files)
    history.stream_changes(feed, ["k"], ["ts", "id"], "v", f"{base}/out", "ts", "2 hours", "1 hour")
    return history.read_changes(spark, f"{base}/out")


def test_overlapping_lots_equal_batch(spark, tmp_path):
    """Lots overlap within the delay, one key has most rows, values are null, the stream stops and goes on."""
    rng = random.Random(3)
    rows = [observation(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 2000), rng.choice([1, 2, None])) for i in range(400)]
    lots = [[] for _ in range(5)]
    for r in rows:
        landed = (r[2] - START).total_seconds() / 60 + rng.randint(0, 100)
        lots[min(4, int(landed // 450))].append(r)
    base = str(tmp_path)
    for n, lot in enumerate(lots):
        rng.shuffle(lot)
        land(spark, f"{base}/in", lot)
        if n in (1, 2):
            run(spark, base)
    land(spark, f"{base}/in", [observation(-1, "end", 9000, 0)])
    got = run(spark, base).filter("k is null or k <> 'end'")
    assert plain(got) == plain(change_history(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts", "id"], "v"))


def test_late_rule(spark, tmp_path):
    """A row older than the watermark of its batch is left out, one inside the delay is put in its place."""
    base = str(tmp_path)
    lots = [
        [observation(1, "a", 600, 1)],
        [observation(2, "a", 500, 2)],  # 100 minutes before the greatest time, delay 120
        [observation(3, "a", 1000, 1), observation(9, "a", None, 5)],
        [observation(4, "a", 700, 7)],  # 300 minutes late
        [observation(5, "end", 9000, 0)],
    ]
    for lot in lots:
        land(spark, f"{base}/in", lot)
    got = run(spark, base).filter("k = 'a'")
    assert plain(got) == [(1, 1, 2, "changed"), (2, 2, None, "first"), (3, 1, 1, "same")]


def test_open_buckets_are_held_back(spark, tmp_path):
    land(spark, f"{tmp_path}/in", [observation(1, "a", 10, 1), observation(2, "a", 200, 1), observation(3, "a", 230, 2)])
    assert plain(run(spark, str(tmp_path))) == [(1, 1, None, "first")]


def test_latest_over_many_batches(spark, tmp_path):
    """Stored files stay as many over 50 batches; a replayed batch changes nothing; a late row never wins."""
    base, rng, rows = str(tmp_path), random.Random(8), []
    schema = "k string, at long, state string"
    for n in range(50):
        lot = [(rng.choice("abcdefgh"), rng.randint(0, 10_000), rng.choice(["available", "failed"])) for _ in range(3)]
        rows += lot
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def files():
        return sorted(glob.glob(f"{base}/out/latest/**/*.parquet", recursive=True))

    feed = lambda: feeds.open_feed(spark, f"{base}/in", files_per_batch=1)
    feeds.stream_latest(feed(), "k", ["at"], f"{base}/out", parts=4)
    want = {}
    for k, at, state in rows:
        if state == "available":
            want[k] = max(at, want.get(k, -1))
    now = lambda: {r.k: r["at"] for r in feeds.read_latest(spark, f"{base}/out").collect()}
    assert now() == want and feeds.read_latest(spark, f"{base}/out").count() == len(want)
    assert len(files()) <= 2 * 4
    # The last batch's commit is lost: it runs again.
    last = sorted(glob.glob(f"{base}/out/checkpoint/commits/[0-9]*"), key=lambda p: int(p.rsplit("/", 1)[1]))[-1]
    for p in (last, f"{last.rsplit('/', 1)[0]}/.{last.rsplit('/', 1)[1]}.crc"):
        if glob.os.path.exists(p):
            glob.os.remove(p)
    feeds.stream_latest(feed(), "k", ["at"], f"{base}/out", parts=4)
    assert now() == want and len(files()) <= 2 * 4
