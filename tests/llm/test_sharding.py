"""Shard law, mixture and edge rows."""

import zlib
from collections import Counter

from vouchlake.llm import sharding

SCHEMA = "doc_id long, text string, source string, shard string"


def test_law_and_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 50)
    rows = [(i, f"text {i % 37}", "hot" if i % 3 == 0 else f"s{i % 5}", "x") for i in range(1000)]
    rows += [(None, None, None, None), (5, "", "lone", "y"), (5, "", "lone", "y"), (7, "é", None, "z")]
    out = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert len(out) == len(rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(7))
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    hot = Counter(r.shard for r in out if r.source_key == "shot")
    total = sum(hot.values())
    assert all(abs(hot[s] - total * sizes[s] / len(rows)) <= 2 for s in sizes)
    text = {(i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _, _ in rows}
    assert {(r.doc_id, r.text_crc32, r.size) for r in out} == text


def test_small_tables(spark):
    docs = spark.createDataFrame([(i, "a", "s", "x") for i in range(3)], SCHEMA)
    out = sharding.interleave(docs, 40).collect()
    assert sorted(r.slot for r in out) == [0, 0, 0] and len({r.shard for r in out}) == 3
    assert sharding.interleave(docs.limit(0), 40).count() == 0


def test_many_sources_spread(spark):
    docs = spark.createDataFrame([(i, "a", f"s{i}", "x") for i in range(400)], SCHEMA)
    out = sharding.interleave(docs, 4).collect()
    assert Counter(r.shard for r in out) == {0: 100, 1: 100, 2: 100, 3: 100}
