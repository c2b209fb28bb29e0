"""Recall and scores against brute force."""

import numpy as np
from pyspark.sql import functions as F

from vouchlake.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, asked, k):
    fine = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in {i: q for i, q in fine if asked(i)}.items():
        scored = sorted((-sum(np.float64(a) * b for a, b in zip(q, x)), j) for j, x in fine if j != i and len(x) == len(q))
        out |= {(i, n + 1, j) for n, (_, j) in enumerate(scored[:k])}
    return out


def found(rows):
    return {(r.query_id, r["rank"], r.vec_id) for r in rows}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 48))
    rows = [(i, (centres[i % 5] + 0.5 * rng.standard_normal(48)).astype(np.float32).tolist(), 0, "x") for i in range(700)]
    rows += [(1000 + i, rows[0][1], 1, "y") for i in range(120)]  # one common vector
    out = neighbours.search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, 10).collect()
    want = brute(rows, lambda i: i % 20 == 0, 10)
    assert len(out) == len(want) and len(found(out) & want) >= 0.9 * len(want)
    by_id = {i: np.array(v, np.float64) for i, v, *_ in rows}
    for r in out:
        assert abs(r.score - by_id[r.query_id] @ by_id[r.vec_id]) < 1e-9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0, "a"), (20, [3.0, -1.0], 0, "b"), (3, None, 0, "c"), (40, [], 0, "d"), (5, [0.0, 0.0], 0, "e"), (6, [nan, 1.0], 0, "f"), (7, [inf, 1.0], 0, "g"), (8, [None, 1.0], 0, "h"), (None, [1.0, 1.0], 0, "i"), (9, [1.0], 0, "j"), (60, [5.0], 0, "k"), (10, [1.0, 2.0], 0, "l")]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = neighbours.search(frame, F.col("vec_id") % 20 == 0, 20).collect()
    assert found(out) == brute(rows, lambda i: i % 20 == 0, 20)
    assert neighbours.search(frame.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
