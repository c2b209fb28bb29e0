"""Ranked search against scores of every document computed plainly."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from vouchlake.llm import lexical
from vouchlake.llm.decontaminate import words_of

DOCS = "doc_id long, text string, id long, item_id string, width int"
ITEMS = "item_id long, text string, doc_id int"


def brute(docs, items, k):
    counted = [(d, Counter(words_of((t or "").encode()))) for d, t, *_ in docs]
    counted = [(d, c) for d, c in counted if c]
    rows, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            n, s = sum(c.values()), 0
            for w in words_of((text or "").encode()):
                if c[w]:
                    weight = math.floor(1000 * math.log((2 * rows + 2) / (2 * df[w] + 1)))
                    s += weight * ((10**9 * c[w]) // (1000 * c[w] + 12 * (100 - 25 + (25 * n * rows) // total)))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(str(item), r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)] + ["É1", "ß"]
    pick = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    docs = [(i, " ".join(pick() for _ in range(rng.choice([1, 5, 40, 300]))).upper()) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[8][1]), (None, docs[8][1])]
    docs += [(2000, None), (2001, ""), (2002, " ?! "), (2003, "r1 " * 50_000), (2004, " ".join(f"x{i}" for i in range(60_000)) + " r2")]
    items = [(i, ", ".join(pick() for _ in range(rng.choice([1, 3, 20])))) for i in range(12)]
    items += [(20, docs[7][1]), (21, docs[8][1]), (22, None), (23, "..."), (24, "absent words"), (None, "r1 r2"), (3, "c1 c1 c2"), (25, "x59999 x4")]
    return [(d, t, 1, "x", 2) for d, t in docs], items


@pytest.mark.parametrize("small", [False, True])
def test_against_all_scores(spark, monkeypatch, small):
    if small:  # several groups, parts and blocks, saturated signatures
        for name, value in (("ITEMS", 5), ("GROUP_WORDS", 60), ("BLOCK_DOCS", 16), ("WIDEST", 512), ("SEEDS", 7), ("STEP", 8), ("CACHE", 50)):
            monkeypatch.setattr(lexical, name, value)
    docs, items = case(11)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    got = lexical.search(frame, spark.createDataFrame([(*i, 0) for i in items], ITEMS), 7).collect()
    assert sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in got), key=str) == brute(docs, items, 7)


def test_bounds_hold_and_exclude():
    docs, items = case(12)
    docs = [(d, words_of(t.encode())) for d, t, *_ in docs if d is not None and t]
    docs = [(d, w) for d, w in docs if w]
    weights = {w: 1000 for _, t in items for w in words_of((t or "").encode())}
    asked = lexical.Items([(i, words_of((t or "").encode())) for i, t in items], weights, len(docs), sum(len(w) for _, w in docs))
    class Held:
        value = {w: i for i, w in enumerate(weights)}

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([b" ".join(w).decode() for _, w in docs])], ["doc_id", "text"])
    exact = {}
    for d, w in docs:
        exact.setdefault(d, []).append(asked.score(w))
    close = []
    for row in lexical._index_task(Held, True)([batch]):
        row = row.to_pylist()[0]
        bounds = asked.bounds(asked.hashes(), row["width"], np.frombuffer(row["sizes"], np.int64), row["slices"])
        for d, b in zip(np.frombuffer(row["ids"], np.int64).tolist(), bounds.T, strict=True):
            assert any((b >= e).all() for e in exact[d])
            close.append((b <= 1.5 * exact[d][0] + 1e6).mean())
    assert np.mean(close) > 0.9


def test_empty(spark):
    docs, items = case(13)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 0) for i in items], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
