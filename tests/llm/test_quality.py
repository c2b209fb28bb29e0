"""Held-out accuracy, gradients and scoring of whole texts."""

import random

import numpy as np

from vouchlake.llm import quality

DOCS, LABELS = "doc_id long, text string, score double", "doc_id long, quality int, text string"


def rows(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        good = rng.random() < 0.6
        words = ["".join(rng.choice("abcdefghij é") for _ in range(6)) for _ in range(rng.randint(1, 150))]
        yield i, " ".join(w if good else w + "%%%" for w in words), int(good)


def test_accuracy(spark):
    data = list(rows(500, 1))
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in data] + [(600, None, 0.0), (601, "", 0.0), (None, "x", 0.0), (602, "é" * 90000 + " abc%%%", 0.0)], DOCS)
    labels = spark.createDataFrame([(i, y, None) for i, _, y in data[:350]] + [(None, 1, None), (9999, 1, None), (7, None, None)], LABELS)
    network = quality.fit(docs, labels)
    out = {r.doc_id: r.score for r in quality.score(docs, network).collect()}
    assert len(out) == 504 and all(0 <= s <= 1 for s in out.values())
    assert sum((out[i] >= 0.5) == bool(y) for i, _, y in data[350:]) >= 140
    assert out[600] == out[601]
    assert quality.score(docs.limit(0), network).count() == 0


def test_gradient():
    network = quality.Network(2)
    rng = np.random.default_rng(1)
    docs = [(k % 2, [rng.integers(0, 256, s).astype(np.uint8) for s in sizes]) for k, sizes in enumerate([(512, 300), (40,), (6, 512)])]
    for key in network.p:
        network.p[key] = network.p[key].astype(np.float64)

    def loss():
        network.pairs = None
        out = 0.0
        for y, chunks in docs:
            network.pairs = network.tables()
            parts = np.concatenate([network.pooled(c)[:1] if len(c) < quality.CHUNK else network.pooled(c) for c in chunks])
            z = np.r_[parts.mean(axis=0), parts.max(axis=0), parts.min(axis=0)] @ network.p["out"] + network.p["bias"][0]
            out += np.log1p(np.exp(z)) - y * z
        return out / len(docs)

    grad = network._gradient(docs)
    for key, at in (("out", (3,)), ("out", (70,)), ("bias", (0,)), ("shift", (2,)), ("filters", (1, 3, 4)), ("filters", (5, 0, 9))):
        old, eps = network.p[key][at], 1e-5
        network.p[key][at] = old + eps
        up = loss()
        network.p[key][at] = old - eps
        down = loss()
        network.p[key][at] = old
        assert abs((up - down) / (2 * eps) - grad[key][at]) < 1e-3 * max(1, abs(grad[key][at])), (key, at)


def test_segments_agree(monkeypatch):
    network = quality.Network(4)
    text = bytes(np.random.default_rng(2).integers(0, 256, 50_000, dtype=np.uint8))
    want = network.score(text)
    monkeypatch.setattr(quality, "SEGMENT", 3000)
    assert abs(network.score(text) - want) < 1e-6


def test_nothing_to_learn(spark):
    docs, labels = spark.createDataFrame([(1, "some text", 0.0)], DOCS), spark.createDataFrame([], LABELS)
    assert quality.score(docs, quality.fit(docs, labels)).first().score == 0.5
