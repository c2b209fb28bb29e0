"""SimHash groups against brute force, also with buckets that must be divided."""

import random

import numpy as np
import xxhash

from vouchlake.llm import simhash

SCHEMA = "doc_id long, text string, text_2 string"


def mark(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks, distance=3):
    """Smallest index reachable from each of the given fingerprints."""
    marks = np.array(marks, np.uint64)
    label = np.arange(len(marks))
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= distance
    while True:
        least = np.array([label[row].min() for row in near])
        if (least == label).all():
            return label.tolist()
        label = least


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near).upper() if rng.random() < 0.3 else "\t".join(near))
    texts += ["", None, " \n", "one", "one two", "É accent É", "É accent É"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    marks = [mark(t) for t in texts]
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == marks
    assert [got[i].component_id for i in range(len(texts))] == groups(marks)


def test_divided_buckets(spark, monkeypatch):
    rng = random.Random(9)
    marks = set()
    for _ in range(4):  # clouds of near fingerprints: few bits of a centre flip
        centre = rng.getrandbits(64)
        for _ in range(300):
            marks.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    marks |= {rng.getrandbits(64) for _ in range(300)}
    marks = sorted(marks)
    fps = spark.createDataFrame([(simhash._signed(m),) for m in marks], "fp long")
    want = groups(marks)
    for most in (simhash.MOST, 40):
        found = simhash.components(simhash.links(fps, 3, most)).collect()
        label = {r.node: r.component for r in found}
        first, got = {}, []
        for i, m in enumerate(marks):
            got.append(first.setdefault(label.get(simhash._signed(m), simhash._signed(m)), i))
        assert got == want, most


def test_allocation():
    cost = [[0, 5, 6, 50, 80], [0, 100, 200, 300, 400], [0, 5, 50, 60, 70], [0, 5, 50, 60, 70]]
    assert simhash.allocate(cost, 3) == (16.0, [1, -1, 0, 0])


def test_rows_kept(spark):
    rows = [(None, "a b c d e f g h", "p"), (7, "a b c d e f g h", "q"), (7, "a b c d e f g h", "q"), (3, "z y x w v u t s", "r"), (None, None, None), (9, "", "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(tuple(r) for r in simhash.keep_one(docs).collect())
    assert kept == [(3, "z y x w v u t s", "r"), (7, "a b c d e f g h", "q"), (9, "", "s")]
    assert simhash.near_groups(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).columns == docs.columns


def test_kept_rows_keep_their_columns(spark):
    """Names with dots and names that the stage makes itself stay the caller's."""
    rows = [(1, "one two three four", "a", 5, "x"), (2, "one two three four", "b", 6, "y"), (None, None, "c", 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, _row_tag int, kept_id string")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([rows[0], rows[2]], key=str)
