"""Removed words against brute force over whole windows."""

import random

from vouchlake.llm import substring

SCHEMA = "doc_id long, text string, kept_text string"


def brute(rows, window):
    owner = {}
    texts = [((t or "").encode().split(), i) for i, t, _ in rows]
    for words, i in texts:
        for a in range(len(words) - window + 1):
            if i is not None:
                k = tuple(words[a : a + window])
                owner[k] = min(owner.get(k, i), i)
    out = []
    for words, i in texts:
        gone = set()
        for a in range(len(words) - window + 1):
            if i is not None and owner[tuple(words[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((str(i), len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out)


def test_random_texts(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH_WINDOWS", 300)
    monkeypatch.setattr(substring, "FLUSH_BYTES", 900)
    monkeypatch.setattr(substring, "SEGMENT", 40)
    rng = random.Random(11)
    passages = [[f"p{k}w{i}" for i in range(rng.randint(3, 30))] for k in range(8)]
    rows = []
    for i in rng.sample(range(1000), 120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(["a", "b", "É", "x" * 90]) for _ in range(rng.randint(1, 9))]
        rows.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words), "x"))
    rows += [(None, " ".join(passages[0]), "y"), (2000, None, None), (2001, " \r\n", "z"), (5000, rows[0][1], "q"), (5000, rows[0][1], "q"), (5000, rows[1][1], "q"), (-3, rows[2][1], "m")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for window in (5, 13):
        out = substring.remove_repeats(docs, window).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in out) == brute(rows, window)
        for r in out:
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_no_break_spaces_are_no_separators(spark):
    docs = spark.createDataFrame([(1, "a\u00a0b c\x1cd\u2028e\x85f", None)], SCHEMA)
    assert substring.remove_repeats(docs).first().n_words == 2
    assert substring.remove_repeats(docs.limit(0)).count() == 0
