"""Occurrences of benchmark windows against plain substring search."""

import itertools
import random
import re

from pyspark.sql import functions as F

from vouchlake.llm import decontaminate

DOCS = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, doc_id int"


def brute(text, items, window=13):
    words = decontaminate.words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        terms = decontaminate.words_of((body or "").encode())
        n = min(window, len(terms))
        for i in range(len(terms) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == terms[i : i + n]:
                    hit |= set(range(j, j + n))
                    found |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(found)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(12)] + ["Éa", "ß9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30, 40])))) for i in range(25)]
    items += [(25, None), (26, "  ?! "), (None, "alone here"), (3, "t1 t2 t3")]
    docs = []
    for _ in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                body = (rng.choice(items)[1] or "").split()
                cut = rng.randint(0, max(0, len(body) - 1))
                text += body[cut : cut + rng.randint(1, 40)]
            text += [rng.choice([*vocabulary, "zz", "yy"]) for _ in range(rng.randint(0, 20))]
        docs.append((len(docs), rng.choice([" ", ", ", "\n"]).join(text).upper(), None))
    return docs + [(100, None, "x"), (101, "", "y"), (None, "alone-here", "z"), (7, "T1 t2", "q"), (7, "T1 t2", "q")], items


def test_against_search(spark, monkeypatch):
    docs, items = case(3)
    frame = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    want = sorted((str(d), *map(str, brute(t, items))) for d, t, _ in docs)
    for block in (decontaminate.BLOCK_WORDS, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        rows = decontaminate.judged(decontaminate.occurrences(frame, bench)).collect()
        assert sorted((str(r.doc_id), str(r.n_words), str(r.n_hit), str(sorted(r["items"]))) for r in rows) == want
        for r in rows:
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
            assert all(a.end < b.start for a, b in zip(r.hits, r.hits[1:]))


def test_empty_tables(spark):
    docs, items = case(4)
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    assert decontaminate.occurrences(frame.limit(0), bench).count() == 0
    rows = decontaminate.judged(decontaminate.occurrences(frame, bench.limit(0))).collect()
    assert len(rows) == len(docs) and not any(r.contaminated or r.n_hit for r in rows)


def cut_by_hand(text, items, length, coverage):
    """Words found one by one in the text; those of spans over a limit are blanked."""
    if text is None:
        return None
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))
    words = decontaminate.words_of(text.encode())
    assert len(found) == len(words)
    hit = [False] * len(words)
    for _, body in items:
        terms = decontaminate.words_of((body or "").encode())
        n = min(13, len(terms))
        for i in range(len(terms) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == terms[i : i + n]:
                    hit[j : j + n] = [True] * n
    spans = [[i for i, _ in run] for on, run in itertools.groupby(enumerate(hit), lambda x: x[1]) if on]
    if sum(hit) < coverage * len(words):
        spans = [s for s in spans if len(s) >= length]
    for s in reversed(spans):
        text = text[: found[s[0]].start()] + text[found[s[-1]].end() :]
    return text


def test_removed_spans(spark, monkeypatch):
    docs, items = case(5)
    docs.append((200, ("zz, " * 20000) + items[10][1] + " ÆØ! " * 20000, "long"))
    frame = spark.createDataFrame([(*d, len(d[1] or ""), d[1]) for d in docs], DOCS + ", n_chars int, `_text` string")
    frame = frame.withColumn("a.b", F.lit("kept"))
    bench = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    for length, coverage, block in ((13, 0.05, 200_000), (5, 0.9, 40), (14, 2.0, 200_000)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = decontaminate.remove_spans(frame, bench, length=length, coverage=coverage)
        assert got.columns == frame.columns
        want = sorted((str(d), cut_by_hand(t, items, length, coverage) or "", t or "") for d, t, _ in docs)
        rows = got.collect()
        assert sorted((str(r.doc_id), r.text or "", r["_text"] or "") for r in rows) == want
        assert all(r.n_chars == len(r.text or "") and r["a.b"] == "kept" for r in rows)
        assert any(r.text != r["_text"] for r in rows) and {r.doc_id for r in rows if r.text is None} == {100}
