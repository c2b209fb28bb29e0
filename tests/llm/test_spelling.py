"""Spelling variants against the distance of every pair of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from vouchlake.llm import spelling

DOCS = "doc_id long, text string, word string, n int"


def one_apart(a, b):
    """Edit distance 1, by trying every edit of ``a``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    cuts = {a[:i] + a[i + 1 :] for i in range(len(a))}
    if b in cuts or a in {b[:i] + b[i + 1 :] for i in range(len(b))}:
        return True
    return len(a) == len(b) and any(a[:i] == b[:i] and a[i + 1 :] == b[i + 1 :] for i in range(len(a)))


def brute(docs, modulus, times):
    n = Counter()
    for d, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    letters = "aeinort" + "ÉéßÀÿbz"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(25)]
    stems += ["é" * 300 + "abc", "ab" * 40]
    words = []
    for s in stems:
        for c in [rng.choice([1, 30, 300])] + [rng.choice([1, 2, 3, 20]) for _ in range(6)]:
            words += [s] * c
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :]])
    rng.shuffle(words)
    docs, at = [], 0
    while at < len(words):
        size = rng.randint(1, 80)
        docs.append((len(docs), rng.choice([" ", "-", "9", "×", "é", "…"]).join(words[at : at + size]).title()))
        at += size
    docs += [docs[0], docs[1], (None, docs[2][1]), (None, docs[2][1]), (900, None), (901, ""), (902, "7 … ĀĀ"), (903, "x" * 100_000 + " " + "x" * 100_001), (904, "x" * 100_000 + " " + "x" * 100_001)]
    return [(d, t, "w", 1) for d, t in docs]


@pytest.mark.parametrize(("subtree", "leaf", "packed"), [(25_000, 20_000, 64), (9, 12, 64), (3, 1, 8), (1, 4, 64)])
def test_against_pairs(spark, monkeypatch, subtree, leaf, packed):
    monkeypatch.setattr(spelling, "SUBTREE", subtree)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PACKED", packed)
    monkeypatch.setattr(spelling, "HELD", 40)
    docs = case(2)
    got = spelling.variants(spark.createDataFrame(docs, DOCS), spelling.drop_one_in(5), 3).collect()
    assert sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got), key=str) == brute(docs, 5, 3)


def test_one_edit():
    rng = random.Random(4)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))
        assert spelling.one_edit(a.encode(), b.encode()) == one_apart(a, b), (a, b)


def test_long_chain_and_empty(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}" if i < 13 else None) for i in range(14)], "word string, form string")
    assert {r.root for r in spelling.with_roots(forms).collect()} == {"w13"}
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "", 0)], DOCS)).count() == 0
