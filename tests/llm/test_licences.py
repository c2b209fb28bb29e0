"""Licence scan against plain search over words and against Python's own evaluation of expressions."""

import random

import pytest

from vouchlake.llm import licences
from vouchlake.llm.decontaminate import words_of
from vouchlake.llm.queries import PHRASES

DOCS = "doc_id long, text string, labels string, places int"


def brute_places(text, phrases):
    words = words_of((text or "").encode())
    out = []
    for phrase, label in phrases.items():
        p = words_of(phrase.encode())
        out += [(i, label) for i in range(len(words)) if p and words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_places(spark):
    rng = random.Random(5)
    phrases = {**PHRASES, "by general": "a", "rights reserved cc": "b", "É by": "c", "  ": "none"}
    parts = ["CC", "by", "cc-by", "General", "public", "LICENSE,", "all", "rights", "reserved", "É", "x", "\n", "--", "CC BY"]
    docs = [(i, rng.choice([" ", "_", ". "]).join(rng.choice(parts) for _ in range(rng.randint(0, 60))), "l", 1) for i in range(80)]
    docs += [(90, None, None, None), (91, "", "", 0), (None, "cc by", "x", 2), (7, "cc by", "x", 2), (92, "all rights reserved " * 60_000, "", 0)]
    rows = licences.scan(spark.createDataFrame(docs, DOCS), phrases).collect()
    got = sorted((str(r.doc_id), r.n_words, sorted((p.start, p.label) for p in r.places)) for r in rows)
    assert got == sorted((str(d), *brute_places(t, phrases)) for d, t, *_ in docs)
    assert all(0 <= r.score <= 1 for r in rows)
    assert licences.scan(spark.createDataFrame([], DOCS), phrases).count() == 0
    assert {r.n_words for r in licences.scan(spark.createDataFrame(docs, DOCS), {}).collect()} == {r.n_words for r in rows}


def expression(rng, depth=0):
    """(text, freedom by Python's min and max) of a random expression with all precedences."""
    def unit():
        if depth < 3 and rng.random() < 0.3:
            text, value = expression(rng, depth + 1)
            return f"({text})", value
        name = rng.choice(["MIT", "GPL-3.0-only", "Apache-2.0", "MPL-2.0", "Other", "CC-BY-NC-4.0"])
        text, value = name, licences.freedom(name.lower())
        if rng.random() < 0.2:
            text, value = f"{text} WITH Classpath-exception-2.0", min(1.0, value + licences.EXCEPTION)
        return text, value

    clauses = []
    for _ in range(rng.randint(1, 3)):
        units = [unit() for _ in range(rng.randint(1, 3))]
        clauses.append((" AND ".join(t for t, _ in units), min(v for _, v in units)))
    return " OR ".join(t for t, _ in clauses), max(v for _, v in clauses)


def test_expressions(spark):
    rng = random.Random(9)
    made = [expression(rng) for _ in range(300)]
    docs = [(i, f"// x\n// SPDX-License-Identifier: {text}\nbody or more\n", "", 0) for i, (text, _) in enumerate(made)]
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, DOCS), PHRASES).collect()}
    for i, (text, value) in enumerate(made):
        assert rows[i].score == pytest.approx(value), text


@pytest.mark.parametrize(("tokens", "want"), [
    ("mit or ( apache and", "mit apache or"), ("( ( mit or", "mit"), ("mit ) or x", "mit"), ("or mit", ""), ("mit this file", "mit"), ("(", ""),
    ("a or b and c with e", "a b c e with and or"), ("( a or b ) and c", "a b or c and"), ("a with ( ", "a"), ("a and b or", "a b and"),
])
def test_longest_beginning(tokens, want):
    assert licences.reverse_polish(tokens.split()) == want.split()


@pytest.mark.parametrize(("text", "labels", "score"), [
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"], 0.2),
    ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"], 0.9),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"], 0.4),
    ("Under either the MIT License or the Apache License, Version 2.0", ["apache-2.0", "mit"], 0.9),
    ("The GNU General Public License version 2 with the Classpath exception", ["classpath-exception", "gpl-2"], 0.5),
    ("MIT License. All rights reserved.", ["mit", "reserved"], 0.0),
    ("License-Expression: GPL-2.0-or-later OR mit", ["gpl-2.0-or-later", "mit"], 0.9),
    ("no notice", [], 0.5),
])
def test_notices(spark, text, labels, score):
    row = licences.scan(spark.createDataFrame([(1, text, "", 0)], DOCS), PHRASES).first()
    assert sorted({x for e in row.expressions for x in e.labels}) == labels
    assert row.score == pytest.approx(score)
