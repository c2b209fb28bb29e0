"""Licence scan: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

A-Z lower-cased; a word is a maximal run of letters, digits and non-ASCII characters. One
Aho-Corasick machine holds the caller's base phrases, the notice phrases and the identifier
tags, each as its words between single spaces, and reads every text once from end to end.

* Every place of a base phrase is reported, overlapping ones too.
* Of notice phrases that overlap, the leftmost counts, and the longest of those; a version
  right behind it (``version 2.0``, ``v3``, ``4.0``) joins its identifier.
* Notices joined by ``or``, ``and`` or ``with`` (``the``, ``a``, ``either`` aside) are one expression, as
  is what stands behind an identifier tag up to the end of its line.

The parser turns an expression into reverse Polish order by the shunting-yard rule; ``with``
binds before ``and``, that before ``or``. A malformed expression counts as far as its longest
well-formed beginning reaches; brackets left open close at the end. Each licence has a freedom
of use in [0, 1]: ``or`` takes the greater (the user may choose), ``and`` the smaller,
``with`` adds ``EXCEPTION`` to its left side. All notices of a document hold together, so its
score is the smallest freedom of its expressions; ``UNKNOWN`` where it has none.

Defined cases: a null or empty text has no words, no places and the score ``UNKNOWN``; null and
repeated doc_ids give one row per input row; texts of any length are read whole, in memory of
some multiples of one text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouchlake.llm.common import bounded_batches
from vouchlake.llm.decontaminate import words_of

UNKNOWN = 0.5
EXCEPTION = 0.1

#: Notice phrases (as words) and the identifier they stand for.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "apache license": "apache",
    "licensed under apache": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "boost software license": "bsl",
    "gnu general public license": "gpl",
    "general public license": "gpl",
    "gnu gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "gnu lgpl": "lgpl",
    "gnu affero general public license": "agpl",
    "affero general public license": "agpl",
    "gnu agpl": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "classpath exception": "classpath-exception",
    "linking exception": "linking-exception",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "reserved",
}
#: Tags behind which an expression of identifiers stands.
TAGS = ("spdx license identifier", "license expression")
#: Freedom of use by the beginning of an identifier, the longest that fits.
FREEDOM = {
    "public-domain": 1.0, "unlicense": 1.0, "cc0": 1.0, "0bsd": 1.0,
    "mit": 0.9, "isc": 0.9, "bsd": 0.9, "zlib": 0.9, "bsl": 0.9, "apache": 0.9, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.6,
    "cc-by-sa": 0.4, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nc": 0.2, "cc-by-nd": 0.2, "reserved": 0.0, "proprietary": 0.0,
}
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
FILLERS = frozenset(("the", "a", "an", "either", "both"))

_TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+-]*")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_VERSION = re.compile(rb"v?[0-9]{1,2}")


@lru_cache(maxsize=4096)
def freedom(name: str) -> float:
    fits = [k for k in FREEDOM if name == k or name.startswith((k + "-", k + "+"))]
    return FREEDOM[max(fits, key=len)] if fits else UNKNOWN


def reverse_polish(tokens: list[str]) -> list[str]:
    """Shunting-yard over identifiers, ``and``, ``or``, ``with`` and brackets; the longest well-formed beginning."""
    out, held, operand_next = [], [], True
    for t in tokens:
        if operand_next:
            if t == "(":
                held.append(t)
            elif t in PRECEDENCE or t == ")":
                break
            else:
                out.append(t)
                operand_next = False
        elif t in PRECEDENCE:
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[t]:
                out.append(held.pop())
            held.append(t)
            operand_next = True
        elif t == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand_next:  # an operator, and any bracket behind it, without a right side
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    out += [t for t in reversed(held) if t != "("]
    return out


def evaluate(polish: list[str]) -> tuple[str, float]:
    """(the expression with all its brackets, its freedom) of a non-empty reverse Polish list."""
    stack: list[tuple[str, float]] = []
    for t in polish:
        if t not in PRECEDENCE:
            stack.append((t, freedom(t)))
            continue
        (right, r), (left, v) = stack.pop(), stack.pop()
        value = max(v, r) if t == "or" else min(v, r) if t == "and" else min(1.0, v + EXCEPTION)
        stack.append((f"({left} {t} {right})", value))
    return stack[-1]


class Machine:
    """One automaton of all phrases; every phrase stands between spaces, as the words it is matched against do."""

    def __init__(self, phrases: dict[str, str]):
        import ahocorasick

        held: dict[str, list] = {}
        for kind, named in (("base", phrases), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
            for phrase, label in named.items():
                words = words_of(phrase.encode())
                if words:  # bytes as characters, so that any UTF-8 text can be read
                    held.setdefault((b" " + b" ".join(words) + b" ").decode("latin-1"), []).append((kind, label, len(words)))
        self.automaton = ahocorasick.Automaton()
        for key, marks in held.items():
            self.automaton.add_word(key, (len(key), marks))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def places(self, words: list[bytes]) -> list[tuple[int, int, str, str]]:
        """(first word, end word, kind, label) of every phrase."""
        if self.empty or not words:
            return []
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return []
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = np.searchsorted(gaps, [end - size + 1 for end, (size, _) in found]).tolist()
        return [(s, s + n, kind, label) for s, (_, (_, marks)) in zip(starts, found, strict=True) for kind, label, n in marks]


def _versioned(words: list[bytes], end: int, label: str) -> tuple[str, int]:
    """The identifier with a version that stands right behind it, and the word after both."""
    at = end + (words[end : end + 1] == [b"license"])
    named = words[at : at + 1] == [b"version"]
    at += named
    if at >= len(words) or not _VERSION.fullmatch(words[at]):
        return label, end
    version = words[at].lstrip(b"v").decode()
    minor = words[at + 1] if at + 1 < len(words) else b""
    if re.fullmatch(rb"[0-9]", minor):
        return f"{label}-{version}.{minor.decode()}", at + 2
    return f"{label}-{version}", at + 1


def _leftmost(places) -> list[tuple[int, int, str]]:
    out, free = [], 0
    for start, end, label in sorted(places, key=lambda p: (p[0], -p[1], p[2])):
        if start >= free:
            out.append((start, end, label))
            free = end
    return out


def _joined(words: list[bytes], notices: list[tuple[int, int, str]]):
    """Tokens of notices that operators join: (first word, tokens)."""
    start, tokens, end = 0, [], 0
    for first, last, label in notices:
        label, last = _versioned(words, last, label)
        link = None
        if tokens and 0 < first - end <= 4:
            between = [w.decode("latin-1") for w in words[end:first]]
            told = [w for w in between if w not in FILLERS]
            if len(told) == 1 and told[0] in PRECEDENCE:
                link = told[0]
        if link:
            tokens += [link, label]
        else:
            if tokens:
                yield start, tokens
            start, tokens = first, [label]
        end = last
    if tokens:
        yield start, tokens


def _tagged(low: bytes, ends: list[int]):
    """Tokens behind each tag, to the end of its line: (word after the tag, word after the line, tokens)."""
    wanted = set(ends)
    for at, word in enumerate(_WORD.finditer(low), 1):
        if at in wanted:
            stop = low.find(b"\n", word.end())
            line = low[word.end() : stop if stop >= 0 else len(low)]
            yield at, at + len(_WORD.findall(line)), [t.decode().rstrip(".") for t in _TOKEN.findall(line)]


def expressions(text: bytes, words: list[bytes], places) -> list[dict]:
    tags = [e for _, e, kind, _ in places if kind == "tag"]
    lines = list(_tagged(text.lower(), tags)) if tags else []
    # What a tag's line names is the tag's.
    firsts, ends = [a for a, _, _ in lines], [0, *(b for _, b, _ in lines)]
    free = ((s, e, label) for s, e, kind, label in places if kind == "notice" and s >= ends[bisect_right(firsts, s)])
    tokens = [*_joined(words, _leftmost(free)), *((at, t) for at, _, t in lines)]
    out = []
    for start, ts in sorted(tokens):
        polish = reverse_polish([t for t in ts if t])
        if polish:
            text_form, value = evaluate(polish)
            labels = sorted({t for t in polish if t not in PRECEDENCE})
            out.append({"start": start, "expression": text_form, "labels": labels, "freedom": value})
    return out


PLACE = pa.struct([("start", pa.int64()), ("label", pa.string())])
FOUND = pa.struct([("start", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("freedom", pa.float64())])


def _task(phrases: dict[str, str]):
    def run(batches):
        machine = Machine(phrases)
        for batch in batches:
            counts, places, found, scores = [], [], [], []
            for text in batch.column(1):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                words = words_of(raw)
                met = machine.places(words)
                base = [{"start": s, "label": label} for s, _, kind, label in met if kind == "base"]
                told = expressions(raw, words, met) if met else []
                counts.append(len(words))
                places.append(base)
                found.append(told)
                scores.append(min((x["freedom"] for x in told), default=UNKNOWN))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(found, pa.list_(FOUND)), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places", "expressions", "score"])

    return run


def scan(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """(doc_id, n_words, places, expressions, score) of each document.

    ``places`` are (start word, label) of every base phrase by start; ``expressions`` are
    (start word, expression, labels, freedom) of notices and tags, in order.
    """
    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (
        "doc_id long, n_words long, places array<struct<start:long,label:string>>, "
        "expressions array<struct<start:long,expression:string,labels:array<string>,freedom:double>>, score double"
    )
    return rows.mapInArrow(_task(phrases), schema)
