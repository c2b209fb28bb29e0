"""Benchmark decontamination by a generalised suffix automaton over test items.

A-Z lower-cased; a word is a maximal run of letters, digits and non-ASCII characters.
All test items go into one suffix automaton of words. A document's words stream through
it; at every word the state gives the longest match that ends there. A match of
``window`` words or more is an occurrence of a window; an item of fewer words (but not
none) occurs only whole. Words under an occurrence are hit. The state of the
window-length suffix knows the items that hold the window.

The automaton is broadcast. Its size is bounded: items are dealt into blocks of at most
``BLOCK_WORDS`` words (an item longer than that is a block of its own, cut into pieces
that overlap by a window less one word, so no window is lost), one pass over the
documents each, and what a pass finds travels on with the row.

Defined cases: a null text has no words and is clean; null or wordless items never occur;
a null item_id is reported as no item but its windows still hit; repeated item_ids count
once; a null or repeated doc_id gives one row per input row; an empty benchmark or
document table gives clean rows or no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.llm.common import bounded_batches, spans_of
from vouchlake.llm.components import stored

#: Item words in one automaton; about 500 bytes of memory each.
BLOCK_WORDS = 200_000


def _fold_table() -> bytes:
    """Byte map: A-Z to a-z, other ASCII but letters and digits to space, the rest unchanged."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


FOLD = _fold_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; states are numbered, 0 is the start."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        states = len(self.length)
        # The ancestor that stands for the window-length suffix, for states that hold one.
        self.at_window = [-1] * states
        self.whole: dict[int, list[tuple[int, int]]] = {}
        order = sorted(range(1, states), key=self.length.__getitem__)
        for v in order:
            parent = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[parent] < window else self.at_window[parent]
        self.items: dict[int, set[str]] = {}
        short: dict[int, dict[int, set]] = {}
        for item, word_ids in coded:
            v = 0
            if len(word_ids) < window:
                for w in word_ids:
                    v = self.next[v][w]
                short.setdefault(v, {}).setdefault(len(word_ids), set()).add(item)
                self.shortest = min(self.shortest, len(word_ids))
                continue
            length = 0
            for w in word_ids:  # the item's own run through the automaton never leaves it
                v, length = self.next[v][w], length + 1
                if length >= window:
                    self.items.setdefault(self.at_window[v], set()).add(item)
        # Whole short items that end where a match of each state ends.
        self.short: list[tuple] = [()] * states
        for v in order:
            above = self.short[self.link[v]]
            own = tuple((n, frozenset(s)) for n, s in short.get(v, {}).items())
            self.short[v] = own + above if own else above
        self.any_short = bool(short)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set]:
        """First and last + 1 word of each occurrence, and the items they belong to."""
        known = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        firsts, lasts, items = [], [], set()
        nexts, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        # Only runs of known words as long as the shortest window can match.
        edges = np.r_[-1, np.flatnonzero(known < 0), len(known)]
        runs = np.flatnonzero(np.diff(edges) > self.shortest)
        for a, b in zip((edges[runs] + 1).tolist(), edges[runs + 1].tolist()):
            v = matched = 0
            for i, w in enumerate(known[a:b].tolist(), a):
                step = nexts[v].get(w)
                while step is None and v:
                    v = link[v]
                    matched = length[v]
                    step = nexts[v].get(w)
                if step is None:
                    continue
                v, matched = step, matched + 1
                if matched >= window:
                    firsts.append(i - window + 1)
                    lasts.append(i + 1)
                    items |= self.items[self.at_window[v]]
                if short[v]:
                    for n, found in short[v]:
                        if n <= matched:
                            firsts.append(i - n + 1)
                            lasts.append(i + 1)
                            items |= found
        return firsts, lasts, items


def _merge(firsts: list[int], lasts: list[int], n_words: int) -> list[dict]:
    if not firsts:
        return []
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, firsts, 1)
    np.add.at(edge, lasts, -1)
    start, end = spans_of(np.flatnonzero(np.cumsum(edge[:-1]) > 0))
    return [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())]


HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = {"_n_words": "long", "_hits": "array<struct<start:long,end:long>>", "_items": "array<string>"}


def _scan_task(automaton):
    """The last four columns are text, words, hits and items; what a block finds joins what others found."""

    def run(batches):
        machine = automaton.value
        for batch in batches:
            keep, text_at = batch.columns[:-4], batch.num_columns - 4
            counts, hits, items = [], [], []
            for text, old_hits, old_items in zip(batch.column(text_at), batch.column(text_at + 2).to_pylist(), batch.column(text_at + 3).to_pylist()):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                firsts, lasts, found = machine.scan(words)
                for x in old_hits or ():
                    firsts.append(x["start"])
                    lasts.append(x["end"])
                counts.append(len(words))
                hits.append(_merge(firsts, lasts, len(words)))
                items.append(sorted({x for x in found if x is not None}.union(old_items or ())))
            columns = [*keep, batch.column(text_at), pa.array(counts, pa.int64()), pa.array(hits, HITS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _blocks(benchmark: DataFrame, window: int):
    """Items in blocks of bounded size, read one at a time; long items in overlapping pieces."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter(F.col("text").isNotNull()).toLocalIterator()
    for item, text in rows:
        words = words_of(text.encode())
        step = BLOCK_WORDS - window + 1
        pieces = [words] if len(words) <= BLOCK_WORDS else [words[a : a + BLOCK_WORDS] for a in range(0, len(words) - window + 1, step)]
        for piece in pieces:
            if held and size + len(piece) > BLOCK_WORDS:
                yield held
                held, size = [], 0
            held.append((item, piece))
            size += len(piece)
    yield held


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, keep: list[Column]) -> DataFrame:
    """The kept columns with the text and what all blocks find: one pass per block, a written table between passes."""
    spark = bounded_batches(docs)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"), *[F.lit(None).cast(t).alias(c) for c, t in FOUND.items()])
    first = True
    for items in _blocks(benchmark, window):
        rows = rows if first else stored(rows, "scanned")[0]
        rows = rows.mapInArrow(_scan_task(spark.sparkContext.broadcast(Automaton(items, window))), rows.schema)
        first = False
    return rows


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, hits, items) of each document.

    ``hits`` are maximal intervals of hit word positions, end exclusive; ``items`` the
    sorted item_ids (as text) with an occurring window.
    """
    rows = _scanned(docs, benchmark, window, [F.col("doc_id").cast("long").alias("doc_id")])
    return rows.select("doc_id", *[F.col(c).alias(c[1:]) for c in FOUND])


def judged(found: DataFrame) -> DataFrame:
    """Add n_hit, n_items and contaminated: some word is hit and at least one in twenty."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    found = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_only(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    columns = docs.columns
    rows = _scanned(docs, benchmark, window, [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")])
    found = judged(rows.select("_row", *[F.col(c).alias(c[1:]) for c in FOUND]))
    return found.filter("not contaminated").select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def _cut_task(batches):
    """The text without the words of each span in the last column; what stands between words stays."""
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
            if not text.is_valid or not spans:
                texts.append(text.as_py())
                continue
            raw = text.as_buffer().to_pybytes()
            folded = np.frombuffer(raw.translate(FOLD), np.uint8)
            first, last = spans_of(np.flatnonzero(folded != 32))
            pieces, at = [], 0
            for x in spans:
                pieces.append(raw[at : first[x["start"]]])
                at = last[x["end"] - 1]
            texts.append(b"".join([*pieces, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], batch.schema.names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, length: int = 13, coverage: float = 0.05) -> DataFrame:
    """The documents without the spans that exceed a limit; all rows and columns stay.

    A span is a maximal run of hit words. It goes if it has ``length`` words or more; every span
    of a document goes if hit words are at least ``coverage`` of its words. Both are judged on the
    input: words that meet where a span stood are not searched again. Texts without a span to
    remove, null ones included, are unchanged; ``n_chars`` follows the text where it exists; texts
    of any length are cut whole, one document at a time.
    """
    columns = docs.columns
    rows = _scanned(docs, benchmark, window, [F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")])
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    cut = F.when(n_hit >= coverage * F.col("_n_words"), F.col("_hits")).otherwise(F.filter("_hits", lambda x: x["end"] - x["start"] >= length))
    rows = rows.select("_row", "_text", cut.alias("_cut"))
    rows = rows.mapInArrow(_cut_task, rows.schema)
    own = {c: F.col(f"_row.`{c}`") for c in columns} | {"text": F.col("_text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.size("_cut") > 0, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[own[c].alias(c) for c in columns])
