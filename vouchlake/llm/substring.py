"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, owners found by one shuffle.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. Every window of ``window`` consecutive words of a document gets a
64-bit Rabin-Karp hash. The owner of a hash is the smallest doc_id in which it starts; in
every other document the words under the window are removed. Windows are judged on the
input, and overlapping or touching removals merge into maximal intervals.

Rows move as packed arrays: 1. each task finds the smallest doc_id per hash among its own
documents, so a passage in a third of all documents leaves a task once; 2. hashes are dealt
by value, owners are found, and the positions of the losing windows are dealt by document;
3. they meet the text, which is shuffled once in compressed form.

Defined cases: a null text has no words; a text with fewer words than the window stays
whole; a null doc_id is neither smaller nor larger, so its row stays whole and owns nothing;
rows with one doc_id do not remove each other's words (rows are told apart by the text's
crc32); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vouchlake.llm.common import bounded_batches, from_planes, mix64, planes, spans_of, width

#: Windows that a task holds before it sorts and sends them.
FLUSH_WINDOWS = 2_000_000
FLUSH_BYTES = 16 << 20
SEGMENT = 2 << 20

PACKED = "kind int, part int, data binary"
PACKED_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash per word, in order, worked off in segments that end between words."""
    space = _space_table()
    letters = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    powers = np.ones(1, np.uint64)
    out, at, data = [], 0, np.frombuffer(text, np.uint8)
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        while end < len(data) and not space[data[end]]:
            end += 1
        part = data[at:end]
        at = end
        inside = ~space[part]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        sizes = last - first
        if len(powers) < sizes.max():
            powers = np.full(int(sizes.max()), _BASE, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
        # Positions inside each word, without the spaces between words.
        heads = np.cumsum(sizes) - sizes
        offset = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
        terms = letters[part[inside]]
        terms *= powers[offset]
        out.append(mix64(np.add.reduceat(terms, heads) + sizes.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``window`` words, by its first word."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, window):
        total *= _STEP
        total += words[k : k + n]
    return mix64(total)


def _part_of(doc_ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(doc_ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _pack(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, hashes: np.ndarray | None) -> bytes:
    """Entries that lie together by document, then position: per-document heads and small steps."""
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    counts = np.diff(np.r_[head, len(doc)])
    step = np.diff(pos, prepend=0)
    step[head] = pos[head]
    ids = np.diff(doc[head], prepend=0)
    body = [np.array([len(head), len(doc)], np.int64).tobytes(), planes(ids), planes(tag[head].astype(np.uint32)), planes(counts.astype(np.uint32)), planes(step.astype(np.uint32))]
    return b"".join(body + ([hashes.tobytes()] if hashes is not None else []))


def _unpack(data: bytes, hashed: bool):
    heads, n = np.frombuffer(data, np.int64, 2)
    at, out = 16, []
    for dtype, count in ((np.int64, heads), (np.uint32, heads), (np.uint32, heads), (np.uint32, n)):
        size = np.dtype(dtype).itemsize * int(count)
        out.append(from_planes(data[at : at + size], dtype, int(count)))
        at += size
    ids, tags, counts, step = out
    counts = counts.astype(np.int64)
    first = np.cumsum(counts) - counts
    pos = np.cumsum(step.astype(np.int64))
    pos -= np.repeat(pos[first] - step[first], counts)
    hashes = np.frombuffer(data, np.uint64, int(n), at) if hashed else None
    return np.repeat(np.cumsum(ids), counts), np.repeat(tags, counts), pos, hashes


def _losers(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where a smaller doc_id holds the same hash."""
    order = np.argsort(hashes, kind="stable")
    ranked, ids = hashes[order], doc[order]
    head = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    least = np.repeat(np.minimum.reduceat(ids, head), np.diff(np.r_[head, len(ids)]))
    lost = np.zeros(len(ids), bool)
    lost[order] = ids > least
    return lost


def _by_part(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if edges[p] < edges[p + 1]:
            yield p, order[edges[p] : edges[p + 1]]


def _rows(rows: list[tuple[int, int, bytes]]):
    at = 0
    while at < len(rows):
        size, end = 0, at
        while end < len(rows) and (end == at or size + len(rows[end][2]) < 4 << 20):
            size += len(rows[end][2])
            end += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:end]), PACKED_ARROW.types)], schema=PACKED_ARROW)
        at = end


def _lost_rows(doc, tag, pos, parts: int, seed: int):
    """Losing windows by document part; ``part`` of the first deal is only a place to pass through."""
    return [(1, p, _pack(doc[i], tag[i], pos[i], None)) for p, i in _by_part(_part_of(doc, parts), parts)]


def _texts(batches):
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            value = text.as_buffer().to_pybytes() if text.is_valid else b""
            yield doc_id, value


def _hash_task(window: int, parts: int):
    def run(batches):
        held, count = [], 0

        def flush():
            doc, tag, pos, hashes = (np.concatenate(x) for x in zip(*held))
            lost = _losers(hashes, doc)
            rows = _lost_rows(doc[lost], tag[lost], pos[lost], parts, 0)
            keep = ~lost
            doc, tag, pos, hashes = doc[keep], tag[keep], pos[keep], hashes[keep]
            rows += [(0, p, _pack(doc[i], tag[i], pos[i], hashes[i])) for p, i in _by_part((hashes % np.uint64(parts)).astype(np.int64), parts)]
            yield from _rows(rows)

        for doc_id, text in _texts(batches):
            if doc_id is None:
                continue
            hashes = window_hashes(word_hashes(text), window)
            n = len(hashes)
            if not n:
                continue
            held.append((np.full(n, doc_id, np.int64), np.full(n, zlib.crc32(text), np.uint32), np.arange(n, dtype=np.int64), hashes))
            count += n
            if count >= FLUSH_WINDOWS:
                yield from flush()
                held, count = [], 0
        if held:
            yield from flush()

    return run


def _owner_task(parts: int):
    def run(batches):
        held = []
        for batch in batches:
            for kind, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                value = data.as_buffer().to_pybytes()
                if kind == 1:
                    yield from _rows([(1, part, value)])
                else:
                    held.append(_unpack(value, True))
        if held:
            doc, tag, pos, hashes = (np.concatenate(x) for x in zip(*held))
            del held
            lost = _losers(hashes, doc)
            doc, tag, pos = doc[lost], tag[lost], pos[lost]
            del hashes
            order = np.lexsort((pos, tag, doc))
            yield from _rows(_lost_rows(doc[order], tag[order], pos[order], parts, 0))

    return run


def _text_task(parts: int):
    """Whole texts, dealt by document, many of one part in one compressed block."""

    def run(batches):
        press, held, size = zstandard.ZstdCompressor(level=3), {}, 0

        def rows():
            for part, items in held.items():
                heads = np.array([(d or 0, d is None, t is None, 0 if t is None else len(t)) for d, t in items], np.int64)
                yield from _rows([(2, part, np.int64(len(items)).tobytes() + heads.tobytes() + press.compress(b"".join(t or b"" for _, t in items)))])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text.as_buffer().to_pybytes() if text.is_valid else None
                # A null id has no place of its own: its rows are dealt by their text.
                part = int(_part_of(np.array([doc_id if doc_id is not None else zlib.crc32(value or b"")], np.int64), parts)[0])
                held.setdefault(part, []).append((doc_id, value))
                size += len(value or b"") + 32
                if size >= FLUSH_BYTES:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()

    return run


def _cut(doc_id, text: bytes, starts: np.ndarray | None, window: int):
    words = text.split()
    if starts is None or not len(words):
        return doc_id, len(words), 0, [], b" ".join(words)
    first, last = spans_of(np.unique(starts))
    last = last + window - 1
    # Runs of starts less than a window apart cover touching words and merge again.
    new = np.r_[True, first[1:] > np.maximum.accumulate(last)[:-1]]
    first, last = first[new], np.r_[last[np.flatnonzero(new)[1:] - 1], last[-1]]
    kept, at = [], 0
    for a, b in zip(first.tolist(), last.tolist()):
        kept += words[at:a]
        at = b
    kept += words[at:]
    spans = [{"start": a, "end": b} for a, b in zip(first.tolist(), last.tolist())]
    return doc_id, len(words), len(words) - len(kept), spans, b" ".join(kept)


def _cut_task(window: int):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "spans", "kept_text"]

    def emit(rows):
        columns = [list(c) for c in zip(*rows)]
        texts = pa.array(columns[4], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:4], types)] + [texts], names)

    def run(batches):
        lost, starts, unpress = [], None, zstandard.ZstdDecompressor()
        out, size = [], 0
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                value = data.as_buffer().to_pybytes()
                if kind == 1:
                    lost.append(_unpack(value, False)[:3])
                    continue
                if starts is None:
                    starts = {}
                    if lost:
                        doc, tag, pos = (np.concatenate(x) for x in zip(*lost))
                        lost = []
                        order = np.lexsort((pos, tag, doc))
                        doc, tag, pos = doc[order], tag[order], pos[order]
                        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
                        ends = np.r_[head[1:], len(doc)]
                        starts = {(d, t): pos[a:b] for d, t, a, b in zip(doc[head].tolist(), tag[head].tolist(), head.tolist(), ends.tolist())}
                n = int(np.frombuffer(value, np.int64, 1)[0])
                heads = np.frombuffer(value, np.int64, 4 * n, 8).reshape(n, 4).tolist()
                text = unpress.decompress(value[8 + 32 * n :])
                at = 0
                for doc_id, no_id, _, length in heads:
                    one = text[at : at + length]
                    at += length
                    row = _cut(None if no_id else doc_id, one, None if no_id else starts.get((doc_id, zlib.crc32(one))), window)
                    out.append(row)
                    size += length + 64
                    if size >= 4 << 20:
                        yield emit(out)
                        out, size = [], 0
        if out:
            yield emit(out)

    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """Cut from each document the word windows that a smaller doc_id also holds.

    Returns doc_id, n_words, n_removed, ``spans`` (maximal removed intervals of word
    positions, end exclusive) and ``kept_text`` (kept words joined by one space).
    """
    spark = bounded_batches(docs)
    parts = width(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.mapInArrow(_hash_task(window, parts), PACKED)
    lost = hashed.repartitionById(parts, F.col("part")).mapInArrow(_owner_task(parts), PACKED)
    texts = docs.mapInArrow(_text_task(parts), PACKED)
    both = lost.unionByName(texts).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    return both.mapInArrow(_cut_task(window), RESULT)
