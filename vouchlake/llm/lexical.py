"""Ranked lexical search over bit-sliced Bloom signatures, exact for every item.

A-Z lower-cased; a term is a maximal run of letters, digits and non-ASCII characters. The score
of a document for an item is the integer BM25 sum that ``search`` states.

**Index.** A document's signature is a Bloom filter of its terms. A term that occurs more often
also sets the keys of its frequency levels (2, 3, 5, 9, 17, ... times and more), so a signature bounds
term frequencies too. Documents of like signature width are packed into blocks of at most
``BLOCK_DOCS``; a block stores its signatures by bit position, one row of documents per bit
(the slice). The width follows the number of keys (``BITS`` each at least), up to ``WIDEST``;
signatures beyond are only fuller, which loosens their bounds and loses nothing. One pass over the texts
writes the index and counts the documents of every item term.

**Search.** And-ing the slices of a term gives a bitmap of documents that may hold it, never too
few; the greatest frequency of the level met gives the most it can add there, and the weighted sum over an
item's terms bounds the score from above. The ``SEEDS`` highest bounds of each item are scored
exactly; the k-th best of those is the item's bar. Every document whose bound reaches the bar
of some item is then scored from its text. No document that belongs to the result has a bound under the bar.

**Size.** Items go through in groups: the texts are read once for the term counts of a group of
``GROUP_WORDS`` words, the index once for each block of ``ITEMS`` items or ``ITEM_WORDS`` words. What is broadcast is
bounded by these (an item longer than that makes a block of its own). Candidates reach their
texts by a join on doc_id.

Defined cases: a null, empty or termless text has no terms and is never found; so is an item without
terms; repeated item_ids are ranked row by row; a null doc_id ranks behind others of its
score; repeated doc_ids are separate rows; texts of any length are read whole; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vouchlake.llm.common import Shared, bounded_batches, mix64
from vouchlake.llm.components import stored
from vouchlake.llm.decontaminate import words_of
from vouchlake.session import forget, scratch

#: Least bits of signature per key, hash functions, narrowest and widest signature.
BITS, HASHES, NARROWEST, WIDEST = 10, 4, 256, 1 << 20
#: Documents and bytes of slices in one block of the index.
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 20
#: Items whose bounds are computed at once, by number and by words; words counted in one pass over the texts.
ITEMS, ITEM_WORDS, GROUP_WORDS = 1024, 65_536, 1_000_000
#: Highest bounds of an item that are scored to set its bar, at least.
SEEDS = 64
#: Distinct words remembered by a task; terms of one step of the bounds.
CACHE, STEP = 1_000_000, 2048
#: Stands for a null doc_id inside the index; rows with either id are then scored.
NO_ID = -(1 << 63)
#: Least frequency of each level; a document of level j holds the term at most
#: ``LEVELS[j + 1] - 1`` times (no text has 2^32 words), and 10^9 times that is still a long.
LEVELS = np.array([1, 2, *[(1 << j) + 1 for j in range(1, 33)]], np.int64)


def _keys(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix64(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _bits(keys: np.ndarray, width: int) -> np.ndarray:
    """(keys, HASHES) bit positions by double hashing."""
    step = keys >> np.uint64(32) | np.uint64(1)
    return ((keys[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(width - 1)).astype(np.int64)


def _factor(tf, n, rows: int, total: int):
    """(10^9 tf) div (1000 tf + 12 m) of a term in documents of n terms."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * n * rows // total))


class _Terms(dict):
    """Number of each word; its hash and its number among the item terms (or -1) by that."""

    def __init__(self, wanted: dict[bytes, int]):
        import xxhash

        super().__init__()
        self.wanted, self.hash_of = wanted, xxhash.xxh64_intdigest
        self.hashes, self.ids = [], []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(self.hash_of(word))
        self.ids.append(self.wanted.get(word, -1))
        return n


class _Block:
    """Documents of one signature width until they are packed."""

    def __init__(self, width: int):
        self.width, self.ids, self.sizes, self.keys, self.terms = width, [], [], [], []
        self.room = min(BLOCK_DOCS, max(8, BLOCK_BYTES * 8 // width))

    def packed(self, slices: bool) -> dict:
        n = len(self.ids)
        terms, counts = np.unique(np.concatenate(self.terms), return_counts=True)
        out = {
            "width": self.width, "docs": n, "total": sum(self.sizes), "ids": np.array(self.ids, np.int64).tobytes(),
            "sizes": np.array(self.sizes, np.int64).tobytes(), "terms": terms, "counts": counts, "slices": None,
        }
        if slices:
            plane = np.zeros((self.width, n), bool)
            owner = np.repeat(np.arange(n), [len(k) for k in self.keys])
            plane[_bits(np.concatenate(self.keys), self.width), owner[:, None]] = True
            out["slices"] = np.packbits(plane, axis=1).tobytes()
        return out


FIELDS = [("width", pa.int32()), ("docs", pa.int64()), ("total", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()),
          ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("slices", pa.binary())]
INDEX = "width int, docs long, total long, ids binary, sizes binary, terms array<int>, counts array<long>, slices binary"


def _index_task(wanted, slices: bool):
    """Blocks of signatures with the number of their documents that hold each item term."""

    def row(block):
        made = block.packed(slices)
        return pa.RecordBatch.from_arrays([pa.array([made[name]], kind) for name, kind in FIELDS], [name for name, _ in FIELDS])

    def run(batches):
        terms, blocks = _Terms(wanted.value), {}
        for batch in batches:
            if len(terms) > CACHE:
                terms = _Terms(wanted.value)
            docs = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counter(words_of(text.as_buffer().to_pybytes())) if text.is_valid else ()
                if counts:
                    slots = np.fromiter(map(terms.__getitem__, counts), np.int64, len(counts))
                    docs.append((doc_id, slots, np.fromiter(counts.values(), np.int64, len(counts))))
            hashes, ids = np.array(terms.hashes, np.uint64), np.array(terms.ids, np.int32)
            for doc_id, slots, tf in docs:
                own = hashes[slots]
                keys = [_keys(own, 0)]
                for level in range(1, int(np.searchsorted(LEVELS, tf.max(), "right"))):
                    keys.append(_keys(own[tf >= LEVELS[level]], level))
                keys = np.concatenate(keys)
                width = min(WIDEST, max(NARROWEST, 1 << int(BITS * len(keys) - 1).bit_length()))
                block = blocks.setdefault(width, _Block(width))
                block.ids.append(NO_ID if doc_id is None else doc_id)
                block.sizes.append(int(tf.sum()))
                block.keys.append(keys if slices else keys[:0])
                met = ids[slots]
                block.terms.append(met[met >= 0])
                if len(block.ids) >= block.room:
                    yield row(blocks.pop(width))
        for block in blocks.values():
            yield row(block)

    return run


class Items:
    """Some items with their terms and weights; what a search task needs."""

    def __init__(self, items, weights: dict[bytes, int], rows: int, total: int):
        self.ids, self.rows, self.total = [i for i, _ in items], rows, total
        self.terms: dict[bytes, int] = {}
        self.of_item, postings = [], []
        for q, (_, words) in enumerate(items):
            pairs = [(self.terms.setdefault(w, len(self.terms)), n * weights[w]) for w, n in Counter(words).items() if weights.get(w)]
            self.of_item.append((np.array([t for t, _ in pairs], np.int64), np.array([x for _, x in pairs], np.int64)))
            postings += [(t, q, x) for t, x in pairs]
        held = np.array(sorted(postings), np.int64).reshape(-1, 3)
        self.post_at = np.searchsorted(held[:, 0], np.arange(len(self.terms) + 1))
        self.post_item, self.post_weight = held[:, 1], held[:, 2]
        self.bars = np.ones(len(items), np.int64)

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.array([xxhash.xxh64_intdigest(w) for w in self.terms], np.uint64)

    def bounds(self, hashes: np.ndarray, width: int, sizes: np.ndarray, slices: bytes) -> np.ndarray:
        """(items, documents) upper bounds of the scores in one block."""
        n = len(sizes)
        plane = np.frombuffer(slices, np.uint8).reshape(width, -1)
        most = [_factor(LEVELS[j + 1] - 1, sizes, self.rows, self.total).astype(np.float64) for j in range(len(LEVELS) - 1)]
        out = np.zeros((len(self.ids), n))
        for a in range(0, len(hashes), STEP):
            part = hashes[a : a + STEP]
            live, seen = np.arange(len(part)), None
            adds = np.zeros((len(part), n))
            for level, factor in enumerate(most):
                here = np.bitwise_and.reduce(plane[_bits(_keys(part[live], level), width)], axis=1)
                here = here if seen is None else here & seen
                met = here.any(axis=1)
                live, seen = live[met], here[met]
                if not len(live):
                    break
                adds[live] = np.where(np.unpackbits(seen, axis=1, count=n).view(bool), factor, adds[live])
            for q, (terms, weights) in enumerate(self.of_item):
                inside = (terms >= a) & (terms < a + STEP)
                if inside.any():
                    out[q] += weights[inside].astype(np.float64) @ adds[terms[inside] - a]
        return out

    def score(self, words: list[bytes]) -> np.ndarray:
        """Exact scores of one text for every item."""
        out = np.zeros(len(self.ids), np.int64)
        for word, tf in Counter(words).items():
            t = self.terms.get(word)
            if t is not None:
                own = slice(self.post_at[t], self.post_at[t + 1])
                out[self.post_item[own]] += self.post_weight[own] * _factor(tf, len(words), self.rows, self.total)
        return out


def _blocks_of(batches):
    for batch in batches:
        for width, ids, sizes, slices in zip(*batch.columns, strict=True):
            yield width.as_py(), np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(sizes.as_buffer(), np.int64), slices.as_buffer()


def _seeds_task(held, seeds: int):
    """A task's ``seeds`` highest bounds of each item."""

    def run(batches):
        items = held.load()
        hashes = items.hashes()
        best, ids = np.zeros((len(items.ids), 0)), np.zeros((len(items.ids), 0), np.int64)
        for width, own, sizes, slices in _blocks_of(batches):
            best = np.hstack([best, items.bounds(hashes, width, sizes, slices)])
            ids = np.hstack([ids, np.broadcast_to(own, (len(items.ids), len(own)))])
            if best.shape[1] > seeds:
                top = np.argpartition(-best, seeds - 1, axis=1)[:, :seeds]
                best, ids = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1)
        item, at = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[item, at]), pa.array(ids[item, at])], ["item", "bound", "id"])

    return run


def _left_task(held):
    """Ids of the documents that the bounds do not exclude from every item."""

    def run(batches):
        items = held.load()
        hashes = items.hashes()
        # A bound is a sum of integers; beyond 2^53 it may be rounded.
        bars = items.bars[:, None] * (1 - 1e-9)
        for width, own, sizes, slices in _blocks_of(batches):
            left = (items.bounds(hashes, width, sizes, slices) >= bars).any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(own[left])], ["id"])

    return run


def _score_task(held, k: int):
    """A task's ``k`` best documents of each item at or over its bar, by exact score."""

    def best(*columns):
        item, score, ids, none = columns
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        return [x[order][rank < k] for x in columns]

    def run(batches):
        items = held.load()
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for batch in batches:
            found = [kept]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    scores = items.score(words_of(text.as_buffer().to_pybytes()))
                    item = np.flatnonzero(scores >= items.bars)
                    found.append([item, scores[item], np.full(len(item), doc_id or 0, np.int64), np.full(len(item), doc_id is None)])
            kept = best(*[np.concatenate(x) for x in zip(*found, strict=True)])
        item, score, ids, none = kept
        names = pa.array([items.ids[q] for q in item.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), names, pa.array(ids, mask=none), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return run


def _groups(items: DataFrame):
    """Items as (item_id, words), in groups of bounded size, read one at a time."""
    held, size = [], 0
    for item, text in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").toLocalIterator():
        words = words_of(text.encode())
        if held and size + len(words) > GROUP_WORDS:
            yield held
            held, size = [], 0
        if words:
            held.append((item, words))
            size += len(words)
    if held:
        yield held


def _parts(group):
    held, size = [], 0
    for item in group:
        if held and (len(held) >= ITEMS or size + len(item[1]) > ITEM_WORDS):
            yield held
            held, size = [], 0
        held.append(item)
        size += len(item[1])
    yield held


def _weights(index: DataFrame, wanted: dict[bytes, int]) -> tuple[dict[bytes, int], int, int]:
    """Weight of each item term, number of documents with terms and of all their terms."""
    rows, total = index.agg(F.sum("docs"), F.sum("total")).first()
    if not rows:
        return {}, 0, 0
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy("p.terms").agg(F.sum("p.counts").alias("df"))
    df = {r["terms"]: r["df"] for r in pairs.collect()}
    weight = {w: math.floor(1000 * math.log((2 * rows + 2) / (2 * df[t] + 1))) for w, t in wanted.items() if t in df}
    return weight, rows, total


def _scored(docs: DataFrame, ids: DataFrame, held, k: int) -> DataFrame:
    """Exact scores of the documents with the given ids, the ``k`` best of each item and task."""
    own = docs.join(ids.distinct(), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("id"), "left_semi")
    return own.mapInArrow(_score_task(held, k), "item int, item_id long, doc_id long, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    With N documents that have terms, L their terms, n a document's, df the documents of a term
    and tf its occurrences: a term weighs floor(1000 ln((2N+2)/(2df+1))), m is
    75 + (25 n N) div L, and a score sums weight * ((10^9 tf) div (1000 tf + 12 m)) over the
    item's terms with repeats. Equal scores rank by doc_id.
    """
    spark = bounded_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    results, index = scratch(spark, "ranked"), None
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(results)
    for group in _groups(items):
        wanted: dict[bytes, int] = {}
        for _, words in group:
            for w in words:
                wanted.setdefault(w, len(wanted))
        shared = spark.sparkContext.broadcast(wanted)
        counted, path = stored(docs.mapInArrow(_index_task(shared, index is None), INDEX), "signatures")
        weights, rows, total = _weights(counted, wanted)
        index = counted.select("width", "ids", "sizes", "slices") if index is None else index
        shared.unpersist()
        if not rows:
            break
        for part in _parts(group):
            _search_part(spark, docs, index, Items(part, weights, rows, total), k).select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(results)
    return spark.read.schema(schema).parquet(results)


def _search_part(spark, docs: DataFrame, index: DataFrame, items: Items, k: int) -> DataFrame:
    held = Shared(spark, items)
    bounds = index.mapInArrow(_seeds_task(held, max(SEEDS, k)), "item int, bound double, id long")
    top = Window.partitionBy("item").orderBy(F.desc("bound"))
    seeds, _ = stored(bounds.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= max(SEEDS, k)).select("id"), "seeds")
    for r in _ranked(_scored(docs, seeds, held, k), k).filter(F.col("rank") == k).select("item", "score").collect():
        items.bars[r["item"]] = r["score"]
    barred = Shared(spark, items)
    left, _ = stored(index.mapInArrow(_left_task(barred), "id long"), "left")
    return _ranked(_scored(docs, left, barred, k), k)
