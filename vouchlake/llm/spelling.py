"""Spelling variants by a frequency-vector trie searched with a budget of one surplus and one deficit.

**Words.** Runs of Latin letters (A-Z lower-cased only), counted over all texts; ``words`` takes a
rule that may change single occurrences. Frequent enough and long enough ones are the vocabulary.

**Trie.** Letters are dealt into ``LEVELS`` groups, the most frequent ones alone. A word's vector has
its letter count of each group; the trie arranges words by one count after the other. One
edit adds at most one letter to one group and takes at most one from one, so a depth-first
search that spends at most one surplus and one deficit on its way meets every near word. A
pair of different vectors is met from one side only: the deficit may not come before the surplus, so
it is the word with the lesser count at the first level where they differ that asks. Words at the leaves are verified letter by letter. Below ``LEAF`` pairs of members and probes the
rest of the levels is compared at once; the budget is the same.

**On Spark.** The trie is cut into subtrees of at most ``SUBTREE`` words: the driver keeps only the
prefixes of counts that hold more (at most one in ``SUBTREE`` words per level, found by counting in Spark).
Every word travels to its own subtree as a member and, as a probe, to the subtrees that the
budget reaches. A task meets a subtree's members first, then its probes in batches; it
returns, per probe and per member, the number of near words and the most frequent of them, never pairs. More than ``SUBTREE``
words of one whole vector are dealt out by hash, and probes go to each part.

Counts are held up to 255; two counts beyond are taken as equal there, which lets more words
through to verification and none be lost.

Defined cases: a null or empty text has no words; a null doc_id counts as the empty text in
the rule's hash; repeated rows count each; runs of any length are words, compared outside the packed
letters beyond ``PACKED``; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouchlake.llm.common import bounded_batches, width
from vouchlake.llm.components import stored
from vouchlake.session import forget

#: Groups of letters, of which so many are single letters.
LEVELS, SINGLE = 20, 15
#: Words in one subtree, pairs compared at once at a leaf, pairs verified at once.
SUBTREE, LEAF, PAIRS = 25_000, 60_000, 500_000
#: Levels of a leaf that are compared for all its pairs before the others for those left.
FIRST = 4
#: Letters of a word that stand in the packed arrays.
PACKED = 64
#: Distinct words a counting task holds; levels counted in one pass of the cut.
HELD, DEPTHS = 300_000, 4

#: A run in UTF-8: a-z, and U+00C0 to U+00FF, which are the byte C3 and one more.
_RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")


def drop_one_in(modulus: int):
    """Rule that deletes a letter of a run where ``modulus`` divides the crc32 of ``<doc_id>:<run>``."""

    def rule(doc_id: str):
        base = zlib.crc32(f"{doc_id}:".encode())

        def changed(run: bytes) -> str:
            h = zlib.crc32(run, base)
            word = run.decode()
            if h % modulus:
                return word
            at = h % len(word)
            return word[:at] + word[at + 1 :]

        return changed

    return rule


def _count_task(rule, least: int):
    def emit(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                changed = rule(str(doc_id.as_py()) if doc_id.is_valid else "")
                for word, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().lower())).items():
                    word = changed(word)
                    if len(word) >= least:
                        held[word] += n
            if len(held) > HELD:
                yield emit(held)
                held.clear()
        yield emit(held)

    return run


def words(docs: DataFrame, rule, least_letters: int = 7, least_times: int = 2) -> DataFrame:
    """(word, n) of the runs of all texts after ``rule``, long and frequent enough."""
    bounded_batches(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_count_task(rule, least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


class Words:
    """Words as Latin-1 bytes: their vectors and, packed from both ends, their letters."""

    def __init__(self, texts: list[str], group: np.ndarray):
        self.raw = [t.encode("latin-1") for t in texts]
        self.size = np.fromiter(map(len, self.raw), np.int64, len(texts))
        flat = np.frombuffer(b"".join(self.raw), np.uint8)
        owner = np.repeat(np.arange(len(texts)), self.size)
        counts = np.bincount(owner * LEVELS + group[flat], minlength=len(texts) * LEVELS)
        self.vector = np.minimum(counts, 255).astype(np.uint8).reshape(len(texts), LEVELS)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        fits = (self.size <= PACKED)[owner]
        self.left = np.zeros((len(texts), PACKED), np.uint8)
        self.right = np.zeros((len(texts), PACKED), np.uint8)
        self.left[owner[fits], at[fits]] = flat[fits]
        self.right[owner[fits], (self.size[owner] - 1 - at)[fits]] = flat[fits]


def one_edit(a: bytes, b: bytes) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short = min(len(a), len(b))
    head = next((i for i in range(short) if a[i] != b[i]), short)
    return a[head + 1 :] == b[head + (len(a) == len(b)) :] if len(a) >= len(b) else a[head:] == b[head + 1 :]


def _near(probes: Words, p: np.ndarray, members: Words, m: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart."""
    a, b = probes.size[p], members.size[m]
    ahead = probes.left[p] != members.left[m]
    back = probes.right[p] != members.right[m]
    first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), PACKED)
    last = np.where(back.any(axis=1), back.argmax(axis=1), PACKED)
    out = np.where(a == b, ahead.sum(axis=1) == 1, (np.abs(a - b) == 1) & (first + last >= np.minimum(a, b)))
    for i in np.flatnonzero((a > PACKED) | (b > PACKED)).tolist():
        out[i] = one_edit(probes.raw[p[i]], members.raw[m[i]])
    return out


def _places(n: np.ndarray, texts: list[str]) -> np.ndarray:
    """Place of each word by falling number, then by letters."""
    place = np.empty(len(texts), np.int64)
    place[sorted(range(len(texts)), key=lambda i: (-n[i], texts[i]))] = np.arange(len(texts))
    return place


class Subtree:
    """The words under one prefix of counts; a node is a range of the sorted vectors."""

    def __init__(self, texts: list[str], n: list[int], group: np.ndarray, depth: int):
        own = Words(texts, group)
        order = np.lexsort([*own.vector.T[::-1], own.size])
        self.texts, self.n = [texts[i] for i in order], np.array(n, np.int64)[order]
        self.words, self.depth = Words(self.texts, group), depth
        self.place = _places(self.n, self.texts)
        self.at_place = np.argsort(self.place)
        #: What probes found of each member: near words, and the best as (-n, word).
        self.met = np.zeros(len(order), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def search(self, probes: Words, n: np.ndarray, texts: list[str]):
        """(near words, best member as (-n, word)) of each probe with any; members keep their side of a pair of different vectors."""
        found = np.zeros(len(texts), np.int64)
        best = np.full(len(texts), len(self.texts), np.int64)
        met = np.zeros(len(self.texts), np.int64)
        back = np.full(len(self.texts), len(texts), np.int64)
        place = _places(n, texts)
        for p, m in self._pairs(probes):
            np.add.at(found, p, 1)
            np.minimum.at(best, p, self.place[m])
            apart = (probes.vector[p] != self.words.vector[m]).any(axis=1) | (probes.size[p] != self.words.size[m])
            np.add.at(met, m[apart], 1)
            np.minimum.at(back, m[apart], place[p[apart]])
        self.met += met
        at_place = np.argsort(place)
        for m in np.flatnonzero(met).tolist():
            i = int(at_place[back[m]])
            own = (-int(n[i]), texts[i])
            self.best[m] = min(own, self.best.get(m, own))
        for p in np.flatnonzero(found).tolist():
            i = int(self.at_place[best[p]])
            yield texts[p], int(found[p]), (-int(self.n[i]), self.texts[i])

    def members(self):
        for m, best in self.best.items():
            yield self.texts[m], int(self.met[m]), best

    def _pairs(self, probes: Words):
        """Verified (probes, members) one edit apart: a surplus before a deficit, or one vector."""
        member, probe = self.words.vector, probes.vector
        over = member[:1, : self.depth].astype(np.int16) - probe[:, : self.depth].astype(np.int16)
        surplus, deficit = np.maximum(over, 0).sum(1, np.int16), np.maximum(-over, 0).sum(1, np.int16)
        stack = []
        sizes, starts = np.unique(self.words.size, return_index=True)
        for size, low, high in zip(sizes, starts.tolist(), [*starts[1:].tolist(), len(member)], strict=True):
            # The count of all letters comes first: it is the asking word's or one more.
            live = np.flatnonzero((probes.size == size) | (probes.size == size - 1))
            if len(live):
                stack.append((low, high, self.depth, live, surplus[live], deficit[live]))
        while stack:
            low, high, depth, live, surplus, deficit = stack.pop()
            if depth == LEVELS or (high - low) * len(live) <= LEAF:
                step = max(1, PAIRS // (high - low))
                for a in range(0, len(live), step):
                    part = slice(a, a + step)
                    yield self._leaf(probes, low, high, depth, live[part], surplus[part], deficit[part])
                continue
            counts, starts = np.unique(member[low:high, depth], return_index=True)
            ends = np.append(starts[1:], high - low)
            asked = probe[live, depth].astype(np.int16)
            for count, a, b in zip(counts.astype(np.int16), starts.tolist(), ends.tolist(), strict=True):
                over = count - asked
                more, less = surplus + np.maximum(over, 0), deficit + np.maximum(-over, 0)
                on = (more <= 1) & (less <= more)
                if on.any():
                    stack.append((low + a, low + b, depth + 1, live[on], more[on], less[on]))

    def _leaf(self, probes: Words, low: int, high: int, depth: int, live, surplus, deficit):
        """Pairs of a node's members and probes that the rest of the levels and then the letters leave."""
        member, probe = self.words.vector[low:high].astype(np.int16), probes.vector[live].astype(np.int16)
        more, less = np.tile(surplus, (high - low, 1)), np.tile(deficit, (high - low, 1))
        ok, middle = less <= more, min(LEVELS, depth + FIRST)
        for level in range(depth, middle):
            over = member[:, level, None] - probe[None, :, level]
            more += np.maximum(over, 0)
            less -= np.minimum(over, 0)
            ok &= less <= more
        m, p = np.nonzero(ok & (more <= 1))
        rest = member[m, middle:] - probe[p, middle:]
        spent, before = more[m, p], less[m, p]
        more = spent + np.maximum(rest, 0).sum(1)
        less = before - np.minimum(rest, 0).sum(1)
        # Without an earlier surplus the first difference has to be one.
        first = np.take_along_axis(rest, (rest != 0).argmax(1)[:, None], 1)[:, 0] if rest.shape[1] else np.zeros(len(m))
        on = (more <= 1) & (less <= more) & ((first >= 0) | (spent > 0))
        m, p = m[on] + low, live[p[on]]
        near = _near(probes, p, self.words, m)
        return p[near], m[near]


def letter_groups(vocabulary: DataFrame) -> np.ndarray:
    """Group of each Latin-1 letter: the most frequent ones alone, the others spread evenly."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            text = "".join(batch.column(0).to_pylist()).encode("latin-1")
            total += np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["letter", "n"])

    counted = vocabulary.select("word").mapInArrow(run, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    group, load = np.full(256, LEVELS - 1, np.int64), [0] * LEVELS
    for i, r in enumerate(sorted(counted.collect(), key=lambda r: (-r["n"], r["letter"]))):
        g = i if i < SINGLE else min(range(SINGLE, LEVELS), key=load.__getitem__)
        group[r["letter"]], load[g] = g, load[g] + r["n"]
    return group


def overfull(vocabulary: DataFrame, group: np.ndarray) -> dict[bytes, int]:
    """Prefixes of counts (empty one included) with more than ``SUBTREE`` words, and their number of words."""
    total = vocabulary.count()
    full = {b"": total} if total > SUBTREE else {}
    top = 0
    while top < LEVELS and any(len(p) == top for p in full):
        roots, low = frozenset(p for p in full if len(p) == top), top
        top = min(LEVELS, low + DEPTHS)

        def run(batches, roots=roots, low=low, top=top):
            for batch in batches:
                held: Counter = Counter()
                texts = batch.column(0).to_pylist()
                for v in map(bytes, Words(texts, group).vector) if texts else ():
                    if v[:low] in roots:
                        held[v[:top]] += 1
                # Whole counts of the last level give those above it.
                for v, n in list(held.items()):
                    for d in range(low + 1, top):
                        held[v[:d]] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["prefix", "n"])

        counted = vocabulary.select("word").mapInArrow(run, "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
        full |= {bytes(r["prefix"]): r["n"] for r in counted.filter(F.col("n") > SUBTREE).collect()}
    return full


def _reached(vectors: np.ndarray, full: dict[bytes, int]):
    """(row, prefix of a subtree) that a budget of one surplus and then one deficit reaches from each vector."""
    row = np.arange(len(vectors))
    surplus = np.zeros(len(vectors), bool)
    deficit = np.zeros(len(vectors), bool)
    path = np.zeros((len(vectors), 0), np.uint8)
    depth = 0
    while len(row):
        prefixes = [bytes(x) for x in path] if depth else [b""] * len(row)
        inner = np.fromiter((p in full for p in prefixes), bool, len(prefixes))
        if depth == LEVELS:
            inner[:] = False
        for i in np.flatnonzero(~inner).tolist():
            yield int(row[i]), prefixes[i]
        row, surplus, deficit, path = row[inner], surplus[inner], deficit[inner], path[inner]
        if depth == LEVELS:
            return
        own = vectors[row, depth]
        ways = [(np.ones(len(row), bool), own, surplus, deficit)]
        # A count held at 255 may stand for more, so the next one is the same there.
        ways.append((~surplus & (own < 255), own + np.uint8(1), ~surplus | surplus, deficit))
        ways.append((surplus & ~deficit & (own > 0), own - np.uint8(1), surplus, ~deficit | deficit))
        parts = [(row[on], s[on], t[on], np.column_stack([path[on], count[on]])) for on, count, s, t in ways]
        row, surplus, deficit, path = (np.concatenate(x) for x in zip(*parts, strict=True))
        depth += 1


def _send_task(group: np.ndarray, held):
    """Rows to the subtrees: each word as member of its own and as probe of all it may reach."""

    def parts_of(prefix, full):
        return -(-full[prefix] // SUBTREE) if len(prefix) == LEVELS and prefix in full else 1

    def run(batches):
        full = held.value
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not texts:
                continue
            vectors = Words(texts, group).vector
            keys, probe, out, times = [], [], [], []
            for i, v in enumerate(map(bytes, vectors)):
                d = next((d for d in range(LEVELS) if v[:d] not in full), LEVELS)
                part = zlib.crc32(texts[i].encode()) % parts_of(v[:d], full)
                keys.append(v[:d] + part.to_bytes(4, "big"))
                probe.append(False)
                out.append(texts[i])
                times.append(n[i])
            for i, prefix in _reached(vectors, full):
                for part in range(parts_of(prefix, full)):
                    keys.append(prefix + part.to_bytes(4, "big"))
                    probe.append(True)
                    out.append(texts[i])
                    times.append(n[i])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(probe), pa.array(out, pa.string()), pa.array(times, pa.int64())], ["key", "probe", "word", "n"])

    return run


FOUND = "word string, n_near long, best struct<less:long,word:string>"
BEST = pa.struct([("less", pa.int64()), ("word", pa.string())])


def _search_task(group: np.ndarray):
    """Near words of probes and members; rows come by subtree, members before probes."""

    def batch_of(found):
        words, near, best = zip(*found, strict=True) if found else ((), (), ())
        rows = [{"less": less, "word": word} for less, word in best]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(rows, BEST)], ["word", "n_near", "best"])

    def run(batches):
        key, tree, texts, times = None, None, [], []
        for batch in batches:
            keys, probe = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            word, n = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or probe[i] != probe[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    if tree:
                        yield batch_of(list(tree.members()))
                    key, tree, texts, times = keys[a], None, [], []
                if not probe[a]:
                    texts += word[a:b]
                    times += n[a:b]
                elif texts:  # else a subtree without words
                    tree = tree or Subtree(texts, times, group, len(key) - 4)
                    yield batch_of(list(tree.search(Words(word[a:b], group), np.array(n[a:b], np.int64), word[a:b])))
        if tree:
            yield batch_of(list(tree.members()))

    return run


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) of every word of a (word, n) table; ``best`` is the near word of largest n, the smallest of such."""
    spark = bounded_batches(vocabulary)
    group = letter_groups(vocabulary)
    full = overfull(vocabulary, group)
    held = spark.sparkContext.broadcast(full)
    sent = vocabulary.select("word", "n").mapInArrow(_send_task(group, held), "key binary, probe boolean, word string, n long")
    dealt = sent.repartition(width(spark), "key").sortWithinPartitions("key", "probe")
    found = dealt.mapInArrow(_search_task(group), FOUND)
    own = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less:long,word:string>").alias("best"))
    rows = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best").unionByName(own)
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return rows.select("word", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """Add ``root`` to rows with ``word`` and ``form``: the last word that forms lead to.

    Forms lead upwards only (each is ``times`` as frequent), so pointers that double their reach
    arrive after a few rounds; each round is a written table.
    """
    links, path = stored(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        longer, next_path = stored(longer, "roots")
        forget(longer.sparkSession, path)
        links, path = longer.select("word", "root"), next_path
        if longer.filter("moved").isEmpty():
            break
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, rule=None, times: int = 10, least_letters: int = 7, least_times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root): every word with the near word it is a variant of.

    A form is the most frequent near word, if at least ``times`` as frequent as the word.
    """
    vocabulary, path = stored(words(docs, rule or (lambda _: bytes.decode), least_letters, least_times), "vocabulary")
    near = near_words(vocabulary)
    known = F.col("best_n") >= times * F.col("n")
    forms = near.select("word", "n", "n_near", F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n"))
    forms, _ = stored(forms, "forms")
    forget(docs.sparkSession, path)
    return with_roots(forms)
