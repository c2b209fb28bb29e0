"""SimHash near-dedup with generalised pigeonhole search.

Fingerprint: A-Z lower-cased, words split at white space, every shingle of ``shingle``
words (repeats included) hashed by XXH64 with seed 42; a bit is set if it is set in over
half the hashes. Two fingerprints link if they differ in at most ``distance`` bits;
documents are grouped by linked fingerprints, over any number of steps.

Search runs over distinct fingerprints, so thousands of copies are one row. Bits that
agree together go into the same part of a division of the 64 bits; for each division the
candidates that a part admits at each threshold are estimated from exact counts over all
fingerprints, and dynamic programming gives the parts unequal thresholds t_i >= -1 with
sum(t_i) = distance - parts + 1, which by the pigeonhole principle loses no link. A part
with threshold t is probed by every key that leaves t of its bits out. Fingerprints of one
key are verified against each other inside a task and leave it as a forest, never as
pairs. A key with more than ``MOST`` fingerprints is divided again over its free bits
(four blocks of which one must agree), until at most 2**12 = ``MOST`` can share it: no
bucket is ever unbounded or cut.

Defined cases: null and empty texts have no shingles and fingerprint zero, linked like any
other; fewer words than a shingle give one shingle of them all; a null doc_id is grouped
but never names a group unless all its members are null; equal rows each give a row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vouchlake.llm.common import bounded_batches, width
from vouchlake.llm.components import components, stored

BITS = 64
#: Fingerprints compared in one bucket; 2**FREE, so a bucket with FREE free bits always fits.
FREE = 12
MOST = 1 << FREE
#: Cost of sending one key, in verified candidates.
KEY_COST = 200.0
BLOCK = 50_000


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    flat = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(flat, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, ends[:-1] + 1][:n].tolist()
    last = ends[shingle - 1 :].tolist()
    digest, set_bits = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        raw = b"".join([digest(flat[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])])
        set_bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tag, fp) of each document: XXH64 of the text and the fingerprint, signed longs."""
    bounded_batches(docs)

    def run(batches):
        for batch in batches:
            out = [_signed(fingerprint(t.as_buffer().to_pybytes(), shingle)) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], ["doc_id", "tag", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    return rows.mapInArrow(run, "doc_id long, tag long, fp long")


def _bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set (2,080 sums)."""

    def run(batches):
        gram, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype("<i8")
            for at in range(0, len(raw), BLOCK):
                bits = np.unpackbits(raw[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                gram += (bits.T @ bits).astype(np.int64)
            n += len(raw)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1]), pa.array(np.r_[j, -1]), pa.array(np.r_[gram[i, j], n])], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    gram, total = np.zeros((BITS, BITS)), 0
    for i, j, n in rows:
        if i < 0:
            total = n
        else:
            gram[i, j] = gram[j, i] = n
    return total, gram


def divide(gram: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, correlated bits together."""
    p = np.diag(gram) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(gram / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tied, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(left, key=lambda b: (tied[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def allocate(cost: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost; ``cost[i][t + 1]`` is that of part i at threshold t (-1: unused)."""
    need = distance - len(cost) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for sum_so_far, (c, chosen) in best.items():
            for t in range(-1, distance + 1):
                key, value = sum_so_far + t, c + row[t + 1]
                if key not in step or value < step[key][0]:
                    step[key] = (value, [*chosen, t])
        best = step
    return best[need]


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def plan_keys(fps: DataFrame, distance: int) -> list[int]:
    """Masks whose equality finds every link: the cheapest division and thresholds."""
    total, gram = _bit_pairs(fps)
    p = np.diag(gram) / max(total, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    options = [divide(gram, total, m) for m in range(2, distance + 2)] if distance else [[list(range(BITS))]]
    parts = [(m, i, bits) for m, groups in enumerate(options) for i, bits in enumerate(groups)]
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v")) for n, (_, _, bits) in enumerate(parts)])).alias("k")
    seen = fps.select(keys).groupBy("k.n", "k.v").agg(F.count("*").alias("c"))
    pairs = dict(seen.groupBy("n").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).collect())
    best = None
    for m, groups in enumerate(options):
        cost = []
        for n, (which, _, bits) in enumerate(parts):
            if which != m:
                continue
            row, poly, count = [0.0], np.ones(1), 1.0
            for b in bits:
                poly = np.convolve(poly, [1.0, odds[b]])
            for t in range(distance + 1):
                count = float(np.prod([(len(bits) - s) / (s + 1) for s in range(t)]))
                row.append(pairs.get(n, 0.0) * poly[: t + 1].sum() + KEY_COST * total * count)
            cost.append(row)
        value, chosen = allocate(cost, distance)
        if best is None or value < best[0]:
            best = (value, groups, chosen)
    _, groups, chosen = best
    return [_mask(set(bits) - set(out)) for bits, t in zip(groups, chosen) if t >= 0 for out in combinations(bits, t)]


def _forest(fp: np.ndarray, run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints of equal run number, reduced to one link per joined member."""
    n = len(fp)
    label = np.arange(n)
    held_a, held_b, held = [], [], 0

    def join():
        nonlocal label, held_a, held_b, held
        a, b = np.concatenate(held_a), np.concatenate(held_b)
        held_a, held_b, held = [], [], 0
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                higher = label[label]
                if (higher == label).all():
                    break
                label = higher

    here, step = np.arange(n), 1
    while True:
        here = here[: np.searchsorted(here, n - step)]
        here = here[run[here] == run[here + step]]
        if not len(here):
            break
        near = here[np.bitwise_count(fp[here] ^ fp[here + step]) <= distance]
        if len(near):
            held_a.append(near)
            held_b.append(near + step)
            held += len(near)
            if held > 1 << 20:
                join()
        step += 1
    if held:
        join()
    joined = np.flatnonzero(label != np.arange(n))
    return label[joined], joined


def _verify_task(distance: int, most: int):
    """Rows (mask, value, fp) sorted by key: links (0, a, b) and members of overfull keys (1, fp, mask)."""
    names = ["kind", "a", "b"]

    def emit(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names)

    def work(mask, value, fp):
        new = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run]
        over = size > most
        if over.any():
            yield emit(1, fp[over], mask[over])
        keep = ~over & (size > 1)
        if keep.any():
            a, b = _forest(fp[keep].view(np.uint64), run[keep], distance)
            if len(a):
                yield emit(0, fp[keep][a], fp[keep][b])

    def run_task(batches):
        held, full = [], None
        for batch in batches:
            mask, value, fp = (np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
            if full is not None:
                same = (mask == full[0]) & (value == full[1])
                if same.any():
                    yield emit(1, fp[same], mask[same])
                    mask, value, fp = mask[~same], value[~same], fp[~same]
                if not len(fp):
                    continue
                full = None
            held.append((mask, value, fp))
            if sum(len(x[0]) for x in held) < 1 << 16:
                continue
            mask, value, fp = (np.concatenate(x) for x in zip(*held))
            # The last key may go on in the next batch: keep it, or pass it on if it is overfull.
            tail = int(np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])[-1])
            if tail:
                yield from work(mask[:tail], value[:tail], fp[:tail])
            held = [(mask[tail:], value[tail:], fp[tail:])]
            if len(fp) - tail > most:
                full = (mask[tail], value[tail])
                yield emit(1, fp[tail:], mask[tail:])
                held = []
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held)))

    return run_task


def _divide_again(mask: int, distance: int) -> list[int]:
    free = [b for b in range(BITS) if not mask >> b & 1]
    blocks = [free[k :: distance + 1] for k in range(distance + 1)]
    return [_signed(mask | sum(1 << b for b in block)) for block in blocks if block]


def links(fps: DataFrame, distance: int = 3, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all within ``distance`` bits.

    ``fps`` has one row per fingerprint, column ``fp``. The result joins the same groups
    as all links do, with fewer rows.
    """
    spark = bounded_batches(fps)
    masks = plan_keys(fps, distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    found = None
    while True:
        dealt = keyed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
        dealt = dealt.repartitionById(width(spark), F.pmod(F.xxhash64("mask", "value"), F.lit(width(spark))).cast("int")).sortWithinPartitions("mask", "value")
        level, _ = stored(dealt.mapInArrow(_verify_task(distance, most), "kind int, a long, b long"), "candidates")
        near = level.filter("kind = 0").select("a", "b")
        found = near if found is None else found.unionByName(near)
        over = level.filter("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("mask"))
        shared = [r[0] for r in over.select("mask").distinct().collect()]
        if not shared:
            return found
        # Masks are few (they do not depend on the number of rows), so each maps to its finer ones as an expression.
        finer = F.create_map(*[x for m in shared for x in (F.lit(m), F.array(*[F.lit(s) for s in _divide_again(m % (1 << 64), distance)]))])
        keyed = over.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()


def near_groups(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, tag, fp, component, component_id) of each document.

    ``component_id`` is the group's least doc_id, ``component`` its least fingerprint and
    ``tag`` XXH64 of the text, which tells rows of one doc_id apart.
    """
    marks, _ = stored(fingerprints(docs, shingle), "fingerprints")
    fps, _ = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    grouped = components(links(fps.select("fp"), distance))
    named = fps.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marks.join(named.select("fp", "component").join(ids, "component"), "fp").select("doc_id", "tag", "fp", "component", "component_id")


def hex_mark(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each near-duplicate group, with its columns as they are.

    The least doc_id stays (null ids last); where it repeats, the row with the least tag,
    and of rows equal in both, one.
    """
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("y"), F.col("tag").alias("z"))
    columns = docs.columns
    chosen = near_groups(docs, shingle, distance).groupBy("component").agg(F.min(order).alias("o"))
    chosen = chosen.select(F.col("o.y").alias("kept_id"), F.col("o.z").alias("kept_tag"))
    # The row travels packed, so that no name of it meets one made here.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("tag"))
    kept = packed.join(chosen, packed["id"].eqNullSafe(chosen["kept_id"]) & (packed["tag"] == chosen["kept_tag"]), "left_semi")
    return kept.dropDuplicates(["id", "tag"]).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
