"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are taken relative to their mean, scaled to unit length, rotated by one random
orthogonal matrix and stored as sign bits, packed, with two scalars: the length and the
inner product of the unit vector with its own code. From these the inner product with a
rotated query is estimated without bias, with an error that shrinks with the dimension
and is bounded at ``SIGMA`` deviations. A vector is compared exactly only if its estimate
plus bound reaches the query's k-th best exact score so far.

Every vector is indexed. Queries come in blocks of at most about ``BLOCK`` rows, so what
is broadcast is bounded; each task works through its codes, ``CHUNK`` at a time, and
returns k rows per query, which meet by query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do null ids; vectors of different dimension are never compared; a
query's own id is never its neighbour; of repeated query ids the greatest vector asks,
while repeated candidates each count; ties go to the smaller vec_id; fewer than k
candidates are all returned; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vouchlake.llm.common import bounded_batches
from vouchlake.llm.components import stored

BLOCK = 4096
CHUNK = 4096
#: Queries that meet a chunk at a time, so that a product stays in the processor's cache.
ROWS = 256
PAIRS = 4096
FIRST = 4
SIGMA = 3.0
INDEX = "vec_id long, vector array<double>, code binary, length double, fit double"
FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("vector", lambda x: x != 0))


def build_index(rows: DataFrame, dim: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors of one dimension, and their mean."""

    def sums(batches):
        total, n = np.zeros(dim), 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total, n = total + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([n])], ["s", "n"])

    spark = bounded_batches(rows)
    rows = rows.filter(F.size("vector") == dim)
    parts = rows.select("vector").mapInArrow(sums, "s array<double>, n long")
    total = parts.select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()
    mean = np.array([r["s"] / r["n"] for r in total])
    turn = spark.sparkContext.broadcast(rotation(dim, seed))

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim) - mean
            length = np.linalg.norm(x, axis=1)
            unit = x / np.where(length > 0, length, 1)[:, None] @ turn.value.T
            bits = unit > 0
            own = np.where(bits, unit, -unit).sum(axis=1) / np.sqrt(dim)
            code = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(np.where(length > 0, own, 1.0))], ["vec_id", "vector", "code", "length", "fit"])

    return rows.mapInArrow(encode, INDEX), mean


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of the given pairs, summed component by component in order."""
    out = np.zeros(len(qi))
    for d in range(q.shape[1]):
        out += q[qi, d] * x[xi, d]
    return out


class Best:
    """The k best (vec_id, score) of each query so far; ``bar`` is the k-th score, or minus infinity."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bar = np.full(n, -np.inf)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        counts = np.bincount(self.query, minlength=self.n)
        full = counts >= self.k
        self.bar[full] = self.score[(np.cumsum(counts) - 1)[full]]


def _search_task(shared, dim: int, k: int):
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        ids, q, mean, turn = shared.value
        n = len(ids)
        # Rotated queries, then the factors of a code's offset and error bound: one product gives estimate plus bound.
        left = np.c_[q @ turn.T, q @ mean, np.linalg.norm(q, axis=1)].astype(np.float32)
        q_single = q.astype(np.float32)
        by_id = np.argsort(ids)
        best = Best(n, k)

        def compare(rows: np.ndarray, xi: np.ndarray, vec: np.ndarray, x: np.ndarray, x_single: np.ndarray, room: np.ndarray) -> None:
            low = best.bar.astype(np.float32) - room
            # A fast product sifts, in pieces that stay in cache; what may reach the bar is summed in order.
            near = []
            for piece in range(0, len(rows), PAIRS):
                r, c = rows[piece : piece + PAIRS], xi[piece : piece + PAIRS]
                near.append(np.einsum("ij,ij->i", q_single[r], x_single[c]) >= low[r])
            near = np.concatenate(near) if near else np.zeros(0, bool)
            rows, xi = rows[near], xi[near]
            score = _exact(q, x, rows, xi)
            good = score >= best.bar[rows]
            best.add(rows[good], vec[xi[good]], score[good])

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                vec = part.column(0).to_numpy(zero_copy_only=False)
                x = _matrix(part.column(1), dim)
                packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vec), -1)
                length, fit = (part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
                estimate = np.c_[signs * (length / (fit * np.sqrt(dim)))[:, None], np.ones(len(vec))]
                # The last term is room for the single precision of the product.
                slack = length * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * SIGMA / np.sqrt(max(dim - 1, 1)) + 1e-5 * (length + np.linalg.norm(mean))
                x_single = x.astype(np.float32)
                room = (1e-5 * left[:, -1] * np.linalg.norm(x, axis=1).max()).astype(np.float32)
                right = np.ascontiguousarray(np.c_[estimate, slack].T.astype(np.float32))
                # Where a query meets itself.
                found = np.minimum(np.searchsorted(ids, vec, sorter=by_id), n - 1)
                self_row = np.where(ids[by_id[found]] == vec, by_id[found], -1)
                for top in range(0, n, ROWS):
                    rows = np.arange(top, min(n, top + ROWS))
                    reach = left[rows] @ right
                    own = np.flatnonzero((self_row >= top) & (self_row < top + ROWS))
                    reach[self_row[own] - top, own] = -np.inf
                    if not np.isfinite(best.bar[rows]).all():
                        # A first bar: exact scores of those that reach highest, some times k.
                        first = np.argpartition(-reach, min(FIRST * k, len(vec)) - 1, axis=1)[:, : FIRST * k]
                        r, c = np.repeat(np.arange(len(rows)), first.shape[1]), first.ravel()
                        real = np.isfinite(reach[r, c])
                        compare(rows[r[real]], c[real], vec, x, x_single, room)
                        reach[r, c] = -np.inf
                    r, c = np.nonzero(reach >= best.bar[rows].astype(np.float32)[:, None])
                    real = np.isfinite(reach[r, c])
                    compare(rows[r[real]], c[real], vec, x, x_single, room)
        for at in range(0, len(best.query), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query[part]]), pa.array(best.vec[part]), pa.array(best.score[part])], names)

    return run


def search(vectors: DataFrame, asked, k: int = 20, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` that the condition ``asked`` selects."""
    spark = bounded_batches(vectors)
    rows = usable(vectors)
    found = None
    for (dim,) in rows.select(F.size("vector")).distinct().collect():
        coded, mean = build_index(rows, dim, seed)
        index, _ = stored(coded, "codes")
        queries = index.filter(asked).groupBy("vec_id").agg(F.max("vector").alias("vector"))
        blocks = max(1, -(-queries.count() // BLOCK))
        numbered = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        for block in range(blocks):
            part = numbered.filter(F.col("block") == block).select("vec_id", "vector").collect()
            if not part:
                continue
            block_of = (np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part]), mean, rotation(dim, seed))
            near = index.mapInArrow(_search_task(spark.sparkContext.broadcast(block_of), dim, k), FOUND)
            found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
