"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by a filter's
width less one, so every run of bytes lies whole in a chunk. Bytes are embedded, filters
of ``WIDTH`` bytes slide over them, a rectified maximum pools each filter per chunk, and a
logistic layer combines the mean, maximum and minimum over all chunks into one probability.
Embedding, filters and layer are learned by mini-batch gradient descent (Adam); the
gradient of a maximum goes to the bytes at its place. For scoring, embedding and filters
fold into tables over byte pairs.

Learning takes at most ``ROWS`` labelled rows, drawn by a hash of the id, with every chunk of
each; a mini-batch works its chunks off ``GROUP`` at a time. Scoring covers whole texts.

Defined cases: null and empty texts have no chunk and get the layer's bias; a label or id
that is null, or a label whose document is missing, is not learned from; conflicting or
repeated labels each count; with nothing to learn from every score is 0.5; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vouchlake.llm.common import Shared, bounded_batches

ROWS = 3000
CHUNK = 512
WIDTH = 6
FILTERS = 32
DIM = 8
EPOCHS = 6
BATCH = 32
#: Chunks of a mini-batch whose filters are held at once.
GROUP = 256
RATE = 0.01
#: Bytes of one document that are scored together.
SEGMENT = 1 << 18


class Network:
    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.standard_normal((256, DIM)).astype(np.float32) * 0.5,
            "filters": rng.standard_normal((WIDTH, DIM, FILTERS)).astype(np.float32) * 0.3,
            "shift": np.zeros(FILTERS, np.float32),
            "out": (rng.standard_normal(3 * FILTERS) * 0.1).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        self.pairs = None

    def tables(self) -> list[np.ndarray]:
        """One table per two filter positions: the contribution of each pair of bytes."""
        one = np.einsum("bd,wdf->wbf", self.p["embed"], self.p["filters"])
        return [np.ascontiguousarray((one[w][:, None, :] + one[w + 1][None, :, :]).reshape(65536, FILTERS)) for w in range(0, WIDTH, 2)]

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Rectified maxima of each filter per chunk; ``data`` holds at least one whole filter width."""
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        n = len(data) - WIDTH + 1
        sums = self.pairs[0][pair[:n]]
        for k in range(1, len(self.pairs)):
            sums += self.pairs[k][pair[2 * k : 2 * k + n]]
        heads = np.arange(0, n, CHUNK - WIDTH + 1)
        return np.maximum(np.maximum.reduceat(sums, heads, axis=0) + self.p["shift"], 0)

    def score(self, text: bytes) -> float:
        """Probability of label 1 of a whole text."""
        if self.pairs is None:
            self.pairs = self.tables()
        total, most, least, chunks = np.zeros(FILTERS), np.zeros(FILTERS), np.full(FILTERS, np.inf), 0
        if text:
            data = np.frombuffer(text, np.uint8)
            if len(data) < WIDTH:
                data = np.r_[data, np.zeros(WIDTH - len(data), np.uint8)]
            step = SEGMENT // (CHUNK - WIDTH + 1) * (CHUNK - WIDTH + 1)
            for at in range(0, len(data) - WIDTH + 1, step):
                part = self.pooled(data[at : at + step + WIDTH - 1])
                total, most, least, chunks = total + part.sum(axis=0), np.maximum(most, part.max(axis=0)), np.minimum(least, part.min(axis=0)), chunks + len(part)
        z = np.r_[total / max(chunks, 1), most, least if chunks else most] @ self.p["out"] + self.p["bias"][0]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def learn(self, docs: list[tuple[int, list[np.ndarray]]], seed: int) -> None:
        """Mini-batches of (label, chunks)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                grad = self._gradient([docs[k] for k in order[at : at + BATCH]])
                step += 1
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
        self.pairs = None

    def _maxima(self, one, data, sizes):
        """Place and value of each filter's maximum in each chunk."""
        n = CHUNK - WIDTH + 1
        sums = one[0][data[:, :n]]
        for w in range(1, WIDTH):
            sums += one[w][data[:, w : w + n]]
        sums[np.arange(n)[None, :] > np.maximum(sizes - WIDTH, 0)[:, None]] = -np.inf
        place = sums.argmax(axis=1)
        return place, np.take_along_axis(sums, place[:, None, :], axis=1)[:, 0] + self.p["shift"]

    def _gradient(self, docs) -> dict[str, np.ndarray]:
        chunks = [c for _, cs in docs for c in cs]
        owner = np.repeat(np.arange(len(docs)), [len(cs) for _, cs in docs])
        data = np.zeros((len(chunks), CHUNK), np.uint8)
        sizes = np.array([len(c) for c in chunks], np.int64)
        for k, c in enumerate(chunks):
            data[k, : len(c)] = c
        one = np.einsum("bd,wdf->wbf", self.p["embed"], self.p["filters"])
        place, top = (np.concatenate(x) for x in zip(*(self._maxima(one, data[a : a + GROUP], sizes[a : a + GROUP]) for a in range(0, max(len(data), 1), GROUP)), strict=True))
        pooled = np.maximum(top, 0)
        count = np.maximum(np.bincount(owner, minlength=len(docs)), 1)
        mean = np.zeros((len(docs), FILTERS), pooled.dtype)
        np.add.at(mean, owner, pooled)
        mean /= count[:, None]
        most = np.zeros((len(docs), FILTERS), pooled.dtype)
        np.maximum.at(most, owner, pooled)
        least = np.full((len(docs), FILTERS), np.inf, pooled.dtype)
        np.minimum.at(least, owner, pooled)
        least[np.isinf(least)] = 0
        whole = np.concatenate([mean, most, least], axis=1)
        chance = 1 / (1 + np.exp(-np.clip(whole @ self.p["out"] + self.p["bias"][0], -40, 40)))
        error = ((chance - np.array([y for y, _ in docs])) / len(docs)).astype(np.float32)
        grad = {"out": whole.T @ error, "bias": np.array([error.sum()], np.float32)}
        to_pool = error[owner, None] * (self.p["out"][:FILTERS] / count[owner, None] + self.p["out"][FILTERS : 2 * FILTERS] * (pooled == most[owner]) + self.p["out"][2 * FILTERS :] * (pooled == least[owner]))
        to_pool = (to_pool * (top > 0)).astype(pooled.dtype)
        grad["shift"] = to_pool.sum(axis=0)
        grad["embed"], grad["filters"] = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["filters"])
        rows = np.arange(len(chunks))[:, None]
        for w in range(WIDTH):
            letters = data[rows, np.minimum(place + w, CHUNK - 1)]
            grad["filters"][w] = np.einsum("kfd,kf->df", self.p["embed"][letters], to_pool)
            np.add.at(grad["embed"], letters.ravel(), (to_pool[:, :, None] * self.p["filters"][w].T[None]).reshape(-1, DIM))
        return grad


def _chunks(text: bytes) -> list[bytes]:
    return [text[h : h + CHUNK] for h in range(0, max(len(text) - WIDTH + 1, 1), CHUNK - WIDTH + 1)] if text else []


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, seed: int = 3) -> Network:
    """Fit on documents (doc_id, text) and labels (doc_id, quality); at most about ``rows`` are drawn."""
    bounded_batches(docs)
    draw = F.xxhash64(F.lit(seed), "doc_id")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    share = min(1.0, rows / max(known.count(), 1))
    drawn = known.withColumn("o", draw).filter(F.col("o") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True)).orderBy("o", "quality").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``rows`` ids and labels: a bounded side.
    met = texts.join(F.broadcast(drawn), "doc_id").select("quality", "o", "text")

    def run(batches):
        for batch in batches:
            out = [_chunks((t or "").encode()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], ["quality", "o", "chunks"])

    sample = met.mapInArrow(run, "quality int, o long, chunks array<binary>").orderBy("o", "quality", "chunks").limit(rows).collect()
    network = Network(seed)
    if not sample:
        network.p["out"][:] = 0
        return network
    network.learn([(r["quality"], [np.frombuffer(bytes(c), np.uint8) for c in r["chunks"]]) for r in sample], seed)
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score) of each document: the probability of label 1."""
    shared = Shared(bounded_batches(docs), network)

    def run(batches):
        network = shared.load()
        for batch in batches:
            out = [network.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
