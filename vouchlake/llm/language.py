"""Language identification by averaged hashed subword embeddings and a linear softmax.

Letters are lower-cased, everything else is a space. Character n-grams of 2 to 4 that hold
no inner space are hashed into ``BUCKETS`` buckets; a document is the mean of its n-grams'
embeddings, over the whole text, worked off in segments. Embeddings and softmax are fitted
by stochastic gradient descent on the driver, on the n-gram counts of a bounded sample: at
most ``ROWS`` labelled rows, drawn by a hash of the row, each as a whole and as
``SNIPPETS`` short pieces, so that short texts are met in training. One row in five stays out of the fit; on
these the softmax temperature is set, and two bounds under which a document is rejected. One is
its confidence: the ``REJECT`` quantile of those labelled texts' own confidences, ``EVEN`` at most.
The softmax has to choose among the learned languages, so the other asks whether the text is written as the
chosen one is: the mean log-probability of its n-grams in that language, in standard deviations
for as many different n-grams, may be ``STRANGE`` times as low as that of any held-out text.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected;
with nothing to learn from every row is; null, repeated and equal rows each give a row; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vouchlake.llm.common import Shared, bounded_batches

ROWS = 2000
SNIPPETS = 3
BUCKETS = 8192
DIM = 16
EPOCHS = 6
RATE = 4.0
#: Share of the held-out labelled texts that may fall under the rejection bound.
REJECT = 0.001
#: A language with at least this calibrated chance is never rejected.
EVEN = 0.5
#: How much less usual than the least usual held-out text a document may be.
STRANGE = 2.0
SEGMENT = 1 << 20


class Grams:
    """n-gram bucket counts of a text; the table of letters is made once per process."""

    def __init__(self):
        self.letters = None

    def counts(self, text: str) -> tuple[np.ndarray, bool]:
        if self.letters is None:
            self.letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        total, lettered = np.zeros(BUCKETS, np.int64), False
        text = f" {text.lower()} "
        # Segments overlap by three characters; an n-gram belongs to the segment it begins in.
        for at in range(0, len(text), SEGMENT):
            codes = np.frombuffer(text[at : at + SEGMENT + 3].encode("utf-32-le", "replace"), np.uint32)
            solid = self.letters[codes]
            lettered = lettered or bool(solid.any())
            codes = np.where(solid, codes, np.uint32(32))
            mixed, keep = codes * np.uint32(0x9E3779B1), None
            for n in (2, 3, 4):
                if len(codes) < n:
                    break
                m = len(codes) - n + 1
                mixed = (mixed[:m] ^ (mixed[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0xC2B2AE35)
                if n == 2:
                    keep = solid[:m] | solid[1:]
                    inner = np.ones(m, bool)
                else:
                    inner = inner[:m] & solid[n - 2 : n - 2 + m]
                    keep = inner
                here = (mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)
                total += np.bincount(here[:SEGMENT][keep[:SEGMENT]], minlength=BUCKETS)
        return total, lettered


class Model:
    def __init__(self, labels: list[str], embed: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.labels, self.embed, self.out, self.bias = labels, embed, out, bias
        self.heat, self.bound = 1.0, 0.0
        #: Log-probability of each bucket in each language, its mean and deviation, and the least that is usual.
        self.usual = np.zeros((len(labels), BUCKETS), np.float32)
        self.mean, self.spread, self.least = np.zeros(len(labels)), np.ones(len(labels)), -np.inf
        self.grams = Grams()

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (counts @ self.embed / max(counts.sum(), 1)) @ self.out + self.bias

    def learn_usual(self, counts: np.ndarray) -> None:
        """Bucket counts of each language's texts, as (languages, buckets)."""
        chance = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.usual = np.log(chance).astype(np.float32)
        self.mean = (chance * self.usual).sum(axis=1)
        self.spread = np.sqrt((chance * (self.usual - self.mean[:, None]) ** 2).sum(axis=1))

    def usualness(self, counts: np.ndarray, language: int) -> float:
        """Deviations from a language's mean log-probability; repeated n-grams count as one the more they prevail."""
        total = counts.sum()
        different = total * total / max(float((counts.astype(np.float64) ** 2).sum()), 1.0)
        return float((counts @ self.usual[language] / total - self.mean[language]) / self.spread[language] * np.sqrt(different))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its chance and whether both bounds are met."""
        counts, lettered = self.grams.counts(text) if text else (None, False)
        if not lettered or not self.labels:
            return "und", 0.0, False
        chance = _softmax(self.logits(counts) / self.heat)
        best = int(chance.argmax())
        return self.labels[best], float(chance[best]), bool(chance[best] >= self.bound and self.usualness(counts, best) >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sample(labelled: DataFrame, rows: int, seed: int) -> list:
    """(label, part, order, buckets, counts) of drawn rows; texts stay on the executors."""
    draw = F.xxhash64(F.lit(seed), "doc_id", "lang")
    known = labelled.filter(F.col("lang").isNotNull())
    # The draw needs ids and labels only; a margin covers rows without letters.
    share = min(1.0, 1.05 * rows / max(known.select("doc_id").count(), 1))
    drawn = known.withColumn("o", draw).filter(F.col("o") <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))

    def run(batches):
        grams = Grams()
        for batch in batches:
            out = []
            for label, order, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not text:
                    continue
                rng = np.random.default_rng(order % (1 << 32))
                pieces = [text]
                for _ in range(SNIPPETS):
                    size = int(rng.integers(10, 200))
                    at = int(rng.integers(0, max(1, len(text) - size)))
                    pieces.append(text[at : at + size])
                for part, piece in enumerate(pieces):
                    counts, lettered = grams.counts(piece)
                    if lettered:
                        at = np.flatnonzero(counts)
                        out.append((label, part, order, at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes()))
            if out:
                types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["label", "part", "o", "at", "n"])

    found = drawn.select("lang", "o", "text").mapInArrow(run, "label string, part int, o long, at binary, n binary")
    return found.orderBy("o", "label", "part", "at", "n").limit(rows * (1 + SNIPPETS)).collect()


def fit(labelled: DataFrame, rows: int = ROWS, seed: int = 5) -> Model:
    """Fit on (doc_id, text, lang); at most ``rows`` rows are used."""
    bounded_batches(labelled)
    sample = [(r["label"], r["part"], r["o"], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32).astype(np.float32)) for r in _sample(labelled, rows, seed)]
    labels = sorted({r[0] for r in sample})
    rng = np.random.default_rng(seed)
    embed = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    model = Model(labels, embed, np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32))
    if not labels:
        return model
    number = {x: k for k, x in enumerate(labels)}
    fold = [abs(r[2]) // 7 % 5 == 0 for r in sample]
    inner = [r for r, out in zip(sample, fold) if not out] or sample
    steps, done = EPOCHS * len(inner), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(inner)):
            label, _, _, at, n = inner[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            weight = n / n.sum()
            mean = weight @ embed[at]
            error = _softmax(mean @ model.out + model.bias)
            error[number[label]] -= 1
            back = model.out @ error
            model.out -= rate * np.outer(mean, error)
            model.bias -= np.float32(0.05) * rate * error
            embed[at] -= rate * np.outer(weight, back)
    judged = [r for r, out in zip(sample, fold) if out] or inner
    scores, truth = [], np.array([number[r[0]] for r in judged])
    for r in judged:
        counts = np.zeros(BUCKETS, np.float32)
        counts[r[3]] = r[4]
        scores.append(model.logits(counts))
    scores = np.array(scores)
    loss = lambda t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.heat = float(min(np.geomspace(0.25, 8, 41), key=loss))
    whole = np.array([r[1] == 0 for r in judged])
    sure = _softmax(scores / model.heat).max(axis=1)
    usual = np.zeros((len(labels), BUCKETS))
    for label, _, _, at, n in inner:
        usual[number[label], at] += n
    model.learn_usual(usual)
    seen = []
    for k, r in enumerate(judged):
        if int(scores[k].argmax()) == truth[k]:
            counts = np.zeros(BUCKETS, np.float32)
            counts[r[3]] = r[4]
            seen.append(model.usualness(counts, int(truth[k])))
    model.least = STRANGE * min(seen, default=-np.inf) if min(seen, default=-1.0) < 0 else -np.inf
    model.bound = min(EVEN, float(np.quantile(sure[whole] if whole.any() else sure, REJECT, method="lower")))
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the ``keep`` columns and the text) with lang_pred, score and accepted."""
    spark = bounded_batches(docs)
    shared = Shared(spark, model)
    rows = docs.select(*(keep or ["doc_id"]), F.col("text").cast("string").alias("_text"))

    def run(batches):
        model = shared.load()
        for batch in batches:
            out = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            names, scores, sure = zip(*out) if out else ((), (), ())
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "lang_pred", "score", "accepted"])

    schema = rows.drop("_text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("accepted")).schema
    return rows.mapInArrow(run, schema)


def learnable(docs: DataFrame, fold: Column) -> DataFrame:
    """Rows that may be learned from: labelled, outside the held-out fold."""
    return docs.filter(fold & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
