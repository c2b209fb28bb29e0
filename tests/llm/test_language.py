"""Held-out accuracy, rejection and rows that cannot be judged."""

import random

import numpy as np
from pyspark.sql import functions as F

from vouchlake.llm import language

SCHEMA = "doc_id long, text string, lang string, score double"
SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "tra tre kri kro klu".split(), "cc": "éna ôno ünu äni ñen".split()}


def texts(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 120))]
        yield i, " ".join(words).title(), lang, None


def test_accuracy(spark):
    train = spark.createDataFrame(list(texts(300, 1)), SCHEMA)
    model = language.fit(train)
    rows = list(texts(200, 2)) + [(900, None, "aa", 1.0), (901, "12 34 !?", None, 1.0), (902, "", "bb", None), (None, "Tra kri", None, None), (5, "ba be bi", "aa", 0.0), (5, "ba be bi", "aa", 0.0)]
    out = language.identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r for r in out}
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows[:200] if i != 5) >= 195
    assert all(got[i].lang_pred == "und" and not got[i].accepted and got[i].score == 0 for i in (900, 901, 902))
    assert sum(got[i].accepted for i, *_ in rows[:200]) >= 195
    assert got[None].lang_pred == "bb" and got[5].lang_pred == "aa"


def test_segments(monkeypatch):
    grams = language.Grams()
    text = "Été à la plage, ΣΟΦΟΣ 123 weather " * 40
    want, _ = grams.counts(text)
    monkeypatch.setattr(language, "SEGMENT", 50)
    got, _ = language.Grams().counts(text)
    assert (got == want).all()


def test_many_repeats_are_counted():
    counts, _ = language.Grams().counts("ab " * 300_000)
    assert counts.sum() == 6 * 300_000 and counts.max() >= 300_000  # three bigrams, two trigrams, one of four


def test_unknown_languages_are_rejected(spark):
    """Texts of no learned language, and each language left out of the fit in turn."""
    model = language.fit(spark.createDataFrame(list(texts(300, 1)), SCHEMA))
    foreign = ["Hyvää huomenta kaikille, tänään sataa vettä koko päivän", "Dzień dobry wszystkim, dzisiaj będzie padał deszcz przez cały dzień", "今天全天都会下雨请大家记得带伞出门"]
    assert not any(model.predict(t * 3)[2] for t in foreign)
    for left in SYLLABLES:
        train = [r for r in texts(300, 3) if r[2] != left]
        model = language.fit(spark.createDataFrame(train, SCHEMA))
        strange = [t for _, t, lang, _ in texts(120, 4) if lang == left and len(t) > 60]
        known = [t for _, t, lang, _ in texts(120, 4) if lang != left]
        assert sum(model.predict(t)[2] for t in strange) <= len(strange) // 20 and sum(model.predict(t)[2] for t in known) >= len(known) * 0.97


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None, None)], SCHEMA)
    model = language.fit(language.learnable(docs, F.lit(True)))
    assert language.identify(docs, model).first().lang_pred == "und"
    assert language.identify(docs.limit(0), model).count() == 0
    assert np.isfinite(language.fit(spark.createDataFrame([(1, "ab", "aa", None)], SCHEMA)).bound)
