"""Encoding against the tokenizers library; decoding as an exact round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from vouchlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPELLED = bpe.Vocabulary(PATH).spelled()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH).prepare()


def same(vocabulary, library, texts):
    for text, ids in zip(texts, vocabulary.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert bpe.decode_ids(SPELLED, ids).decode() == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(vocabulary, library, texts):
    same(vocabulary, library, texts)


def test_hard_texts(vocabulary, library):
    rng = random.Random(1)
    pieces = ["<|endoftext|>", "<|", " ", "   ", "\n", "'s", "'ll", "the", "tion", "é", "՘", "\U0001f600", "1234", "!?", "\x1c", "\x85", "　"]
    same(vocabulary, library, ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(500)])
    same(vocabulary, library, ["a" * 3000, "ab" * 2000, "-" * 500, "=" * 129, " " * 400 + "x", "the" * 700])


def test_worker_forgets(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    same(vocabulary, library, ["one two three four five", "six seven eight"])
    same(vocabulary, library, ["one two nine"])


def test_rows(spark):
    rows = [(1, "A text <|endoftext|> here", "x"), (2, None, "y"), (None, "", None), (1, "A text <|endoftext|> here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in out) == sorted((str(a), b or "") for a, b, _ in rows)
    assert sorted(map(str, bpe.encode(docs, PATH, decoded=True).collect())) == sorted(map(str, out))
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
