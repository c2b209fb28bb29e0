"""Each stage against a brute-force version of its decision, and the whole run."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from test_secrets import brute as brute_spans
from test_simhash import groups, mark

SF = "/root/testdata/sf0.001"


def rows_of(docs):
    return {r.doc_id: r for r in docs.collect()}


def contaminated(text, items):
    from vouchlake.llm.decontaminate import words_of

    words = words_of((text or "").encode())
    hit = set()
    for terms in items:
        n = min(13, len(terms))
        windows = {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()
        for j in range(len(words) - n + 1):
            if tuple(words[j : j + n]) in windows:
                hit |= set(range(j, j + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages(spark, tmp_path):
    from vouchlake.llm.decontaminate import words_of

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append((name, rows_of(docs), rows_of(out), docs.columns, out.columns))
        docs = out
    for name, _, _, before, after in seen[:-1]:
        assert before == after, name
    _, before, kept, *_ = seen[0]
    assert len(kept) >= 0.98 * sum(r.lang is not None for r in before.values()) and set(kept) <= set(before)
    _, before, kept, *_ = seen[1]
    ids = sorted(before)
    first = groups([mark(before[i].text) for i in ids])
    assert sorted(kept) == [i for k, i in enumerate(ids) if first[k] == k] and all(kept[i] == before[i] for i in kept)
    _, before, kept, *_ = seen[2]
    items = [words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(kept) == sorted(i for i, r in before.items() if not contaminated(r.text, items))
    _, before, kept, *_ = seen[3]
    for i, r in before.items():
        text, at, out = r.text or "", 0, ""
        for a, _, b in brute_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert kept[i].text == out + text[at:]
    _, before, kept, *_ = seen[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in before.items():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert kept[i].n_tokens == len(want) and kept[i].text == (r.text or "")
        assert hashlib.sha256(kept[i].ids).digest() == hashlib.sha256(b"".join(t.to_bytes(4, "little") for t in want)).digest()


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "12 34", None, "s", 5, 3), (3, "some words here", "en", None, 15, 4), (3, "some words here", "en", None, 15, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text int")
    for _, stage in pipeline.STAGES:
        stage(spark, docs, SF).collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
