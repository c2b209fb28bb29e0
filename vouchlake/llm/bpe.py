"""Byte-level BPE encoding by a prefix-sharing trie traversal, and decoding.

A vocabulary file of the tokenizers library (byte-level BPE) gives merges and ids; its
path is a parameter. Texts are cut at the file's added tokens and then into words by the
byte-level pattern. The distinct words of a batch are sorted, which lays out their trie:
walking them in order is its depth-first traversal, and a word keeps the path of the
prefix it shares with the one before. Each node of the path holds the last token of the
encoding of its prefix. A new node needs one search: the token that ends there and may
follow the last token of the prefix before it; two tokens may follow each other if
merging their bytes would give the same two, which their merge history tells. There is
exactly one, so encodings of shared prefixes are computed once and a word's tokens are
read by walking back from its end.

Defined cases: a null or empty text has no tokens; rows with null, repeated or equal
columns each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers.pre_tokenizers import ByteLevel

from vouchlake.llm.common import bounded_batches

#: The byte-level pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points outside blocks whose letter and number classes have long been settled.
RARE = re.compile("[^\x00-\u0557\u1e00-\u1fff\u2000-\u206f\u20a0-\u20bf\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f64f]")
#: Words and token pairs in a generation of a worker's memory.
REMEMBER = 150_000
#: Letters of the texts whose words share one walk.
TOGETHER = 1_500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(extra)
        extra += b not in plain
    return out


class Vocabulary:
    """Merges of a vocabulary file. Ranks: single bytes first, then merges in order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = pre and pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"] and not spec["normalizer"]
        if model["type"] != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a byte-level BPE vocabulary without a prefix space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or stand alone are not supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.vocab = model["vocab"]
        self.ready = False

    def spelled(self) -> dict[int, bytes]:
        """The bytes of every token id, added tokens as they are written."""
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        return {i: b"".join(back[c] for c in n) for n, i in self.vocab.items() if n not in self.added} | {i: c.encode() for c, i in self.added.items()}

    def prepare(self) -> "Vocabulary":
        """Tables of this process; a worker builds them once."""
        if self.ready:
            return self
        letters = byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        names = list(letters)
        rank = {c: b for b, c in enumerate(letters)}
        self.left, self.right = list(range(256)), list(range(256))
        self.merged = {}
        for a, b in self.merges:
            if a + b not in rank:
                rank[a + b] = len(names)
                names.append(a + b)
                self.left.append(rank[a])
                self.right.append(rank[b])
            self.merged.setdefault((rank[a], rank[b]), rank[a + b])
        self.id_of = np.array([self.vocab.get(n, 0) for n in names], np.uint32)
        raw = [b"".join(back[c] for c in n) for n in names]
        self.rank_of = {r: k for k, r in enumerate(raw)}
        self.size_of = list(map(len, raw))
        # Two generations each: what is still in use moves to the younger, the older one goes.
        self.pairs, self.older_pairs = {}, {}
        self.words, self.older = {}, {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.ready, self.merges, self.vocab = True, None, None
        return self

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b would end as these two tokens.

        Undo both tokens' merges, latest first: where the two parts that meet could have
        merged before the next undone step, they would have.
        """
        key = a << 32 | b
        known = self.pairs.get(key, self.older_pairs.get(key))
        if known is not None:
            self.pairs[key] = known
            return known
        left, right, merged = self.left, self.right, self.merged
        limit, ok = len(left) + 1, True
        while True:
            met = merged.get((a, b))
            if met is not None and met < limit:
                ok = False
                break
            if a > b and a > 255:
                limit, a = a, right[a]
            elif b > 255:
                # On equal ranks the left merge comes first, hence the one more.
                limit, b = b + 1, left[b]
            elif a > 255:
                limit, a = a, right[a]
            else:
                break
        if len(self.pairs) > REMEMBER:
            self.older_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = ok
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode distinct words by one walk of their trie."""
        ordered = sorted((w.encode(), w) for w in words)
        rank_of, size_of, pairs, follows, ids = self.rank_of.get, self.size_of, self.pairs, self.follows, self.id_of
        # path[n]: last token of the first n bytes; long[n]: its bytes.
        path, long, before = [-1], [0], b""
        for word, name in ordered:
            depth, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                depth = most
            else:
                while word[depth] == before[depth]:
                    depth += 1
            del path[depth + 1 :], long[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                # Most often the last token grows by the new byte.
                size = long[-1] + 1
                token = rank_of(word[end - size : end])
                if token is not None:
                    prefix = path[end - size]
                    if prefix >= 0:
                        fits = pairs.get(prefix << 32 | token)
                        if fits is None:
                            fits = follows(prefix, token)
                    if prefix < 0 or fits:
                        path.append(token)
                        long.append(size)
                        continue
                for size in range(1, end + 1):
                    token = rank_of(word[end - size : end])
                    if token is None:
                        continue
                    prefix = path[end - size]
                    if prefix < 0:
                        break
                    fits = pairs.get(prefix << 32 | token)
                    if fits is None:
                        fits = follows(prefix, token)
                    if fits:
                        break
                path.append(token)
                long.append(size)
            out, at = [], len(word)
            while at:
                token = path[at]
                out.append(token)
                at -= size_of[token]
            out.reverse()
            self.words[name] = ids[out].tobytes()
            before = word

    def split(self, text: str) -> list[str]:
        """Words of a text. Unicode versions differ on rare letters; there the library's own rule decides."""
        if text.isascii() or not RARE.search(text):
            return self.pattern.findall(text)
        back = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(map(back.__getitem__, piece)).decode() for piece, _ in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for text in texts:
            pieces = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
            # Odd pieces are added tokens; a tuple is never a word.
            cut.append([x for k, piece in enumerate(pieces) for x in ([(piece,)] if k % 2 else self.split(piece))] if len(pieces) > 1 else self.split(text))
        if len(self.words) > REMEMBER:
            self.older, self.words = self.words, {}
        self.words.update({(c,): np.uint32(i).tobytes() for c, i in self.added.items()})
        unknown = set().union(*cut).difference(self.words)
        known = unknown.intersection(self.older)
        self.words.update((w, self.older[w]) for w in known)
        self.learn(list(unknown - known))
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]


def decode_ids(spelled: dict[int, bytes], ids: bytes) -> bytes:
    """UTF-8 bytes of the text of packed ids; what is no UTF-8 becomes U+FFFD."""
    raw = b"".join(map(spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of each document: token ids packed as little-endian unsigned 32-bit integers.

    With ``decoded`` a third column holds the text that the ids decode to, as ``decode``
    gives it, without another pass through Python.
    """
    vocabulary = Vocabulary(path)
    shared = bounded_batches(docs).sparkContext.broadcast((vocabulary, vocabulary.spelled() if decoded else None))

    def run(batches):
        vocabulary, spelled = shared.value
        vocabulary.prepare()
        for batch in batches:
            ids = vocabulary.encode([t or "" for t in batch.column(1).to_pylist()])
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([decode_ids(spelled, x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    out = docs.select("doc_id", F.lit(b"").alias("ids"), *([F.lit("").alias("decoded")] if decoded else [])).schema
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text of packed ids, special tokens included."""
    shared = bounded_batches(encoded).sparkContext.broadcast(Vocabulary(path).spelled())

    def run(batches):
        for batch in batches:
            out = [decode_ids(shared.value, ids.as_buffer().to_pybytes()) if ids.is_valid else b"" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("")).schema)
