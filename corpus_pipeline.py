"""The documents' way through five operators, from raw rows to token ids.

1. language ID: fitted on the stage's own labelled rows; rejected documents go;
2. SimHash near-dedup: of each group of near copies the least doc_id stays;
3. benchmark decontamination: documents with at least one word in twenty under benchmark
   windows go, all others stay whole;
4. secret scan: spans are replaced by a mark, every document stays;
5. BPE encoding and decoding: token ids and the text they decode to.

Every stage works on all its predecessor kept and is written as Parquet before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vouchlake.llm import bpe, decontaminate, language, secrets, simhash
from vouchlake.session import forget, released, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(language.learnable(docs, F.lit(True)))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text")
    kept = language.identify(packed, model, ["_row"]).filter("accepted")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(docs, path, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", decontaminate_documents),
    ("secret_scans", redact_secrets),
    ("bpe_encoding", encode_tokens),
]

#: No SQL: a trained model and a tokenizer decide rows; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        # What a stage stores on its way goes once its result is written.
        with released(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            forget(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
