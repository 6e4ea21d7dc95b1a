"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again.  All but the last return
the columns of ``documents``.  ``run`` applies them to the table.

ORACLE_SQL is None: language identification and near-duplicates by a learned
model and byte-pair merging have no SQL form; tests compare with a plain version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import byte_bpe, language_id, minhash, mixing, suffix_dedup
from trailmark.llm.components import ensure_checkpoint_dir
from trailmark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in which no language can be told (null, or without a letter); fills in missing language codes."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = language_id.fit(docs, ~held_out)
    found = language_id.identify(docs, model, carry=others, keep_text=True).filter(F.col("lang_pred") != "und")
    kept = found.select("doc_id", "text", *[F.coalesce("rest.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"rest.{c}").alias(c) for c in others])
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    dropped = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that an earlier document holds; texts left without a word go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = suffix_dedup.remove_repeated_bytes(docs, width=50, carry=others, whole_characters=True)
    text = F.col("kept").cast("string")
    kept = cut.select("doc_id", text.alias("text"), *[F.col(f"rest.{c}").alias(c) for c in others], F.length(text).cast("long").alias("n_chars"))
    return kept.filter(F.col("text").rlike(mixing.WORD)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks for."""
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    mixed = mixing.emit(mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, cap=2.0, carry=others))
    return mixed.select(*[F.col(f"rest.{c}").alias(c) if c in others else F.col(c) for c in docs.columns])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    both = byte_bpe.encode(docs, tokenizer_path(), carry=["lang", "source"], decoded=True)
    return both.select(
        "doc_id",
        F.col("rest.lang").alias("lang"),
        F.col("rest.source").alias("source"),
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; their results go to the folder that the cluster shares."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        folder = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
