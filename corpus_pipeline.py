"""A corpus from documents to packed sequences, one stage after the other.

Each stage is one operator of ``glosswork.llm``; its result is written as Parquet and read again as the documents of the
next. All stages but the last return the columns of their documents. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import decontaminate, encoding, language_id, near_dedup, packing, secret_scan
from glosswork.llm.common import table
from glosswork.plans import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and only those; a missing language gets the predicted one.

    Score and mixture reject nothing here: the model decides only what a missing language becomes.
    """
    model = language_id.learn(docs.select("lang", "text"))
    # The text goes to Python once, beside the other columns.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    told = language_id.predict(whole, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    changed = {"lang": F.coalesce(F.col("row.lang"), F.col("lang_pred")), "text": F.col("text")}
    return told.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group linked by five-word shingles at a similarity of 0.8."""
    return near_dedup.without_near_duplicates(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of every secret; ``n_chars`` follows the text."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    masked = secret_scan.redact(whole)
    found = F.size("spans") > 0
    changed = {"text": F.col("text"), "n_chars": F.when(found, F.length("text")).otherwise(F.col("row.n_chars")).cast("bigint")}
    return masked.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, every source at its share: their place, ids and check sum."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = encoding.encoded(docs.select("doc_id", "source", "text"), path, "word", end_id=2)
    named = written(tokens.withColumn("row", F.monotonically_increasing_id()), "ids")
    return packing.pack(named, row="row").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Language models and tokenizers can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
