"""A stored retrieval record that follows its corpus: only new and changed texts are encoded again.

The record is a row of deltas. A delta holds ``raw_id, digest, embedding`` of the texts that were encoded for it and, with
a null vector, a tombstone for each text that has gone. A manifest for each version names the deltas it is made of and
counts what changed; it is written last, so a run that fails leaves at most a delta that no manifest names, and readers
of an older version are never disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators.retrieval import embed_corpus
from glosswork.plans.spread import bounded, written

MANIFEST = "version bigint, place int, delta string, new bigint, changed bigint, gone bigint, rows bigint"
DELTAS = 16  # deltas of a version after which a refresh writes them as one


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each version and delta: ``version, place, delta``, and ``new, changed, gone, rows`` of the version."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _deltas(spark: SparkSession, path: str, version: int | None) -> tuple[int, list[str]]:
    """The version, the last one by default, and its deltas; version 0 has none."""
    known = manifests(spark, path)
    if version is None:
        version = known.agg(F.max("version")).first()[0] or 0
    rows = known.where(F.col("version") == version).orderBy("place").collect()  # at most DELTAS and one
    if version and not rows:
        raise ValueError(f"no version {version}")
    return version, [r.delta for r in rows]


def _stored(spark: SparkSession, path: str, deltas: list[str], columns: tuple[str, ...]) -> DataFrame:
    """The last row of every id, tombstones left out."""
    if not deltas:
        return spark.createDataFrame([], "raw_id bigint, digest binary, embedding array<double>").select(*columns)
    every = None
    for place, delta in enumerate(deltas):
        part = spark.read.parquet(f"{path}/deltas/{delta}").select(*columns, F.col("embedding").isNotNull().alias("_here"), F.lit(place).alias("_place"))
        every = part if every is None else every.unionByName(part)
    if len(deltas) > 1:
        last = F.max_by(F.struct(*[c for c in (*columns, "_here") if c != "raw_id"]), "_place").alias("_last")
        every = every.groupBy("raw_id").agg(last).select("raw_id", "_last.*")
    return every.where("_here").select(*columns)


def read_record(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``raw_id, embedding`` of a version, the last one by default."""
    return _stored(spark, path, _deltas(spark, path, version)[1], ("raw_id", "embedding"))


def change_set(documents: DataFrame, spark: SparkSession, path: str, key: str = "raw_id", text: str = "text") -> DataFrame:
    """``raw_id, digest, change`` of every text that is ``new``, ``changed`` or ``gone`` against the last version."""
    _, deltas = _deltas(spark, path, None)
    return _changes(documents, _stored(spark, path, deltas, ("raw_id", "digest")), key, text)


def _changes(documents: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    now = documents.select(F.col(key).cast("bigint").alias("raw_id"), digest.alias("digest"))
    was = stored.select(F.col("raw_id").alias("_id"), F.col("digest").alias("_digest"))
    both = now.join(was, F.col("raw_id") == F.col("_id"), "full")
    change = F.when(F.col("_id").isNull(), "new").when(F.col("raw_id").isNull(), "gone").when(F.col("digest") != F.col("_digest"), "changed")
    return both.select(F.coalesce("raw_id", "_id").alias("raw_id"), "digest", change.alias("change")).where(F.col("change").isNotNull())


def refresh_record(
    documents: DataFrame,
    path: str,
    encoder: Callable[[pd.Series], np.ndarray] | None = None,
    dims: int = 64,
    key: str = "raw_id",
    text: str = "text",
) -> int:
    """Bring the record up to the documents and give its version.

    Ids must identify documents. Texts are compared by digest, so what meets in the join is ids and digests alone; only
    texts to be encoded are read again. Without a change there is no new version. A null text is an empty one.
    """
    spark = documents.sparkSession
    version, deltas = _deltas(spark, path, None)
    changes = written(_changes(documents, _stored(spark, path, deltas, ("raw_id", "digest")), key, text), "changes")
    if changes.groupBy("raw_id").count().where("count > 1").limit(1).count():
        raise ValueError(f"{key} does not identify a document")
    counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    if not counts and version:
        return version
    wanted = changes.where(F.col("change") != "gone").select("raw_id", "digest")
    small = bounded(wanted)
    named = documents.select(F.col(key).cast("bigint").alias("raw_id"), F.coalesce(text, F.lit("")).alias("text"))
    asked = named.join(wanted if small is None else F.broadcast(small), "raw_id")
    vectors = embed_corpus(asked.select("raw_id", "text"), encoder, dims)
    encoded = vectors.join(wanted if small is None else F.broadcast(small), "raw_id")
    tombs = changes.where(F.col("change") == "gone").select("raw_id", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("array<double>").alias("embedding"))
    name = f"{version + 1:012d}-{uuid.uuid4().hex}"
    encoded.select("raw_id", "digest", "embedding").unionByName(tombs).write.parquet(f"{path}/deltas/{name}")
    deltas = [*deltas, name]
    if len(deltas) > DELTAS:
        merged = f"{version + 1:012d}-{uuid.uuid4().hex}"
        _stored(spark, path, deltas, ("raw_id", "digest", "embedding")).write.parquet(f"{path}/deltas/{merged}")
        deltas = [merged]
    rows = _stored(spark, path, deltas, ("raw_id", "digest")).count()
    numbers = (counts.get("new", 0), counts.get("changed", 0), counts.get("gone", 0), rows)
    listed = [(version + 1, place, delta, *numbers) for place, delta in enumerate(deltas)]
    # Two refreshes at once: the second fails here, as the folder exists.
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifests/{version + 1:012d}")
    return version + 1
