"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import draw, join_words, softmax, tokens, whole_div, words

BATCH_ROWS = 100
CLASSES = 10
GATE_LAYERS = (7, 11)
OUT_DIMS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micro(value: Column) -> Column:
    """Millionths as a whole number, which every engine prints alike."""
    return F.round(value * 1_000_000).cast("bigint")


def listed(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), " ")


def listed_micro(values: Column) -> Column:
    return listed(F.transform(values, micro))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def knowledge(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's words with the third and seventh turned into slots."""
    cut = texts(spark, folder).select("id", words(F.col("text")).alias("w"), *keep)
    slotted = F.transform("w", lambda x, i: F.when(i == 2, "{}").when(i == 6, "{},").otherwise(x))
    return cut.select(
        "id",
        F.concat(join_words(slotted), F.lit(".")).alias("prompt"),
        F.concat(F.slice("w", 3, 1), F.slice("w", 7, 1)).alias("targets"),
        *keep,
    )


def knowledge_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The same, every fifth prompt being plain text without targets."""
    cut = texts(spark, folder).select("id", words(F.col("text")).alias("w"))
    plain = (F.col("id") % 5 == 0) | (F.size("w") < 7)
    slotted = F.transform("w", lambda x, i: F.when(i == 2, "{}").when(i == 6, "{},").otherwise(x))
    return cut.select(
        "id",
        F.concat(join_words(F.when(plain, F.col("w")).otherwise(slotted)), F.lit(".")).alias("prompt"),
        F.when(plain, F.array().cast("array<string>"))
        .otherwise(F.concat(F.slice("w", 3, 1), F.slice("w", 7, 1)))
        .alias("targets"),
    )


def task(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    named = F.when(F.col("quality") == 1, "good").otherwise("bad")
    return (
        texts(spark, folder).join(labels, F.col("id") == F.col("doc_id")).select("id", "text", named.alias("label"))
    )


def languages(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("id", "text", F.col("lang").alias("label"))


def sources_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("id", "text", F.concat_ws("_", "lang", "source").alias("label"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation beside the next."""
    turns = table(spark, folder, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    label = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return turns.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.col("text").alias("sentence1"),
        "sentence2",
        label.cast("bigint").alias("label"),
    )


def choices(spark: SparkSession, folder: str) -> DataFrame:
    """Items whose choices are the texts of five items in turn."""
    items = table(spark, folder, "benchmark")
    count = items.count()
    wanted = items.select("item_id", "text", F.posexplode(F.sequence(F.lit(0), F.lit(4))).alias("i", "_")).select(
        "item_id", "text", "i", ((F.col("item_id") + F.col("i")) % count).alias("other")
    )
    other = items.select(F.col("item_id").alias("other"), F.col("text").alias("choice"))
    lists = wanted.join(other, "other").groupBy("item_id", "text").agg(
        F.array_sort(F.collect_list(F.struct("i", "choice")))["choice"].alias("choices")
    )
    return lists.select(
        F.col("item_id").alias("id"),
        F.col("text").alias("question"),
        F.struct(F.col("choices").alias("text")).alias("choices"),
        F.char(65 + F.col("item_id") % 5).alias("answerKey"),
    )


def choice_scores(spark: SparkSession, folder: str) -> DataFrame:
    each = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("choice")
    )
    return each.withColumn("score", draw(7, F.col("id"), F.col("choice")) % 1000)


def token_lists(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select(
        "id", tokens(F.col("text")).alias("toks"), whole_div(F.col("id"), BATCH_ROWS).alias("bk")
    )


def vectors(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias(key), F.col("embedding").cast("array<double>").alias("embedding")
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every document."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("raw_id"), "text")


def document_vectors(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """A vector for every document: the stored ones in turn, an eighth longer each time round."""
    stored = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    count = stored.count()
    turns = table(spark, folder, "documents").select(
        F.col("doc_id").alias(key), (F.col("doc_id") % count).alias("vec_id"), whole_div(F.col("doc_id"), count).alias("turn")
    )
    scaled = F.transform("v", lambda x: x * (1 + F.col("turn") / 8))
    return turns.join(stored, "vec_id").select(key, scaled.alias("embedding"))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("valid").alias("split"),
        (F.col("vec_id") % 3).alias("epoch"),
        whole_div(F.col("vec_id"), 8).alias("batch"),
        F.slice(F.col("embedding").cast("array<double>"), 1, CLASSES).alias("logits"),
        "label",
    )


def experts(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    three = F.array(F.slice(e, 1, 16), F.slice(e, 17, 16), F.slice(e, 33, 16))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.posexplode(three).alias("expert", "v")
    )


def gate_logits(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.slice(e, 49, 3).alias("g"))


def gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gate weights of two layers in long form."""
    e = F.col("embedding").cast("array<double>")
    layers = F.array(
        F.struct(F.lit(GATE_LAYERS[0]).alias("layer"), softmax(F.slice(e, 49, 3)).alias("p")),
        F.struct(F.lit(GATE_LAYERS[1]).alias("layer"), softmax(F.slice(e, 52, 3)).alias("p")),
    )
    by_layer = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 5 == 0, "test").otherwise("valid").alias("split"),
        (F.col("vec_id") % 3).alias("epoch"),
        F.explode(layers).alias("l"),
    )
    return by_layer.select("id", "split", "epoch", "l.layer", F.posexplode("l.p").alias("expert", "w"))


def layer_pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") % 2).alias("layer"),
        F.slice(e, 1, 32).alias("a"),
        F.slice(e, 33, 32).alias("b"),
    )


def cloze(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as positions of a cloze example."""
    right = F.col("l_suppkey") % 20
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        whole_div(F.col("l_orderkey"), 10).alias("batch"),
        (F.col("l_linenumber") % 2 == 1).alias("masked"),
        right.alias("correct_id"),
        F.when(F.col("l_quantity") > 40, right + 1).otherwise(right).alias("pred_id"),
        (-(F.col("l_tax") + 0.01)).alias("logp"),
    )


def weights(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        whole_div(F.col("l_orderkey"), 10).alias("batch"),
        F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("slot"),
        F.col("l_discount").alias("w"),
        F.col("l_tax").alias("loss"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"),
        "value",
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run name for every part."""
    key = F.col("p_partkey")
    data = F.get(F.array(*[F.lit(n) for n in ("csqa", "mrpc", "sst2", "amazon", "cola", "hyper")]), (key % 6).cast("int"))
    kind = F.get(F.array(*[F.lit(n) for n in ("finetune", "houlsby", "pfeiffer-domain", "lora-domain")]), (key % 4).cast("int"))
    name = F.concat_ws("_", data, kind, F.col("p_size").cast("string"), F.lit("1e-4"), F.concat(F.lit("seed"), key.cast("string")))
    return table(spark, folder, "part").select(name.alias("run_name"), (key % 3).alias("shots"))


def hash_weights(rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """A reproducible weight matrix and bias: small numbers from md5."""

    def number(*parts: int) -> float:
        text = ":".join(str(p) for p in parts)
        return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 2001 - 1000) / 4000.0

    weight = np.array([[number(11, i, j) for j in range(columns)] for i in range(rows)])
    return weight, np.array([number(12, j) for j in range(columns)])
