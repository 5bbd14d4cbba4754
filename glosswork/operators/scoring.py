"""Predictions, losses, layer gaps and mixtures from model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions.arrays import argmax, log_softmax, one_based, sum_squares
from glosswork.functions.arrays import softmax as softmax_of
from glosswork.operators.tokens import IGNORED
from glosswork.plans.spread import HOT_ROWS, hot_lookup


def predict(df: DataFrame, kind: str = "classification", logits: str = "logits", name: str = "pred") -> DataFrame:
    """Add the class with the largest logit (first on ties), or the single value for regression."""
    if kind == "regression":
        return df.withColumn(name, F.get(F.col(logits), 0))
    return df.withColumn(name, argmax(F.col(logits)))


def softmax(df: DataFrame, logits: str = "logits", name: str = "probs", log: bool = False) -> DataFrame:
    """Add the scores normalised to sum to one, or their logarithms."""
    return df.withColumn(name, (log_softmax if log else softmax_of)(F.col(logits)))


def loss_from_logits(
    df: DataFrame, kind: str = "single", logits: str = "logits", label: str = "label", name: str = "loss"
) -> DataFrame:
    """Add the loss of each row: NULL where the label says to ignore it.

    ``regression`` squares the gap to the one value, ``single`` takes the
    cross-entropy of a class number, ``multi`` the mean binary cross-entropy
    over an array of 0/1 labels.
    """
    x, y = F.col(logits), F.col(label)
    if kind == "regression":
        gap = F.get(x, 0) - y
        return df.withColumn(name, gap * gap)
    if kind == "single":
        return df.withColumn(name, F.when(y != IGNORED, -one_based(log_softmax(x), y)))
    if kind == "multi":
        # max(x, 0) - x*y + log(1 + exp(-|x|)) does not overflow.
        each = F.zip_with(x, y, lambda a, t: F.greatest(a, F.lit(0.0)) - a * t + F.log1p(F.exp(-F.abs(a))))
        return df.withColumn(name, F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.size(x)))
    raise ValueError("kind is 'regression', 'single' or 'multi'")


def mean_loss(df: DataFrame, group: list[str], loss: str = "loss") -> DataFrame:
    """Mean loss per group over the rows that count."""
    return df.groupBy(*group).agg(F.avg(loss).alias(loss))


def cloze_loss(df: DataFrame, group: str = "batch", key: str = "id") -> DataFrame:
    """Cross-entropy at masked positions: mean per example, then mean per batch.

    An example without a masked position has no loss and is left out.
    """
    example = df.groupBy(group, key).agg(F.avg(F.when(F.col("masked"), -F.col("logp"))).alias("loss"))
    return example.groupBy(group).agg(F.avg("loss").alias("loss"), F.count("loss").alias("examples"))


def layer_mse(df: DataFrame, group: str = "layer", a: str = "a", b: str = "b", mask: str | None = None) -> DataFrame:
    """Mean squared gap between two vectors, averaged per layer; ``mask`` keeps only marked rows."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    rows = df.where(F.col(mask)) if mask else df
    each = rows.select(group, F.try_divide(sum_squares(gap), F.size(a)).alias("mse"))
    return each.groupBy(group).agg(F.avg("mse").alias("mse"), F.count("mse").alias("rows"))


def total_layer_mse(layers: DataFrame) -> DataFrame:
    """One number: the mean over layers of ``layer_mse``."""
    return layers.agg(F.avg("mse").alias("mse"))


def example_weights(
    df: DataFrame, batch: str = "batch", key: str = "slot", weight: str = "w", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``share``: the softmax of the weights within each batch."""
    tops = df.groupBy(batch).agg(F.max(weight).alias("_top"), F.count(F.lit(1)).alias("rows"))
    lifted = hot_lookup(df, tops, [batch], [key], hot_rows=hot_rows).withColumn("_e", F.exp(F.col(weight) - F.col("_top")))
    sums = lifted.groupBy(batch).agg(F.sum("_e").alias("_sum"), F.count(F.lit(1)).alias("rows"))
    shared = hot_lookup(lifted, sums, [batch], [key], hot_rows=hot_rows)
    return shared.withColumn("share", F.col("_e") / F.col("_sum")).drop("_e", "_top", "_sum")


def example_reweight(
    df: DataFrame,
    batch: str = "batch",
    key: str = "slot",
    weight: str = "w",
    loss: str = "loss",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Loss of each batch under the softmax of its example weights: ``batch, loss, examples``.

    The weighted sum is the ratio of two sums, so no share is attached to a row;
    only the batch's largest weight is, to keep the exponents small.
    """
    tops = df.groupBy(batch).agg(F.max(weight).alias("_top"), F.count(F.lit(1)).alias("rows"))
    lifted = hot_lookup(df.select(batch, key, weight, loss), tops, [batch], [key], hot_rows=hot_rows)
    e = F.exp(F.col(weight) - F.col("_top"))
    return lifted.groupBy(batch).agg(
        (F.sum(e * F.col(loss)) / F.sum(e)).alias("loss"), F.count(F.lit(1)).alias("examples")
    )


def gated_mixture(experts: DataFrame, gates: DataFrame | None, key: str = "id") -> DataFrame:
    """Expert vectors weighted by the softmax of the gate logits and added up: ``key, mixed``.

    ``experts`` holds ``key, expert, v``, ``gates`` holds ``key, g`` with one logit
    per expert. Without gates the first expert's vector is the result. Vectors are
    scaled whole and each example gathers one vector per expert.
    """
    if gates is None:
        return experts.groupBy(key).agg(F.min_by("v", "expert").alias("mixed"))
    shares = gates.select(key, softmax_of(F.col("g")).alias("_p"))
    scaled = experts.join(shares, key).select(
        key, "expert", F.transform("v", lambda x: x * F.get(F.col("_p"), F.col("expert").cast("int"))).alias("v")
    )
    listed = scaled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("expert", "v")))["v"].alias("vs"))
    start = F.transform(F.get("vs", 0), lambda x: F.lit(0.0))
    return listed.select(
        key, F.aggregate("vs", start, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)).alias("mixed")
    )


def total_loss(
    df: DataFrame, factor: float = 0.5, knowledge: str | None = "knowledge_loss", sample: str | None = "sample_loss"
) -> DataFrame:
    """Add ``total_loss = factor * knowledge + sample``; None switches a part off."""
    first = F.col(knowledge) if knowledge else F.lit(0.0)
    second = F.col(sample) if sample else F.lit(0.0)
    return df.withColumn("total_loss", F.lit(factor) * first + second)
