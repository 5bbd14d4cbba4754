"""Accuracy, F1, correlations, cloze scores, gate statistics and epoch reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.plans.spread import (
    BUCKET_ROWS,
    HOT_ROWS,
    bucket_of,
    hot_lookup,
    numeric_type,
    quantile_bounds,
    written,
)


def accuracy(df: DataFrame, group: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Share of right predictions; a missing prediction or label is wrong."""
    right = F.coalesce((F.col(pred) == F.col(label)).cast("double"), F.lit(0.0))
    return df.groupBy(*group).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def _class_counts(df: DataFrame, group: Sequence[str], pred: str, label: str) -> DataFrame:
    """``class, tp, fp, fn`` from the confusion table, which is all that is shuffled."""
    cells = df.groupBy(*group, pred, label).agg(F.count(F.lit(1)).alias("_n"))
    same = F.col(pred) == F.col(label)
    zero = F.lit(0)
    n = F.col("_n")
    sides = F.array(
        F.struct(F.col(pred).alias("class"), F.when(same, n).otherwise(zero).alias("tp"), F.when(same, zero).otherwise(n).alias("fp"), zero.cast("bigint").alias("fn")),
        F.struct(F.col(label).alias("class"), zero.cast("bigint").alias("tp"), zero.cast("bigint").alias("fp"), F.when(same, zero).otherwise(n).alias("fn")),
    )
    return (
        cells.select(*group, F.explode(sides).alias("s"))
        .groupBy(*group, F.col("s.class").alias("class"))
        .agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "fp", "fn")])
    )


def macro_f1(
    df: DataFrame,
    num_classes: int,
    absent: str = "exclude",
    group: Sequence[str] = (),
    pred: str = "pred",
    label: str = "label",
) -> DataFrame:
    """Mean of the F1 of every class.

    A class that is neither predicted nor a label is left out of the mean, or
    with ``absent='zero'`` counts as 0.
    """
    if absent not in ("exclude", "zero"):
        raise ValueError("absent is 'exclude' or 'zero'")
    counts = _class_counts(df, group, pred, label)
    f1 = 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    mean = F.avg(f1) if absent == "exclude" else F.sum(f1) / F.lit(float(num_classes))
    return counts.groupBy(*group).agg(mean.alias("macro_f1"))


def _binary_counts(pred: str, label: str) -> dict[str, Column]:
    p, y = F.col(pred) == 1, F.col(label) == 1
    cells = {"tp": p & y, "fp": p & ~y, "fn": ~p & y, "tn": ~p & ~y}
    return {name: F.count_if(cell).cast("double") for name, cell in cells.items()}


def glue_metric(df: DataFrame, task: str, pred: str = "pred", label: str = "label") -> DataFrame:
    """The metrics of a named task as rows ``metric, value``.

    cola: Matthews correlation; mrpc and qqp: accuracy and binary F1; stsb:
    Pearson and Spearman; any other: accuracy.
    """
    if task == "stsb":
        linear = pearson(df, pred, label).select(F.lit("pearson").alias("metric"), F.col("pearson").alias("value"))
        ranked = spearman(df, pred, label).select(F.lit("spearmanr").alias("metric"), F.col("spearman").alias("value"))
        return linear.unionByName(ranked)
    c = _binary_counts(pred, label)
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    right = F.avg((F.col(pred) == F.col(label)).cast("double"))
    if task == "cola":
        scale = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        values = {"matthews_correlation": F.when(scale > 0, (tp * tn - fp * fn) / scale).otherwise(0.0)}
    elif task in ("mrpc", "qqp"):
        values = {"accuracy": right, "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)}
    else:
        values = {"accuracy": right}
    named = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])
    return df.agg(named.alias("m")).select(F.explode("m").alias("m")).select("m.*")


def pearson(df: DataFrame, x: str, y: str, group: Sequence[str] = ()) -> DataFrame:
    """Linear correlation over the rows that have both values; NULL when either side is constant.

    Spark's own ``corr`` divides by zero there and fails in ANSI mode.
    """
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    value = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return df.groupBy(*group).agg(value.alias("pearson"))


def average_ranks(
    df: DataFrame,
    column: str,
    group: Sequence[str],
    name: str,
    rows_per_bucket: int = BUCKET_ROWS,
    weight: str | None = None,
    total: int | None = None,
) -> DataFrame:
    """Rank of every distinct value in its group, ties sharing their mean: ``group, column, rows, name``.

    Equal values are counted before anything is shuffled, so a value that a
    third of the rows share is one row here. The distinct values are cut at
    quantiles, and only buckets of them are ordered. A row of ``df`` counts
    ``weight`` times; ``total`` is the number of rows when it is known.
    """
    group = list(group)
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    values = df.groupBy(*group, column).agg(count.alias("rows"))
    bounds = quantile_bounds(df, column, rows_per_bucket, total)
    values = values.withColumn("_bucket", bucket_of(F.col(column), bounds, numeric_type(df, column)))
    before = Window.partitionBy(*group, "_bucket").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("rows").over(before), F.lit(0))
    if bounds:
        earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = values.groupBy(*group, "_bucket").agg(F.sum("rows").alias("_n"))
        # As one struct, the keys match even where a group column is NULL.
        cell = F.struct(*group, "_bucket").alias("_cell")
        starts = totals.select(cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        values = values.withColumn("_cell", cell).join(starts, "_cell")
        start = start + F.col("_start")
    rank = start + (F.col("rows") + 1) / 2.0
    return values.select(*group, column, "rows", rank.alias(name))


def spearman(
    df: DataFrame,
    x: str,
    y: str,
    group: Sequence[str] = (),
    rows_per_bucket: int = BUCKET_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rank correlation, ties at their average rank; NULL when either side is constant.

    Equal pairs are counted first and weigh as many rows from then on; both
    rankings and the joins read that one table.
    """
    # The group travels as one struct, which is never NULL itself: groups with a
    # NULL in them are kept, and no branch gets a filter of its own that would
    # stop Spark from sharing the pair counts.
    both = df.select(
        F.struct(*([F.col(g) for g in group] or [F.lit(1)])).alias("_g"),
        F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"),
    ).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    total = df.count()
    pairs = both.groupBy("_g", "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    if total > rows_per_bucket:  # the quantiles of both columns would count the pairs again
        pairs = written(pairs, "pairs")
    ranked = pairs
    for column, rank in (("_x", "_rx"), ("_y", "_ry")):
        ranks = average_ranks(pairs, column, ["_g"], rank, rows_per_bucket, "_n", total)
        ranked = hot_lookup(ranked, ranks, ["_g", column], ["_x", "_y"], hot_rows=hot_rows, total=total)
    n = F.sum("_n")
    sums = ranked.groupBy("_g").agg(
        n.alias("n"),
        # Every group's mean rank is (n + 1) / 2, so sums of products are enough.
        F.sum(F.col("_n") * F.col("_rx") * F.col("_ry")).alias("xy"),
        F.sum(F.col("_n") * F.col("_rx") * F.col("_rx")).alias("xx"),
        F.sum(F.col("_n") * F.col("_ry") * F.col("_ry")).alias("yy"),
    )
    mean = (F.col("n") + 1) / 2.0
    shift = F.col("n") * mean * mean
    spread = F.sqrt((F.col("xx") - shift) * (F.col("yy") - shift))
    value = F.when(spread > 0, (F.col("xy") - shift) / spread)
    return sums.select(*[F.col(f"_g.{g}") for g in group], value.alias("spearman"))


def _cloze_examples(df: DataFrame, key: str) -> DataFrame:
    """Per example: are all masked positions right, and the mean log-probability there.

    A right id of 0 is left out of the log-probabilities; a missing prediction is wrong.
    """
    right = ~F.col("masked") | F.coalesce(F.col("pred_id") == F.col("correct_id"), F.lit(False))
    counted = F.when(F.col("masked") & (F.col("correct_id") != 0), F.col("logp"))
    return df.groupBy(key).agg(F.bool_and(right).alias("right"), F.avg(counted).alias("logp"))


def cloze_exact_match(df: DataFrame, key: str = "id") -> DataFrame:
    """Percentage of examples whose masked positions are all right, to two decimals."""
    share = F.avg(F.col("right").cast("double")) * 100
    return _cloze_examples(df, key).agg(F.bround(share, 2).alias("exact_match"))


def cloze_match_score(df: DataFrame, key: str = "id") -> DataFrame:
    """Mean over examples of the rounded ``100 * exp(mean log-probability)``, to two decimals."""
    score = F.bround(F.exp("logp") * 100, 2)
    return _cloze_examples(df, key).agg(F.bround(F.avg(score), 2).alias("match_score"))


def gate_stats(df: DataFrame, group: Sequence[str] = ("split", "epoch"), expert: int = 0) -> DataFrame:
    """Mean and population standard deviation of one expert's weight, layers pooled.

    Rows are ``example, layer, expert, w`` within each group.
    """
    own = df.where(F.col("expert") == expert)
    return own.groupBy(*group).agg(
        F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.count("w").alias("rows")
    )


def epoch_mean(df: DataFrame, group: Sequence[str] = ("run", "epoch", "metric")) -> DataFrame:
    """Unweighted mean of the batch values of each epoch."""
    return df.groupBy(*group).agg(F.avg("value").alias("value"), F.count("value").alias("batches"))


def best_so_far(epochs: DataFrame, floor: float | None = 0.0, series: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Add ``best``: the largest value up to each epoch, starting from ``floor`` (None starts from nothing).

    Expects one row per epoch, so that a window holds no more rows than a run has epochs.
    """
    so_far = F.max("value").over(
        Window.partitionBy(*series).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return epochs.withColumn("best", so_far if floor is None else F.greatest(so_far, F.lit(floor)))


def metric_at_best(
    epochs: DataFrame, valid: str, test: str, series: Sequence[str] = ("run",)
) -> DataFrame:
    """The test metric at the epoch where the validation metric peaked, the earliest one on ties.

    Expects one row per epoch and metric: ``run, epoch, metric, value``. Epochs
    without a validation value cannot be chosen.
    """
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = epochs.where(F.col("metric").isin(valid, test)).groupBy(*series, "epoch").agg(
        pick(valid).alias("valid"), pick(test).alias("test")
    )
    order = F.struct(F.col("valid"), -F.col("epoch"))
    return (
        wide.where(F.col("valid").isNotNull())
        .groupBy(*series)
        .agg(F.max(order).alias("_top"), F.max_by(F.struct("epoch", "test"), order).alias("_at"))
        .select(
            *series,
            F.col("_at.epoch").alias("epoch"),
            F.col("_top.valid").alias("valid"),
            F.col("_at.test").alias("test"),
        )
    )
