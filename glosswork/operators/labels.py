"""Few-shot sampling per label and label encoding."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glosswork.functions.arrays import whole_div
from glosswork.functions.draws import HEX_SPAN, draw
from glosswork.operators.ids import number_rows, seeded_shuffle
from glosswork.plans.spread import BUCKET_ROWS, HOT_ROWS, SMALL_ROWS, attach, rank_in_buckets

# Up to this k every task sends its own best k rows of a label to one task, which
# stays small even from 100,000 tasks.
PRUNED_RANK = 128


def kshot(
    df: DataFrame,
    k: int | None,
    seed: int,
    label: str = "label",
    key: str = "id",
    name: str = "shot",
    rows_per_bucket: int = BUCKET_ROWS,
    pruned_rank: int = PRUNED_RANK,
) -> DataFrame:
    """At most ``k`` random rows per label, numbered from 1 in draw order. None keeps all.

    For small ``k`` every task keeps its own best ``k`` per label before the
    shuffle. For a large one each label is cut into buckets of draws, whose
    counts tell which buckets are needed whole.
    """
    if k is None:
        return df
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    if k <= pruned_rank:
        place = F.row_number().over(Window.partitionBy(label).orderBy("_draw", key))
        return drawn.withColumn(name, place.cast("bigint")).where(F.col(name) <= k).drop("_draw")
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    bucket = F.floor(F.col("_draw") / math.ceil(HEX_SPAN / buckets)).cast("int")
    ranked = rank_in_buckets(drawn, [label], bucket, ["_draw", key], name, below=k)
    return ranked.withColumn(name, F.col(name) + 1).drop("_draw")


def scan_end(first_places: DataFrame, patience: int, place: str) -> int | None:
    """Where a scan gives up: ``patience`` rows after the last new label before a longer gap.

    Places are grouped into blocks ``patience`` wide. A gap longer than that can
    only lie between blocks, so each block needs comparing with the next one
    alone, and no task sorts all labels.
    """
    blocks = first_places.groupBy(whole_div(F.col(place), patience).alias("block")).agg(
        F.min(place).alias("low"), F.max(place).alias("high")
    )
    following = blocks.select((F.col("block") - 1).alias("block"), F.col("low").alias("next_low"))
    gap = F.col("next_low").isNull() | (F.col("next_low") - F.col("high") > patience)
    last = blocks.join(following, "block", "left").where(gap).agg(F.min("high")).first()[0]
    return None if last is None else last + patience


def kshot_early_stop(
    df: DataFrame,
    k: int,
    seed: int,
    patience: int = 1000,
    label: str = "label",
    key: str = "id",
    name: str = "shot",
    head_rows: int = SMALL_ROWS,
    rows_per_bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """``kshot`` over a shuffled scan that ends once ``patience`` rows bring no new label.

    Most scans end early, so about ``head_rows`` rows with the lowest draws, which
    are the start of the shuffle, are tried first; only when they hold no such
    gap is the whole input put in order.
    """
    rows = df.count()
    if rows == 0:
        return kshot(df, k, seed, label, key, name)
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    share = min(1.0, head_rows / rows)
    head = drawn.where(F.col("_draw") < math.ceil(HEX_SPAN * share)) if share < 1 else drawn
    placed = head.select(label, "_draw", key).withColumn(
        "_place", F.row_number().over(Window.orderBy("_draw", key)) - 1
    )
    seen = placed.groupBy(label).agg(F.min("_place").alias("_place"))
    end = scan_end(seen, patience, "_place")
    # The row where the scan stops must itself be in the head, or a new label might stand there.
    stop = placed.where(F.col("_place") == end).select("_draw", key).first() if end is not None else None
    if stop is not None:
        before = (F.col("_draw") < stop[0]) | ((F.col("_draw") == stop[0]) & (F.col(key) < stop[1]))
        return kshot(drawn.where(before).drop("_draw"), k, seed, label, key, name)
    if share == 1:
        return kshot(df, k, seed, label, key, name)
    shuffled = seeded_shuffle(df, seed, key, "_place", rows_per_bucket)
    end = scan_end(shuffled.groupBy(label).agg(F.min("_place").alias("_place")), patience, "_place")
    kept = seeded_shuffle(df, seed, key, "_place", rows_per_bucket, below=end)
    return kshot(kept.drop("_place"), k, seed, label, key, name)


def label_index_first_seen(splits: Sequence[DataFrame], label: str = "label", key: str = "id") -> DataFrame:
    """Ids in order of first appearance over all splits in turn: ``label, rows, label_id``. NULL is no label."""
    seen = None
    for number, split in enumerate(splits):
        part = split.select(F.lit(number).alias("split_no"), F.col(key).alias("_key"), F.col(label).alias(label))
        seen = part if seen is None else seen.unionByName(part)
    firsts = (
        seen.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.min(F.struct("split_no", "_key")).alias("first"), F.count(F.lit(1)).alias("rows"))
        .select(label, "rows", F.col("first.split_no").alias("split_no"), F.col("first._key").alias("_key"))
    )
    return number_rows(firsts, ["split_no", "_key"], "label_id").select(label, "rows", "label_id")


def label_index_sorted(df: DataFrame, label: str = "label") -> DataFrame:
    """Ids in sorted order of the distinct labels: ``label, rows, label_id``. NULL is no label."""
    names = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return number_rows(names, [label], "label_id")


def apply_label_index(
    df: DataFrame,
    index: DataFrame,
    label: str = "label",
    key: str = "id",
    unseen: str = "null",
    max_rows: int = SMALL_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``label_id``. A label the index lacks gives NULL, or fails when ``unseen='error'``."""
    mapping = index.select(label, "rows", "label_id")
    mapped = attach(df, mapping, [label], [key], max_rows=max_rows, hot_rows=hot_rows)
    if unseen == "error":
        problem = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))))
        mapped = mapped.withColumn("label_id", F.coalesce(F.col("label_id"), problem.cast("bigint")))
    return mapped


def task_kind(df: DataFrame, task: str | None = None, label: str = "label") -> str:
    """``regression`` for the similarity task or a fractional label column, else ``classification``."""
    if task is not None:
        return "regression" if task == "stsb" else "classification"
    fractional = isinstance(df.schema[label].dataType, (T.FloatType, T.DoubleType))
    return "regression" if fractional else "classification"


def num_labels(df: DataFrame, task: str | None = None, label: str = "label") -> int:
    return 1 if task_kind(df, task, label) == "regression" else df.select(label).distinct().count()


def label_reconcile(model_labels: DataFrame, data_labels: DataFrame) -> DataFrame:
    """Choose between the model's label ids and the data's.

    Both frames hold ``name, idx``. The model's names are lower-cased; its ids
    are used only when both name sets are equal, otherwise the data keeps its
    own and a warning is given. Result: ``name, label_id, from_model``.
    """
    model = model_labels.groupBy(F.lower("name").alias("name")).agg(F.max("idx").alias("model_idx"))
    both = data_labels.join(model, "name", "full")
    differ = not both.where(F.col("idx").isNull() | F.col("model_idx").isNull()).isEmpty()
    if differ:
        warnings.warn("the model's labels are not those of the data; its ids are ignored", stacklevel=2)
        return data_labels.select("name", F.col("idx").alias("label_id"), F.lit(False).alias("from_model"))
    return both.select("name", F.col("model_idx").alias("label_id"), F.lit(True).alias("from_model"))
