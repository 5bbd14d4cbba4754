"""Row ids, slices, shards, shuffles, samples and minibatches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glosswork.functions.arrays import whole_div
from glosswork.functions.draws import HEX_SPAN, draw
from glosswork.plans.spread import (
    BUCKET_ROWS,
    SMALL_ROWS,
    bounded,
    bucket_of,
    numeric_type,
    quantile_bounds,
    rank_in_buckets,
    written,
)

_OFFSET_BITS = 33  # monotonically_increasing_id keeps the partition number above these


def dense_row_id(
    df: DataFrame, order: Sequence[str], name: str = "row_id", rows_per_bucket: int = BUCKET_ROWS
) -> DataFrame:
    """Consecutive ids from 0 in the order of the given columns, which must identify a row; a repeated key is an error.

    No task ever ranks the whole input. A whole-number key that already has no
    gaps is only shifted, without a shuffle. Another numeric key is cut at its
    quantiles. Anything else is range-sorted: only the order columns are sorted
    and written, then the ids are joined back.
    """
    order = list(order)
    if len(order) == 1 and (kind := numeric_type(df, order[0])):
        key = order[0]
        low, high, rows, nulls, distinct = df.agg(
            F.min(key), F.max(key), F.count(F.lit(1)), F.count_if(F.col(key).isNull()), F.count_distinct(key)
        ).first()
        whole = isinstance(df.schema[key].dataType, T.IntegralType)
        if rows == 0:
            return df.withColumn(name, F.lit(0).cast("bigint"))
        if nulls > 1 or distinct + nulls < rows:
            raise ValueError(f"{key} does not identify a row")
        if whole and nulls == 0 and high - low + 1 == rows:
            return df.withColumn(name, F.col(key).cast("bigint") - F.lit(low).cast("bigint"))
        bounds = quantile_bounds(df, key, rows_per_bucket)
        return rank_in_buckets(df, [], bucket_of(F.col(key), bounds, kind), order, name)
    return _range_sorted_id(df, order, name, rows_per_bucket)


def _range_sorted_id(df: DataFrame, order: list[str], name: str, rows_per_bucket: int) -> DataFrame:
    parts = max(1, math.ceil(df.count() / rows_per_bucket))
    at = F.col("_at")
    keys = written(
        df.select(*order)
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "sorted-keys",
    )
    if keys.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count():
        raise ValueError(f"{', '.join(order)} do not identify a row")
    keys = keys.withColumn("_range", F.shiftright(at, _OFFSET_BITS))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keys.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # One row per range, and there are at most `parts` ranges.
    ids = keys.join(F.broadcast(starts), "_range").select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)],
        (F.col("_start") + at.bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))).alias(name),
    )
    if set(df.columns) == set(order):  # nothing else to fetch
        return ids.select(*[F.col(f"_k{order.index(c)}").alias(c) for c in df.columns], name)
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(ids, same).drop(*[f"_k{i}" for i in range(len(order))])


def number_rows(df: DataFrame, order: Sequence[str], name: str, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``dense_row_id`` for tables that are usually small, such as label lists.

    A table proved to have at most ``max_rows`` rows is numbered as a local table.
    """
    small = bounded(df, max_rows)
    if small is None:
        return dense_row_id(df, order, name)
    rank = F.row_number().over(Window.orderBy(*order)) - 1
    return small.withColumn(name, rank.cast("bigint"))


def head_slice(df: DataFrame, size: int | None, row_id: str = "row_id") -> DataFrame:
    """Rows before ``size``; a negative size drops that many rows from the end, None keeps all."""
    if size is None:
        return df
    if size >= 0:
        return df.where(F.col(row_id) < size)
    return df.where(F.col(row_id) < df.count() + size)


def seeded_shuffle(
    df: DataFrame,
    seed: int,
    key: str = "id",
    name: str = "shuffled",
    rows_per_bucket: int = BUCKET_ROWS,
    below: int | None = None,
) -> DataFrame:
    """Add every row's place in a random permutation that depends on seed and key only.

    Draws are spread evenly, so equal slices of their range are equal buckets.
    With ``below`` only the rows at the first places are kept.
    """
    buckets = max(1, math.ceil(df.count() / rows_per_bucket))
    width = math.ceil(HEX_SPAN / buckets)
    drawn = df.withColumn("_draw", draw(seed, F.col(key)))
    bucket = F.floor(F.col("_draw") / width).cast("int")
    return rank_in_buckets(drawn, [], bucket, ["_draw", key], name, below).drop("_draw")


def corpus_shard(
    df: DataFrame, shards: int, shard: int, row_id: str = "row_id", remainder: str = "last", rebase: bool = False
) -> DataFrame:
    """One of ``shards`` contiguous slices of ``count // shards`` rows, by dense id.

    ``remainder='last'`` gives the rows left over to the last slice, ``'drop'``
    leaves them out. ``rebase`` restarts the ids of the slice at 0.
    """
    if remainder not in ("last", "drop"):
        raise ValueError("remainder is 'last' or 'drop'")
    width = df.count() // shards
    first, end = width * shard, width * (shard + 1)
    part = df.where(F.col(row_id) >= first)
    if remainder == "drop" or shard < shards - 1:
        part = part.where(F.col(row_id) < end)
    return part.withColumn(row_id, F.col(row_id) - first) if rebase else part


def sample_n(
    df: DataFrame, n: int, seed: int, key: str = "id", rows_per_bucket: int = BUCKET_ROWS, max_sorted: int = SMALL_ROWS
) -> DataFrame:
    """``n`` random rows without replacement.

    For a small sample only rows with low draws are sorted, the limit being set
    so that twice the rows needed are expected. When those are too few, or the
    sample is large, whole buckets of draws are kept and only the last is ranked.
    """
    if n <= max_sorted:
        limit = math.ceil(HEX_SPAN * min(1.0, (2 * n + 1000) / max(1, df.count())))
        low = df.withColumn("_draw", draw(seed, F.col(key))).where(F.col("_draw") < limit)
        if limit >= HEX_SPAN or low.count() >= n:
            return low.orderBy("_draw", key).limit(n).drop("_draw")
    return seeded_shuffle(df, seed, key, "_place", rows_per_bucket, below=n).drop("_place")


def minibatch(
    df: DataFrame, size: int, columns: Sequence[str], row_id: str = "row_id", drop_last: bool = False
) -> DataFrame:
    """Dict-of-lists batches of ``size`` consecutive rows; no group exceeds ``size``."""
    batch = whole_div(F.col(row_id), size)
    rows = df.select(batch.alias("batch_id"), row_id, *columns)
    if drop_last:
        rows = rows.where(F.col("batch_id") < df.count() // size)
    return rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(row_id, *columns))).alias("_rows")).select(
        "batch_id", F.size("_rows").alias("rows"), *[F.col(f"_rows.{c}").alias(c) for c in [row_id, *columns]]
    )


def gather_trim(df: DataFrame, key: str = "id", place: str | None = None) -> DataFrame:
    """One row per example. With ``place``, the copy that comes first in it is kept."""
    if place is None:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c not in (key, place)]
    first = F.min_by(F.struct(place, *rest), F.col(place)).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*df.columns)


def zip_shortest(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], name: str = "pos"
) -> DataFrame:
    """Row i of one frame beside row i of the other, as many as the shorter has."""
    return dense_row_id(left, left_order, name).join(dense_row_id(right, right_order, name), name)
