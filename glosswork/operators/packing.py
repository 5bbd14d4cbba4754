"""Packing sequences into blocks and grouping them by length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from glosswork.functions.arrays import pad_to, whole_div
from glosswork.plans.spread import BUCKET_ROWS, rank_in_groups, sum_in_groups

BLOCK_ROWS = 20_000  # rows with their token lists that one task should order


def pack_blocks(
    df: DataFrame,
    length: int,
    batch: str = "batch",
    key: str = "id",
    items: str = "input_ids",
    rows_per_bucket: int = BLOCK_ROWS,
) -> DataFrame:
    """Join the lists of each batch in key order and cut them into blocks of ``length``.

    The remainder of a batch is dropped, unless the whole batch is shorter than
    a block; then it is kept as one short block. ``batch`` is the map batch (row
    id div 1000 in the usual setting): each one drops its own remainder.

    Lists travel as slices, one per block they reach into, never as single
    elements. Only running sizes need the order of a batch, and every block
    gathers at most ``length`` elements. A batch of many rows is summed in slices
    of its keys, the sums of earlier slices being added.
    """
    sized = df.select(
        F.col(batch).alias("batch"),
        F.col(key).alias("_key"),
        F.col(items).alias("_items"),
        F.size(items).cast("bigint").alias("_n"),
    )
    placed = sum_in_groups(sized, ["batch"], "_key", "_n", "_start", rows_per_bucket)
    first, last = F.col("_start"), F.col("_start") + F.col("_n") - 1
    blocks = F.sequence(whole_div(first, length), whole_div(last, length))
    cut_from = F.greatest(F.col("block") * length - first, F.lit(0))
    cut_to = F.least((F.col("block") + 1) * length - first, F.col("_n"))
    pieces = placed.where(F.col("_n") > 0).withColumn("block", F.explode_outer(blocks)).select(
        "batch",
        "block",
        "_start",
        F.slice("_items", (cut_from + 1).cast("int"), (cut_to - cut_from).cast("int")).alias("_piece"),
    )
    packed = pieces.groupBy("batch", "block").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("_start", "_piece")))["_piece"]).alias(items)
    )
    return packed.where((F.size(items) == length) | (F.col("block") == 0))


STARTS = T.ArrayType(
    T.StructType([T.StructField("n_items", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("begin", "first", "batch_rows", "batches_before")]])
)


def _batch_starts(budget: int) -> Callable[[Column], Column]:
    """Where batches begin among the distinct lengths of a group, given longest first.

    A batch takes ``max(1, budget // width)`` rows, width being its first and
    longest row, so stepping through the distinct lengths is enough. Each step
    notes where the length begins, where the first batch of that length opens,
    how many rows its batches take and how many batches came before.
    """

    @F.arrow_udf(STARTS)
    def starts(histograms: pa.Array) -> pa.Array:
        out = []
        for lengths in histograms.to_pylist():
            end = opened = batches = 0
            notes = []
            for length in lengths:
                begin, end = end, end + length["rows"]
                size = max(1, budget // length["n_items"])
                first = max(opened, begin)
                more = -(-(end - first) // size) if first < end else 0
                notes.append((length["n_items"], begin, first, size, batches))
                opened, batches = first + more * size, batches + more
            out.append([dict(zip(("n_items", "begin", "first", "batch_rows", "batches_before"), n)) for n in notes])
        kind = pa.struct([("n_items", pa.int32()), *[(n, pa.int64()) for n in ("begin", "first", "batch_rows", "batches_before")]])
        return pa.array(out, pa.list_(kind))

    return starts


def _sized(df: DataFrame, items: str) -> DataFrame:
    if isinstance(df.schema[items].dataType, T.IntegralType):
        return df.withColumn("n_items", F.coalesce(F.col(items).cast("int"), F.lit(0)))
    # Empty rows find no start later. Filtering them here would make Spark
    # compute a derived array column a second time, inside the filter.
    return df.withColumn("n_items", F.coalesce(F.size(items), F.lit(0)))


def _starts(sized: DataFrame, group: str, budget: int) -> DataFrame:
    histogram = sized.groupBy(group, "n_items").agg(F.count(F.lit(1)).alias("rows"))
    lengths = F.sort_array(F.collect_list(F.when(F.col("n_items") > 0, F.struct("n_items", "rows"))), asc=False)
    listed = histogram.groupBy(group).agg(lengths.alias("_lengths"))
    return listed.select(group, F.explode(_batch_starts(budget)(F.col("_lengths"))).alias("s")).select(group, "s.*")


def length_batches(
    df: DataFrame,
    budget: int,
    group: str = "bk",
    key: str = "id",
    items: str = "input_ids",
    rows_per_bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """Cut each collation group into batches of similar length within a token budget.

    Rows are taken longest first (ties by key); a batch closes when its first
    row's length times the number of rows would pass ``budget``. Adds ``n_items``
    and ``batch_no``. Rows without items are left out. ``items`` may also be a
    column of their numbers, where the lists themselves need not travel.

    The sequential part sees only the lengths of a group and how often each
    occurs. Rows are ranked inside one length of one group, and where one length
    has very many rows, inside a slice of their keys.
    """
    sized = _sized(df, items)
    placed = rank_in_groups(sized, [group, "n_items"], key, "_inside", rows_per_bucket)
    at = F.col("begin") + F.col("_inside")
    number = F.when(at < F.col("first"), F.col("batches_before") - 1).otherwise(
        F.col("batches_before") + F.call_function("div", at - F.col("first"), F.col("batch_rows"))
    )
    return (
        placed.join(_starts(sized, group, budget), [group, "n_items"])
        .withColumn("batch_no", number.cast("bigint"))
        .select(*df.columns, "n_items", "batch_no")
    )


def length_batch_first(
    df: DataFrame,
    budget: int,
    group: str = "bk",
    key: str = "id",
    items: str = "input_ids",
    rows_per_bucket: int = BUCKET_ROWS,
) -> DataFrame:
    """Only the first of those batches: the ``max(1, budget // longest)`` longest rows of a group.

    Lengths that begin beyond the first batch are dropped before any row is
    ranked, and no batch has more rows than the budget has tokens.
    """
    sized = _sized(df, items)
    starts = _starts(sized, group, budget)
    room = F.max_by("batch_rows", "n_items").over(Window.partitionBy(group)).alias("room")
    starts = starts.select(group, "n_items", "begin", room).where(F.col("begin") < F.col("room"))
    near = sized.join(starts, [group, "n_items"])
    placed = rank_in_groups(near, [group, "n_items"], key, "_inside", rows_per_bucket, below=max(1, budget))
    return placed.where(F.col("begin") + F.col("_inside") < F.col("room")).select(*df.columns, "n_items")


def pad_batch(df: DataFrame, batch: Sequence[str], lists: Sequence[str], pad: int = 0) -> DataFrame:
    """Pad the list columns to the longest of their batch; rows without items are dropped."""
    batch = list(batch)
    kept = df.where(F.size(lists[0]) > 0)
    wide = kept.withColumn("width", F.max(F.size(lists[0])).over(Window.partitionBy(*batch)))
    for name in lists:
        wide = wide.withColumn(name, pad_to(F.col(name), F.col("width"), F.lit(pad)))
    return wide
