"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates words, spelled out so that every regular-expression engine reads it alike.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 4 << 20  # text that a task holds as arrays at a time


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_list(text: Column) -> Column:
    """The words of a text, in order; no text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores before it until no column of the frame is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def put(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add columns; one that the frame already has under such a name, in any case of letters, is replaced."""
    taken = {name.lower() for name in values}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in values.items()])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Places ``start, stop`` that cut the texts into runs of about ``limit`` bytes, one text at least in each."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def give_back() -> None:
    """Return to the system what Arrow and the allocator have freed; a worker would keep it for as long as it lives."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def running_start(
    df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[str], amount: str, name: str
) -> DataFrame:
    """Add the sum of ``amount`` over all rows of the group that come before, ``bucket`` first and ``order`` in it.

    No task sorts more than one bucket of one group. The sums of the buckets have one row for each group and
    bucket; their running totals are what one bucket carries over to the next.
    """
    from pyspark.sql.window import Window

    keys = [*groups, bucket]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"),
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = within.join(carried, same, "left")
    return joined.withColumn(name, (F.col("_within") + F.coalesce("_carried", F.lit(0))).cast("bigint")).drop(
        "_within", "_carried", *[f"_k{i}" for i in range(len(keys))]
    )
