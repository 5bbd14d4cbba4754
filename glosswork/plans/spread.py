"""Bucketed ranks, lookups that survive hot keys, and tables written between steps."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BUCKET_ROWS = 1_000_000  # rows one task should rank
SMALL_ROWS = 100_000  # rows a side may have to be sent to every executor
SMALL_BYTES = 64 << 20  # and bytes
HOT_ROWS = 1_000_000  # rows of one key from which its rows are split
HOT_SPLITS = 64  # parts a hot key is split into


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a
    local session may go without it. A plain path on a cluster whose default file
    system is each machine's own gets a warning: only a shared mount will do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    one_machine = re.match(r"local(\[|$)", spark.sparkContext.master)
    if root and ":/" not in root and not one_machine:
        if (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
            warnings.warn("spark.checkpoint.dir is a plain path; it must be a mount that all executors share", stacklevel=3)
    if not root:
        if not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="glosswork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/glosswork-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Fixes rows whose order or partition number must not change when a lost
    executor makes Spark compute something again.
    """
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made; nothing that is still to be computed may read them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, max_rows: int = SMALL_ROWS, max_bytes: int = SMALL_BYTES) -> DataFrame | None:
    """The frame as a local table when it has at most ``max_rows`` rows and ``max_bytes`` bytes, else None.

    Rows up to one more than the bound are written and measured there; only what
    has proved small reaches the driver, so a join with the result may broadcast it.
    """
    kept = written(df.limit(max_rows + 1), "bounded")
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, size = kept.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if rows > max_rows or size > max_bytes:
        return None
    if rows == 0:
        return df.sparkSession.createDataFrame([], df.schema)
    return df.sparkSession.createDataFrame(kept.toArrow(), schema=df.schema)


def quantile_bounds(
    df: DataFrame, column: str, rows_per_bucket: int = BUCKET_ROWS, rows: int | None = None
) -> list:
    """Values that cut a numeric column into about equal parts of ``rows_per_bucket`` rows."""
    rows = df.count() if rows is None else rows
    buckets = math.ceil(rows / rows_per_bucket)
    if buckets <= 1:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(column, shares, 10 * buckets).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(value: Column, bounds: Sequence, value_type: str, closed: bool = False) -> Column:
    """How many of the sorted bounds lie below the value (``closed``: or equal it): a binary search over a literal."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b).cast(value_type) for b in bounds])
    steps = F.array(*[F.lit(1 << p) for p in range(len(bounds).bit_length() - 1, -1, -1)])

    def below(at: Column) -> Column:
        edge = F.get(edges, at - 1)
        return edge <= value if closed else edge < value

    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & below(at + step), at + step).otherwise(at),
    )


def rank_in_buckets(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    name: str,
    below: int | None = None,
) -> DataFrame:
    """0-based place of every row in its group, the group being cut into ordered buckets.

    ``bucket`` must never decrease along ``order``. No task sorts more than one
    bucket of one group, so a group holding most of the rows is ranked by many
    tasks. The table of bucket sizes has one row per group and bucket and is
    summed from map-side counts. With ``below`` only places under it are kept,
    and buckets that lie wholly beyond it are dropped before ranking.
    """
    groups = list(groups)
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    if below is not None:
        starts = starts.where(F.col("_start") < below)
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order))
    ranked = (
        marked.join(starts, same)
        .withColumn(name, (F.col("_start") + inside - 1).cast("bigint"))
        .drop("_bucket", "_b", "_start", *[f"_g{i}" for i in range(len(groups))])
    )
    return ranked if below is None else ranked.where(F.col(name) < below)


def rank_in_groups(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    name: str,
    rows_per_bucket: int = BUCKET_ROWS,
    below: int | None = None,
) -> DataFrame:
    """0-based place of every row in its group by a key, large inputs being cut at quantiles of the key."""
    bucket = _key_slices(df, key, rows_per_bucket)
    if bucket is not None:
        return rank_in_buckets(df, groups, bucket, [key], name, below)
    place = (F.row_number().over(Window.partitionBy(*groups).orderBy(key)) - 1).cast("bigint")
    ranked = df.withColumn(name, place)
    return ranked if below is None else ranked.where(F.col(name) < below)


def _key_slices(df: DataFrame, key: str, rows_per_bucket: int) -> Column | None:
    """The slice of the key's range that a row lies in, never falling along the key; None when one slice is enough."""
    kind = numeric_type(df, key)
    if kind:
        bounds = quantile_bounds(df, key, rows_per_bucket)
        return bucket_of(F.col(key), bounds, kind) if bounds else None
    rows = df.count()
    if rows <= rows_per_bucket:
        return None
    # Keys that are not numbers are cut where a range sort of the distinct ones would cut them.
    parts = math.ceil(rows / rows_per_bucket)
    placed = df.select(key).distinct().repartitionByRange(parts, key).select(key, F.spark_partition_id().alias("_p"))
    edges = placed.groupBy("_p").agg(F.min(key).alias("edge")).orderBy("_p").select("edge").toArrow()["edge"].to_pylist()
    lower = [e for e in edges[1:] if e is not None]  # one key for each slice
    return bucket_of(F.col(key), lower, df.schema[key].dataType.simpleString(), closed=True) if lower else None


def sum_in_groups(
    df: DataFrame, groups: Sequence[str], key: str, amount: str, name: str, rows_per_bucket: int = BUCKET_ROWS
) -> DataFrame:
    """Sum of ``amount`` over the rows before each row in its group, in order of a key.

    No task orders more than one slice of one group's keys; the sums of slices,
    one row for each group and slice, carry over.
    """
    bucket = _key_slices(df, key, rows_per_bucket)
    inside = lambda *by: Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    if bucket is None:
        return df.withColumn(name, F.coalesce(F.sum(amount).over(inside(*groups)), F.lit(0)))
    marked = df.withColumn("_bucket", bucket)
    sums = marked.groupBy(*groups, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"),
    )
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = marked.withColumn("_within", F.coalesce(F.sum(amount).over(inside(*groups, "_bucket")), F.lit(0)))
    return (
        within.join(starts, same)
        .withColumn(name, F.col("_within") + F.col("_carried"))
        .drop("_bucket", "_b", "_within", "_carried", *[f"_g{i}" for i in range(len(groups))])
    )


def hot_lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    rows: str = "rows",
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
    total: int | None = None,
    max_hot: int = SMALL_ROWS,
) -> DataFrame:
    """Attach the one row of ``table`` that has the same keys.

    ``table[rows]`` tells how many rows of ``df`` have those keys. Rows of a hot
    key are split by a hash of the ``by`` columns and meet as many copies of its
    table row. The set of hot keys, at most ``rows of df / hot_rows`` of them, is
    broadcast when it has proved small; otherwise the rows of every key are split
    and every table row is copied. ``counts`` may supply keys and rows when
    the table itself is costly to read twice. With ``total``, the number of rows
    of ``df``, known to be too small for a hot key, this is a plain join.
    """
    keys = list(keys)
    if total is not None and total <= hot_rows:
        return df.join(table.drop(rows), keys, how)
    hot = F.col(rows) > hot_rows
    hot_keys = bounded((table if counts is None else counts).where(hot).select(*keys, F.lit(True).alias("_hot")), max_hot)
    part = F.pmod(F.xxhash64(*by), F.lit(HOT_SPLITS)).cast("int")
    every = F.sequence(F.lit(0), F.lit(HOT_SPLITS - 1))
    if hot_keys is None:
        left = df.withColumn("_hot", F.lit(True)).withColumn("_part", part)
        right = table.withColumn("_part", F.explode(every)).drop(rows)
    else:
        left = df.join(F.broadcast(hot_keys), keys, "left").withColumn(
            "_part", F.when(F.col("_hot"), part).otherwise(F.lit(0))
        )
        right = table.withColumn("_part", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0))))).drop(rows)
    return left.join(right, [*keys, "_part"], how).drop("_hot", "_part")


def attach(
    df: DataFrame,
    mapping: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    rows: str = "rows",
    how: str = "left",
    max_rows: int = SMALL_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``hot_lookup``, or a broadcast join when the mapping has proved small."""
    small = bounded(mapping.drop(rows), max_rows)
    if small is not None:
        return df.join(F.broadcast(small), list(keys), how)
    return hot_lookup(df, mapping, keys, by, rows, how, hot_rows)


def numeric_type(df: DataFrame, column: str) -> str | None:
    """Spark's name for the column's type when it is numeric, else None."""
    kind = df.schema[column].dataType
    return kind.simpleString() if isinstance(kind, T.NumericType) else None
