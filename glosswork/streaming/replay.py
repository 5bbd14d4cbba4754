"""Replay batches while domain rows and their hits are still coming in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators.packing import length_batches
from glosswork.plans.spread import forget, scratch_folder, written
from glosswork.streaming.rollup import _stored


def stream_replay(
    domain: DataFrame,
    hits: DataFrame,
    corpus: DataFrame,
    k: int,
    budget: int,
    window: str = "1 hour",
    delay: str = "1 hour",
    group: str = "bk",
    key: str = "id",
    path: str | None = None,
) -> DataFrame:
    """``retrieval_replay`` of two streams over all data that is there: ``window_start, group, item, raw_id, n_items, batch_no``.

    ``domain`` is a stream of ``key, group, ts`` and ``hits`` one of ``query_id, rank, raw_id, ts``; ``corpus`` is a table of
    ``raw_id, input_ids``. A hit belongs to a domain row when it comes at most ``window`` after it and not before it. Groups
    are cut into batches by length once the watermark, ``delay`` behind what both streams have brought, has passed their
    tumbling window of domain times; a group that reaches over two windows is two. Rows of either stream that come behind the
    watermark are dropped, and so is the state of what can't meet any more, so state holds open windows only. Each trigger
    writes what it closes to a folder of its own; a retried one writes the same again.
    """
    spark = domain.sparkSession
    path = path or scratch_folder(spark, "replay")
    kind = domain.schema[group].dataType.simpleString()
    asked = domain.select(F.col(key).alias("_id"), F.col(group).alias("_group"), F.col("ts").alias("_asked")).withWatermark("_asked", delay)
    found = hits.select("query_id", "rank", "raw_id", F.col("ts").alias("_found")).withWatermark("_found", delay)
    met = (F.col("query_id") == F.col("_id")) & (F.col("_found") >= F.col("_asked")) & (F.col("_found") <= F.col("_asked") + F.expr(f"interval {window}"))
    pairs = asked.join(found, met).select("_asked", "_group", "raw_id", (F.col("query_id") * k + F.col("rank") - 1).cast("bigint").alias("item"))
    sizes = written(corpus.select("raw_id", F.size("input_ids").alias("_size")), "sizes")  # every trigger reads them
    sized = pairs.join(sizes, "raw_id")
    closed = sized.groupBy(F.window("_asked", window).alias("_w"), "_group").agg(F.collect_list(F.struct("item", "raw_id", "_size")).alias("_rows"))
    schema = f"window_start timestamp, {group} {kind}, item bigint, raw_id bigint, n_items int, batch_no bigint"

    def keep(batch: DataFrame, number: int) -> None:
        # Written, as every look at the batch would run the join and its state again.
        rows = written(batch.select(F.struct("_w.start", "_group").alias("_at"), F.explode("_rows").alias("_r")).select("_at", "_r.*"), "closing")
        cut = length_batches(rows, budget, "_at", "item", "_size")
        cut.select(
            F.col("_at.start").alias("window_start"), F.col("_at._group").alias(group), "item", F.col("raw_id").cast("bigint").alias("raw_id"), "n_items", "batch_no"
        ).write.mode("overwrite").parquet(f"{path}/closed/batch={number:020d}")
        forget(rows)

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return _stored(spark, f"{path}/closed", spark.createDataFrame([], schema + ", batch bigint").schema).drop("batch")
