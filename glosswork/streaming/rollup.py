"""Metric points as a stream: windowed means while a run is going on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.plans.spread import scratch_folder


def windowed_means(points: DataFrame, window: str, watermark: str | None) -> DataFrame:
    """Mean value per metric and tumbling window of ``ts``; the same plan serves batch and stream."""
    if watermark is not None and points.isStreaming:
        points = points.withWatermark("ts", watermark)
    return (
        points.groupBy(F.window("ts", window).alias("w"), "metric")
        .agg(F.avg("value").alias("value"), F.count("value").alias("points"))
        .select(F.col("w.start").alias("window_start"), "metric", "value", "points")
    )


def stream_metric_rollup(
    stream: DataFrame, window: str = "1 day", watermark: str = "1 hour", mode: str = "complete", path: str | None = None
) -> DataFrame:
    """Run the stream over all data that is there and return the windows it wrote.

    ``complete`` writes every window at each trigger, into a folder of its own:
    late rows still count, and state grows with the number of windows times metrics. ``append`` writes
    a window once the watermark has passed it: later rows for it are dropped,
    open windows are not written, and state stays bounded.
    """
    spark: SparkSession = stream.sparkSession
    path = path or scratch_folder(spark, "rollup")
    rolled = windowed_means(stream, window, watermark)
    checkpoint = f"{path}/checkpoint"
    writer = rolled.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":

        def keep(batch: DataFrame, number: int) -> None:
            # A retried batch has the same number and writes the same windows again.
            batch.write.mode("overwrite").parquet(f"{path}/windows/batch={number:020d}")

        query = writer.foreachBatch(keep).start()
        query.awaitTermination()
        return latest_windows(spark, path, rolled.schema)
    writer.format("parquet").option("path", f"{path}/windows").start().awaitTermination()
    return _stored(spark, f"{path}/windows", rolled.schema)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What was written below the path, or an empty table when no data ever came."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def latest_windows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The windows of the last finished trigger in complete mode.

    Every trigger writes a folder of its own and a reader takes the newest that
    has been committed, so none ever sees half of one.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/windows/batch=*/_SUCCESS")
    done = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    folders = sorted(str(done[i].getPath().getParent()) for i in range(len(done))) if done is not None else []
    return spark.read.schema(schema).parquet(folders[-1]) if folders else spark.createDataFrame([], schema)
