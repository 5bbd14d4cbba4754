"""The best epoch of every run while runs go on, kept in state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glosswork.plans.spread import scratch_folder
from glosswork.streaming.rollup import _stored

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE = "run {kind}, epoch bigint, valid double, test double, best double, closed boolean"


class BestEpoch(StatefulProcessor):
    """Sums and counts of two metrics by epoch of one run; the means decide the best epoch, whatever order points come in.

    Each trigger with points of a run gives its present answer. With ``idle_ms``, a run is closed once the watermark has
    passed its last point by that long: it gives its last answer and its state is dropped.
    """

    def __init__(self, valid: str, test: str, floor: float | None, idle_ms: int | None):
        self.valid, self.test, self.floor, self.idle_ms = valid, test, floor, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value for a run: each call on state is a message, and a value for each epoch would be as many.
        self.sums = handle.getValueState("sums", "epoch array<bigint>, is_valid array<boolean>, total array<double>, n array<bigint>")
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, sums = None, self._read()
        for frame in rows:
            epochs, metrics = frame["epoch"].to_numpy(float, na_value=np.nan), frame["metric"].to_numpy()
            values = frame["value"].to_numpy(float, na_value=np.nan)
            for metric in {self.valid, self.test}:
                wanted = (metrics == metric) & ~np.isnan(epochs)
                found, at = np.unique(frame["epoch"].to_numpy()[wanted].astype(np.int64), return_inverse=True)
                some = ~np.isnan(values[wanted])
                totals = np.bincount(at[some], values[wanted][some], minlength=len(found))
                counts = np.bincount(at[some], minlength=len(found))
                for epoch, total, n in zip(found.tolist(), totals.tolist(), counts.tolist()):
                    before = sums.get((epoch, metric), (0.0, 0))
                    sums[epoch, metric] = before[0] + total, before[1] + n
            if self.idle_ms is not None and len(frame):
                newest = max(newest or 0, int(frame["ts"].max().timestamp() * 1000))
        if sums:
            at = list(sums)
            self.sums.update(([e for e, _ in at], [m == self.valid for _, m in at], [sums[x][0] for x in at], [sums[x][1] for x in at]))
        if newest is not None:
            newest = max(newest, self.last.get()[0]) if self.last.exists() else newest
            self.last.update((newest,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle_ms)
        yield from self._answer(key, sums, closed=False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._answer(key, self._read(), closed=True)
        self.sums.clear()
        self.last.clear()

    def _read(self) -> dict:
        kept = self.sums.get()
        if kept is None:
            return {}
        return {(e, self.valid if v else self.test): (t, n) for e, v, t, n in zip(*kept)}

    def _answer(self, key: Any, sums: dict, closed: bool) -> Iterator[pd.DataFrame]:
        means = {at: total / n for at, (total, n) in sums.items() if n}
        epochs = sorted(epoch for epoch, metric in means if metric == self.valid)
        if not epochs:
            return
        top = max(epochs, key=lambda e: (means[e, self.valid], -e))
        valid = means[top, self.valid]
        best = valid if self.floor is None else max(valid, self.floor)
        row = {"run": key[0], "epoch": top, "valid": valid, "test": means.get((top, self.test)), "best": best, "closed": closed}
        yield pd.DataFrame([row]).astype({"test": float})

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State of this kind needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def stream_best(
    stream: DataFrame, valid: str, test: str, floor: float | None = 0.0, idle: str | None = None, watermark: str = "1 hour", path: str | None = None
) -> DataFrame:
    """Follow a stream of ``run, epoch, metric, value`` over all data that is there: ``run, epoch, valid, test, best, closed``.

    As ``metric_at_best`` and ``best_so_far`` say it of what has come: the epoch where the validation mean peaked, the
    earliest on ties, the test mean of that epoch, and the best validation value from ``floor`` on. With ``idle``, a
    time such as ``1 day`` that needs a column ``ts``, quiet runs are closed and later points of them begin anew; points
    behind the watermark are dropped. Each trigger writes its answers to a folder of its own, so a retried one repeats them.
    """
    spark = stream.sparkSession
    path = path or scratch_folder(spark, "best")
    idle_ms = None
    if idle is not None:
        idle_ms = int(spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {idle}) AS ms").first()[0])
        stream = stream.withWatermark("ts", watermark)
    columns = ["run", "epoch", "metric", "value"] + (["ts"] if idle else [])
    schema = STATE.format(kind=stream.schema["run"].dataType.simpleString())
    keyed = stream.select(*columns).groupBy("run")
    told = keyed.transformWithStateInPandas(
        BestEpoch(valid, test, floor, idle_ms), schema, "Update", "EventTime" if idle else "None"
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/answers/batch={number:020d}")

    with _rocks(spark):
        writer = told.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
        writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return latest_answers(spark, path, schema)


def latest_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last answer for every run; of one trigger the open one, as a run may begin anew when its old part is closed."""
    stored = _stored(spark, f"{path}/answers", spark.createDataFrame([], f"{schema}, batch bigint").schema)
    order = F.struct("batch", ~F.col("closed"))
    names = [c for c in stored.columns if c not in ("run", "batch")]
    stored = stored.withColumn("test", F.nanvl("test", F.lit(None).cast("double")))  # pandas has no null number
    return stored.groupBy("run").agg(F.max_by(F.struct(*names), order).alias("_last")).select("run", "_last.*")
