"""Any split of the points into triggers gives the batch answer."""

import datetime as dt
import random

from glosswork import operators as op
from glosswork import streaming as live

SCHEMA = "run bigint, epoch bigint, metric string, value double, ts timestamp"
START = dt.datetime(2024, 1, 1)


def some_points(seed, n=400):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        epoch = draw.choice([None, *range(6)]) if i % 50 == 0 else draw.randrange(6)
        rows.append((draw.randrange(9), epoch, draw.choice(["v", "t", "x"]), round(draw.uniform(-1, 1), 2), START + dt.timedelta(minutes=i)))
    return rows + [(20, 1, "t", 1.0, START), (21, 2, "v", 0.5, START), (21, 1, "v", 0.5, START), (22, 1, "v", None, START)]


def wanted(spark, rows):
    points = spark.createDataFrame(rows, SCHEMA).where("epoch is not null")
    epochs = op.epoch_mean(points)
    at = {r.run: (r.epoch, round(r.valid, 9), None if r.test is None else round(r.test, 9)) for r in op.metric_at_best(epochs, "v", "t").collect()}
    best = {}
    for r in op.best_so_far(epochs.where("metric = 'v' and value is not null")).collect():
        best[r.run] = max(best.get(r.run, 0.0), r.best)
    return {run: (*a, round(best[run], 9)) for run, a in at.items()}


def told(found):
    return {r.run: (r.epoch, round(r.valid, 9), None if r.test is None else round(r.test, 9), round(r.best, 9)) for r in found.collect()}


def test_triggers_and_restarts_give_the_batch_answer(spark, tmp_path):
    rows = some_points(2)
    random.Random(1).shuffle(rows)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        for half in range(2):
            spark.createDataFrame(rows[part * 140 + half * 70 : part * 140 + half * 70 + 70], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = live.read_text_stream(spark, folder, SCHEMA, "*.parquet", 1)
        found = live.stream_best(stream, "v", "t", path=out)
        assert told(found) == wanted(spark, rows[: part * 140 + 140])
        assert not any(r.closed for r in found.collect())


def test_quiet_runs_are_closed(spark, tmp_path):
    folder = str(tmp_path / "in")
    old = [(1, 0, "v", 0.25, START), (1, 1, "v", 0.75, START), (1, 1, "t", 0.5, START)]
    later = [(2, 0, "v", 1.0, START + dt.timedelta(days=5)), (2, 0, "t", 0.0, START + dt.timedelta(days=5))]
    last = [(2, 1, "v", 2.0, START + dt.timedelta(days=5, hours=1))]
    for rows in (old, later, last):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = live.read_text_stream(spark, folder, SCHEMA, "*.parquet", 1)
        found = live.stream_best(stream, "v", "t", idle="1 day", path=str(tmp_path / "out"))
    rows = {r.run: (r.epoch, r.valid, r.closed) for r in found.collect()}
    assert rows == {1: (1, 0.75, True), 2: (1, 2.0, False)}


def test_no_data(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "empty"))
    assert live.stream_best(stream, "v", "t").count() == 0
