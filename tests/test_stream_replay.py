"""Two streams that meet give the batches of closed windows."""

import datetime as dt
import random

from glosswork import operators as op
from glosswork import streaming as live
from glosswork.streaming import replay

DOMAIN = "id bigint, bk bigint, ts timestamp"
HITS = "query_id bigint, rank bigint, raw_id bigint, ts timestamp"
START = dt.datetime(2024, 1, 1)


def test_closed_windows_equal_the_batch_answer(spark, tmp_path):
    draw = random.Random(6)
    at = lambda hours: START + dt.timedelta(hours=hours)
    corpus = spark.createDataFrame([(i, [1] * (i * 3 % 8)) for i in range(9)], "raw_id bigint, input_ids array<int>")
    domain = [(i, i // 6, at(i // 6 + 0.1)) for i in range(30)]
    hits = [(i, r, draw.randrange(9), at(i // 6 + draw.choice([0.2, 0.9]))) for i in range(30) for r in (1, 2)]
    hits += [(3, 1, 8, at(40)), (4, 2, 8, START)]  # too long after its row, and before it
    steps = [(domain[:12], hits[:20]), (domain[12:], hits[20:]), ([(99, 99, at(900))], [(98, 1, 0, at(900))]), ([(2, 0, at(0.3))], [(2, 1, 7, at(0.4))])]
    sizes = []
    for left, right in steps:
        spark.createDataFrame(left, DOMAIN).coalesce(1).write.mode("append").parquet(str(tmp_path / "domain"))
        spark.createDataFrame(right, HITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "hits"))
        found = live.stream_replay(
            live.read_text_stream(spark, str(tmp_path / "domain"), DOMAIN, "*.parquet"),
            live.read_text_stream(spark, str(tmp_path / "hits"), HITS, "*.parquet"),
            corpus, 2, 12, path=str(tmp_path / "out"),
        )
        sizes.append(found.count())
    assert sizes[0] < sizes[2] == sizes[3]  # the rows of the last step come far behind the watermark
    items = [(q // 6, q * 2 + r - 1, raw) for q, r, raw, _ in hits[:60]]
    whole = spark.createDataFrame(items, "bk bigint, item bigint, raw_id bigint").join(corpus, "raw_id")
    wanted = op.length_batches(whole, 12, "bk", "item").select("bk", "item", "raw_id", "n_items", "batch_no")
    got = found.select("bk", "item", "raw_id", "n_items", "batch_no")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_trigger_joins_its_streams_once(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(i, [1] * (i + 1)) for i in range(4)], "raw_id bigint, input_ids array<int>")
    times = [START, START, START + dt.timedelta(hours=900)]
    domain = spark.createDataFrame([(i, 0, t) for i, t in enumerate(times)], DOMAIN)
    hits = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(times)], HITS)
    domain.write.parquet(str(tmp_path / "domain"))
    hits.write.parquet(str(tmp_path / "hits"))
    plans, cut = [], replay.length_batches
    monkeypatch.setattr(replay, "length_batches", lambda rows, *rest: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or cut(rows, *rest))
    found = live.stream_replay(
        live.read_text_stream(spark, str(tmp_path / "domain"), DOMAIN, "*.parquet"),
        live.read_text_stream(spark, str(tmp_path / "hits"), HITS, "*.parquet"),
        corpus, 1, 12, path=str(tmp_path / "out"),
    )
    assert sorted((r.item, r.raw_id) for r in found.collect()) == [(0, 0), (1, 1)]
    assert plans and all("parquet" in plan and "LogicalRDD" not in plan for plan in plans)  # cut from written rows
