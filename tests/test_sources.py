"""Files in, files out, and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork import sources as io
from glosswork import streaming as live
from glosswork.plans import bounded, scratch_folder


def test_knowledge_file_order(spark, tmp_path):
    for name, part in (("b.json", "de"), ("a.json", "abc")):
        (tmp_path / name).write_text(json.dumps([{"prompt": p + " {}", "targets": [p]} for p in part], indent=1))
    got = io.read_knowledge(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.prompt, r.targets) for r in got] == [(i, p + " {}", [p]) for i, p in enumerate("abcde")]


def test_knowledge_with_trailing_comma_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('[\n {"prompt": "a", "targets": []},\n]')
    with pytest.raises(Exception):
        io.read_knowledge(spark, str(tmp_path)).collect()


def test_knowledge_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f'p"{i}\n{{}}', [str(i)]) for i in range(25)], "id bigint, prompt string, targets array<string>")
    io.write_knowledge(df, str(tmp_path / "k"), file_rows=4)
    assert io.read_knowledge(spark, str(tmp_path / "k")).orderBy("id").collect() == df.orderBy("id").collect()


def test_jsonl(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"text": "é 😀", "label": "x"}\n{"text": "b", "label": "y", "more": 1}\n')
    got = io.read_task_jsonl(spark, str(path), numbered=True).orderBy("id").collect()
    assert [(r.id, r.text, r.label) for r in got] == [(0, "é 😀", "x"), (1, "b", "y")]
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        io.read_task_jsonl(spark, str(path)).collect()


def test_custom_files(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text('sentence1,label\n"x, ""y""",1\nz,0\n')
    (tmp_path / "a.json").write_text('{"sentence1": "x", "label": 0.5}\n')
    csv = io.read_custom(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"))
    assert [tuple(r) for r in csv["train"].collect()] == [('x, "y"', 1), ("z", 0)]
    both = io.read_custom(spark, str(tmp_path / "a.json"), str(tmp_path / "a.json"))
    assert op.task_kind(both["validation"]) == "regression"
    with pytest.raises(ValueError):
        io.read_custom(spark, "x.txt", "y.txt")
    with pytest.raises(ValueError):
        io.read_custom(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.json"))


def test_corpus_in_file_order(spark, tmp_path):
    spark.createDataFrame([(f"t{i}", i) for i in range(20)], "body string, x int").coalesce(1).write.parquet(str(tmp_path / "c"))
    got = io.read_corpus(spark, str(tmp_path / "c"), "body").orderBy("raw_id").collect()
    assert [(r.raw_id, r.text) for r in got] == [(i, f"t{i}") for i in range(20)]


def test_corpus_scan_reads_only_what_it_needs(spark):
    plan = io.read_corpus(spark, "/root/testdata/sf0.001/documents.parquet", order="doc_id")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_embedding_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)], i // 3) for i in range(9)], "raw_id bigint, embedding array<float>, s int")
    io.write_embeddings(df, str(tmp_path / "e"), "s")
    assert io.read_embeddings(spark, str(tmp_path / "e")).count() == 9
    assert {r.raw_id for r in io.read_embeddings(spark, str(tmp_path / "e"), 1).collect()} == {3, 4, 5}
    io.write_embeddings(df, str(tmp_path / "f"))
    assert io.read_embeddings(spark, str(tmp_path / "f")).columns == ["raw_id", "embedding"]


def test_named_tasks(spark, tmp_path):
    pair = spark.createDataFrame([("p", "h", 1, 0)], "premise string, hypothesis string, label int, other int")
    for split in ("train", "validation_matched", "validation_mismatched"):
        pair.write.parquet(str(tmp_path / "mnli" / f"{split}.parquet"))
    assert io.load_named_task(spark, "mnli", str(tmp_path))["validation"].columns == ["premise", "hypothesis", "label"]
    assert io.load_named_task(spark, "mnli", str(tmp_path))["validation_mismatched"].count() == 1
    with pytest.raises(ValueError):
        io.load_named_task(spark, "nothing", str(tmp_path))


def test_more_than_a_thousand_files_keep_their_order(spark, tmp_path):
    rows = spark.range(1200).select("id", F.concat(F.lit("p"), F.col("id")).alias("prompt"), F.array(F.lit("t")).alias("targets"))
    io.write_knowledge(rows, str(tmp_path / "k"), file_rows=1)
    back = io.read_knowledge(spark, str(tmp_path / "k"))
    assert back.where(F.col("prompt") != F.concat(F.lit("p"), F.col("id"))).count() == 0 and back.count() == 1200


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,label\n"one\ntwo",1\n')
    found = io.read_custom(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), multi_line=True)["train"]
    assert [(r.text, r.label) for r in found.collect()] == [("one\ntwo", 1)]


def test_bounded_measures_bytes(spark):
    assert bounded(spark.range(10).withColumn("x", F.repeat(F.lit("y"), 100)), 10, max_bytes=500) is None


def test_metrics_append(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, 1, "acc", 0.5)], "run string, epoch int, step int, metric string, value double")
    for _ in range(2):
        io.write_metrics(df, str(tmp_path / "m"))
    assert io.read_metrics(spark, str(tmp_path / "m")).count() == 2


def test_bounded_says_no(spark):
    assert bounded(spark.range(11), 10) is None
    assert bounded(spark.range(10), 10).count() == 10
    assert bounded(spark.range(0), 10).columns == ["id"]


def test_shared_folder_is_the_session_s(spark):
    assert scratch_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def points(spark, rows, path):
    start = dt.datetime(2024, 1, 1)
    data = [(start + dt.timedelta(hours=h), m, v) for h, m, v in rows]
    spark.createDataFrame(data, "ts timestamp, metric string, value double").coalesce(1).write.mode("append").parquet(path)


def test_rollup_complete_and_append(spark, tmp_path):
    path = str(tmp_path / "in")
    points(spark, [(1, "a", 1.0), (2, "a", 3.0), (2, "b", 5.0), (30, "a", 7.0), (60, "a", 9.0)], path)
    stream = lambda: live.read_text_stream(spark, path, "ts timestamp, metric string, value double", "*.parquet")
    batch = live.windowed_means(spark.read.parquet(path), "1 day", None)
    complete = live.stream_metric_rollup(stream())
    assert sorted(map(tuple, complete.collect())) == sorted(map(tuple, batch.collect()))
    closed = live.stream_metric_rollup(stream(), mode="append")
    last = batch.agg(F.max("window_start")).first()[0]
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, batch.where(F.col("window_start") < last).collect()))


def test_stream_resumes_where_it_stopped(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id bigint, text string"
    for i in range(2):
        spark.createDataFrame([(i, f"a{i}. b. c. d")], schema).write.mode("append").parquet(path)
        stream = live.read_text_stream(spark, path, schema, "*.parquet")
        found = live.stream_prepare(stream, [lambda df: op.tokenize_plain(df)], out)
        assert sorted(r.id for r in found.collect()) == list(range(i + 1))


def test_rollup_without_data(spark, tmp_path):
    schema = "ts timestamp, metric string, value double"
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "empty"))
    assert live.stream_metric_rollup(stream).count() == 0
