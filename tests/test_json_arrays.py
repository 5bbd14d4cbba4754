"""One array file, many tasks."""

import json
import random

import pytest

from glosswork import sources as io
from glosswork.sources import json_arrays

ODD = ['}', '{', '"', '\\', '\\"', '},{', '[', ']', ',', '\n', 'é', '😀', ' ', 'a', '"}', '\\\\', '":{', "\t", "}]"]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def records(seed, n):
    draw = random.Random(seed)
    text = lambda most: "".join(draw.choice(ODD) for _ in range(draw.randint(0, most)))
    return [{"prompt": text(draw.choice([5, 60, 400])), "targets": [text(6) for _ in range(draw.randint(0, 3))]} for _ in range(n)]


@pytest.mark.parametrize(("layout", "sent"), [({}, True), ({"indent": 2, "ensure_ascii": False}, False)])
def test_equal_to_a_plain_parser(spark, tmp_path, monkeypatch, small_ranges, layout, sent):
    if not sent:
        monkeypatch.setattr(json_arrays, "RANGES", 0)  # starts too many to send
    wanted = []
    for i, n in enumerate((40, 0, 1, 25)):
        rows = records(i, n)
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, **layout) + "\n" * (i % 2))
        wanted += rows
    got = io.read_knowledge(spark, str(tmp_path), split=True).orderBy("id").collect()
    assert [(r.id, r.prompt, r.targets) for r in got] == [(i, r["prompt"], r["targets"]) for i, r in enumerate(wanted)]


def test_one_file_is_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps(records(9, 60)))
    assert json_arrays._fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_nested_objects(spark, tmp_path, small_ranges):
    rows = [{"a": {"b": {"c": i}, "d": "}"}, "e": [{"f": i}, {"f": -i}]} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    got = io.read_json_array(spark, str(tmp_path), "a struct<b: struct<c: int>, d: string>, e array<struct<f: int>>", "row").orderBy("row")
    assert [(r.row, r.a.b.c, r.a.d, [x.f for x in r.e]) for r in got.collect()] == [(i, i, "}", [i, -i]) for i in range(50)]


@pytest.mark.parametrize(
    "text",
    [
        '[{"prompt": "a", "targets": []},]',
        '[{"prompt": "a", "targets": []}',
        '{"prompt": "a", "targets": []}',
        '[{"prompt": "a", "targets": []} {"prompt": "b", "targets": []}]',
        '[{"prompt": "a", "targets": []}, x {"prompt": "b", "targets": []}]',
        '[{"prompt": "a", "targets": [}]',
        '[,{"prompt": "a", "targets": []}]',
    ],
)
def test_malformed_files_fail(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        io.read_knowledge(spark, str(tmp_path), split=True).collect()
