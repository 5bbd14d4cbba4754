"""A record that is refreshed equals one that is built anew."""

import random

import numpy as np
import pytest

from glosswork import operators as op
from glosswork.operators import record


def encoder(log):
    def run(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return np.array([[len(t), sum(map(ord, t))] for t in texts], float).reshape(-1, 2)

    return run


def test_random_histories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record, "DELTAS", 2)
    draw, path, log = random.Random(4), str(tmp_path / "r"), tmp_path / "log"
    docs: dict[int, str] = {}
    kept = {}
    for step in range(5):
        before = dict(docs)
        for i in range(30):
            what = draw.random()
            if what < 0.3:
                docs[i] = f"{step} {draw.randrange(3)}"
            elif what < 0.45:
                docs.pop(i, None)
        log.write_text("")
        frame = spark.createDataFrame(list(docs.items()), "raw_id bigint, text string")
        assert op.refresh_record(frame, path, encoder(log)) == step + 1
        assert sorted(log.read_text().split("\n")[:-1]) == sorted(t for i, t in docs.items() if before.get(i) != t)
        wanted = sorted(map(str, op.embed_corpus(frame, encoder(tmp_path / "other")).collect()))
        assert sorted(map(str, op.read_record(spark, path).collect())) == wanted
        kept[step + 1] = wanted
        told = op.manifests(spark, path).where(f"version = {step + 1}").first()
        assert told.rows == len(docs) and told.gone == len(before.keys() - docs.keys()) and told.new == len(docs.keys() - before.keys())
    for version, wanted in kept.items():  # older versions can still be read
        assert sorted(map(str, op.read_record(spark, path, version).collect())) == wanted
    assert op.refresh_record(frame, path, encoder(log)) == 5 and op.change_set(frame, spark, path).count() == 0


def test_a_failed_refresh_leaves_the_record(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.createDataFrame([(1, "a"), (2, None)], "raw_id bigint, text string")
    assert op.refresh_record(one, path) == 1

    def broken(texts):
        raise RuntimeError("no model")

    two = spark.createDataFrame([(1, "b"), (3, "c")], "raw_id bigint, text string")
    with pytest.raises(Exception):
        op.refresh_record(two, path, broken)
    assert {r.raw_id for r in op.read_record(spark, path).collect()} == {1, 2}
    assert op.refresh_record(two, path) == 2
    assert {r.raw_id for r in op.read_record(spark, path).collect()} == {1, 3}


def test_ids_must_identify(spark, tmp_path):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "raw_id bigint, text string")
    with pytest.raises(ValueError):
        op.refresh_record(twice, str(tmp_path / "r"))
    assert op.read_record(spark, str(tmp_path / "r")).count() == 0
    assert op.refresh_record(twice.limit(0), str(tmp_path / "r")) == 1
    with pytest.raises(ValueError):
        op.read_record(spark, str(tmp_path / "r"), 9)
