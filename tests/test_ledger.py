"""Ids of rows that keep arriving."""

import random

import pytest

from glosswork import sources as io


def test_any_number_of_steps_equals_what_was_given_before(spark, tmp_path):
    path, ledger = str(tmp_path / "corpus"), str(tmp_path / "ledger")
    draw, known = random.Random(3), {}
    for step in range(4):
        for part in range(draw.randint(1, 2)):
            rows = [(f"{step} {part} {i}",) for i in range(draw.randint(1, 40))]
            # Names that sort before older ones: old ids must not move.
            spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(f"{path}/{9 - step}{part}")
        assert io.number_new_files(spark, f"{path}/*", ledger) > 0
        assert io.number_new_files(spark, f"{path}/*", ledger) == 0
        now = {r.text: r.raw_id for r in io.read_numbered(spark, f"{path}/*", ledger).collect()}
        assert {t: i for t, i in now.items() if t in known} == known
        assert sorted(now.values()) == list(range(len(now)))
        for text, i in now.items():  # rows of a file keep their order
            head, _, n = text.rpartition(" ")
            assert n == "0" or now[f"{head} {int(n) - 1}"] == i - 1
        known = now
    assert io.read_ledger(spark, ledger).select("step").distinct().count() == 4


def test_unnumbered_and_changed_files(spark, tmp_path):
    path, ledger = str(tmp_path / "corpus"), str(tmp_path / "ledger")
    frame = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    frame.write.parquet(path)
    assert io.read_numbered(spark, path, ledger).count() == 0
    assert io.number_new_files(spark, path, ledger) == 1
    name = io.read_ledger(spark, ledger).first().file.removeprefix("file:")
    spark.createDataFrame([("c",)], "text string").coalesce(1).write.parquet(str(tmp_path / "other"))
    import glob
    import os
    import shutil

    shutil.copy(glob.glob(str(tmp_path / "other" / "part-*.parquet"))[0], name)
    crc = os.path.join(path, f".{os.path.basename(name)}.crc")
    shutil.copy(glob.glob(str(tmp_path / "other" / ".part-*.crc"))[0], crc)
    spark.catalog.refreshByPath(path)
    with pytest.raises(ValueError):
        io.number_new_files(spark, path, ledger)
