"""Packing and length batches against the sequential loops they replace."""

import random

import pytest
from pyspark.sql import functions as F

from glosswork import operators as op


def lists(seed, groups=4, rows=12, longest=15):
    rng = random.Random(seed)
    data, k = [], 0
    for g in range(groups):
        for _ in range(rng.randrange(rows + 1)):
            data.append((k, g, [rng.randrange(100) for _ in range(rng.randrange(longest + 1))]))
            k += 1
    return data


def frame(spark, data, parts=5):
    return spark.createDataFrame(data, "id bigint, bk bigint, input_ids array<int>").repartition(parts)


def pack_loop(data, length):
    found = {}
    for g in {d[1] for d in data}:
        flat = [t for d in sorted(data) if d[1] == g for t in d[2]]
        total = len(flat) if len(flat) < length else len(flat) // length * length
        for i in range(0, total, length):
            found[(g, i // length)] = flat[i : i + length][: total - i]
    return found


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("length", [1, 7, 40, 1000])
def test_pack_blocks_loop(spark, seed, length):
    data = lists(seed)
    got = op.pack_blocks(frame(spark, data, seed + 1), length, "bk").collect()
    assert {(r.batch, r.block): r.input_ids for r in got} == pack_loop(data, length)


def test_pack_blocks_edges(spark):
    data = [(0, 0, [1] * 4), (1, 1, [1] * 5), (2, 2, [1] * 6), (3, 3, []), (4, 4, [1, 2]), (5, 4, []), (6, 4, [3, 4, 5])]
    got = op.pack_blocks(frame(spark, data), 5, "bk").collect()
    assert {(r.batch, r.block): r.input_ids for r in got} == {
        (0, 0): [1] * 4,
        (1, 0): [1] * 5,
        (2, 0): [1] * 5,
        (4, 0): [1, 2, 3, 4, 5],
    }


def batch_loop(data, budget):
    """Batches per group as lists of keys, longest row first."""
    found = {}
    for g in {d[1] for d in data}:
        batches, batch, width = [], [], 0
        for key, _, items in sorted((d for d in data if d[1] == g), key=lambda d: (-len(d[2]), d[0])):
            if not items:
                break
            if width * (len(batch) + 1) > budget:
                batches.append(batch)
                batch, width = [], 0
            if not batch:
                width = len(items)
            batch.append(key)
        if batch:
            batches.append(batch)
        found[g] = batches
    return found


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("budget", [1, 9, 30, 10_000])
@pytest.mark.parametrize("bucket", [6, 1_000_000])
def test_length_batches_loop(spark, seed, budget, bucket):
    data = lists(seed, rows=25, longest=seed * 4 + 1)
    want = batch_loop(data, budget)
    df = frame(spark, data, seed + 1)
    got = {(r.bk, r.batch_no, r.id) for r in op.length_batches(df, budget, rows_per_bucket=bucket).collect()}
    assert got == {(g, n, key) for g, batches in want.items() for n, b in enumerate(batches) for key in b}
    first = {(r.bk, r.id) for r in op.length_batch_first(df, budget, rows_per_bucket=bucket).collect()}
    assert first == {(g, key) for g, batches in want.items() for b in batches[:1] for key in b}


def test_area_stays_within_budget(spark):
    data = lists(9, groups=3, rows=200, longest=40)
    batches = op.length_batches(frame(spark, data), 100).groupBy("bk", "batch_no").agg(
        F.max("n_items").alias("w"), F.count("*").alias("n")
    )
    assert batches.where("w * n > 100 AND n > 1").count() == 0


def test_no_batches_of_empty_rows(spark):
    df = frame(spark, [(0, 0, []), (1, 0, [])])
    assert op.length_batches(df, 10).count() == 0
    assert op.length_batch_first(df, 10).count() == 0
    assert op.pad_batch(df, ["bk"], ["input_ids"]).count() == 0


def test_pad_batch(spark):
    df = frame(spark, [(0, 0, [5]), (1, 0, [6, 7, 8]), (2, 0, []), (3, 1, [9])])
    got = {r.id: (r.width, r.input_ids) for r in op.pad_batch(df, ["bk"], ["input_ids"]).collect()}
    assert got == {0: (3, [5, 0, 0]), 1: (3, [6, 7, 8]), 3: (1, [9])}
