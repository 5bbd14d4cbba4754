"""Tokens and spans meet in bins."""

import random

import pytest

from glosswork import operators as op

TOKENS = "id bigint, token_no int, b int, e int, tok string"
SPANS = "id bigint, span_no int, b int, e int"


def brute(tokens, spans):
    return sorted((i, t, s, tok) for i, t, b, e, tok in tokens if b < e for j, s, x, y in spans if i == j and None not in (x, y) and x <= y and e >= x and b <= y)


@pytest.mark.parametrize(("width", "most"), [(1, 10_000), (7, 3), (64, 10_000)])
def test_equal_to_all_pairs(spark, width, most):
    draw = random.Random(width)
    tokens, spans = [], []
    for i in (1, 2, 5):
        at = 0
        for n in range(40 if i < 5 else 3):
            size = draw.randrange(4)
            tokens.append((i, n, at, at + size, f"t{n}"))
            at += size + draw.randrange(3)
        spans += [(i, s, x, x + draw.choice([0, 1, 5, 30])) for s in range(25) for x in [draw.randrange(90)]]
        spans += [(i, 100 + s, 14, 21) for s in range(9)]  # a place that very many spans reach
    spans += [(1, 900, 5, 4), (1, 901, None, 3), (9, 902, 0, 9), (1, 903, 0, 1000)]
    got = op.span_join(spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(spans, SPANS), width=width, bin_spans=most)
    assert got.columns == ["id", "token_no", "span_no", "tok"]
    assert sorted(map(tuple, got.collect())) == brute(tokens, spans)


def test_ends_that_touch_at_a_border_of_bins(spark):
    tokens, spans = [(1, 0, 0, 8, "a"), (1, 1, 8, 16, "b"), (1, 2, 16, 16, "")], [(1, 0, 8, 8), (1, 1, 16, 17), (1, 2, 7, 9)]
    got = op.span_join(spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(spans, SPANS), width=8)
    assert sorted(map(tuple, got.collect())) == brute(tokens, spans) == [(1, 0, 0, "a"), (1, 0, 2, "a"), (1, 1, 0, "b"), (1, 1, 1, "b"), (1, 1, 2, "b")]


def test_a_long_text_is_many_tasks(spark):
    tokens = spark.range(50_000).selectExpr("1L AS id", "CAST(id AS int) AS token_no", "CAST(id * 2 AS int) AS b", "CAST(id * 2 + 1 AS int) AS e", "'x' AS tok")
    spans = spark.createDataFrame([(1, 0, 0, 100_000)], SPANS)
    found = op.span_join(tokens, spans, width=256)
    assert found.count() == 50_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        from pyspark.sql import functions as F

        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
