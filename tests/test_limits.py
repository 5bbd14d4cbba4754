"""Repeated keys, missing labels and predictions, many hot keys, wide weights, GELU."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork.functions.arrays import running_total
from glosswork.operators import tokens
from glosswork.operators.retrieval import gelu
from glosswork.plans import hot_lookup, sum_in_groups


@pytest.mark.parametrize("keys", [[0, 0, 2], [1.5, 1.5, 3.0], ["a", "a", "b"], [None, None, 1]])
def test_repeated_keys_are_refused(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], ["k"])
    with pytest.raises(ValueError, match="identify a row"):
        op.dense_row_id(df, ["k"])


def test_missing_labels(spark):
    df = spark.createDataFrame([(0, "x"), (1, None), (2, "y")], "id bigint, label string")
    index = op.label_index_sorted(df)
    assert {r.label for r in index.collect()} == {"x", "y"}
    assert [r.label_id for r in op.apply_label_index(df, index).orderBy("id").collect()] == [0, None, 1]
    with pytest.raises(Exception, match="unseen label: NULL"):
        op.apply_label_index(df, index, unseen="error").collect()


def test_missing_predictions_are_wrong(spark):
    df = spark.createDataFrame([(1, 1), (None, 1)], "pred bigint, label bigint")
    assert op.accuracy(df).first().accuracy == 0.5
    rows = [(1, True, 5, 5, -1.0), (1, True, None, 5, -1.0)]
    cloze = spark.createDataFrame(rows, "id bigint, masked boolean, pred_id bigint, correct_id bigint, logp double")
    assert op.cloze_exact_match(cloze).first().exact_match == 0.0


@pytest.mark.parametrize("max_hot", [0, 100])
def test_hot_keys_with_and_without_broadcast(spark, max_hot):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).withColumn("v", F.col("k") * 10)
    found = hot_lookup(df, table, ["k"], ["id"], hot_rows=5, max_hot=max_hot)
    assert found.count() == 100 and found.where("v != k * 10").count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_sums_in_slices(spark, kind):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.format_string("%04d", "id").cast(kind).alias("k"), F.lit(2).alias("n"))
    found = sum_in_groups(df, ["g"], "k", "n", "at", rows_per_bucket=40).orderBy("g", "k").collect()
    for g in (0, 1):
        assert [r["at"] for r in found if r.g == g] == [2 * i for i in range(250)]


def test_lengths_of_string_keys_in_slices(spark):
    df = spark.range(300).select(F.format_string("%04d", "id").alias("id"), F.lit(0).alias("bk"), F.array_repeat(F.lit(1), 5).alias("input_ids"))
    one, many = (op.length_batches(df, 50, rows_per_bucket=n).orderBy("id").collect() for n in (10_000, 30))
    assert one == many


def test_weights_in_blocks_of_columns(spark):
    weight, bias = np.arange(12.0).reshape(3, 4), np.arange(4.0)
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "embedding array<double>")
    whole, parts = (op.dense_layer(df, weight, bias, matrix_bytes=b).first().output for b in (1 << 20, 24))
    assert whole == parts == (np.array([1.0, 2.0, 3.0]) @ weight + bias).tolist()


def test_gelu():
    x = np.linspace(-12, 12, 501)
    wanted = [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x]
    assert np.abs(gelu(x) - wanted).max() < 1e-12


def test_equal_ids_are_embedded_apart(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c")], "raw_id bigint, text string")
    assert op.embed_corpus(df).count() == 2


def test_whole_vocabulary(spark):
    df = spark.createDataFrame([([f"t{i}" for i in range(3000)] + ["t5"] * 3,)], "toks array<string>").withColumn("id", F.lit(1))
    vocab = op.build_vocab(df)
    assert vocab.count() == 3000 and vocab.orderBy("token_id").first().token == "t5"
    for most in (10, 500_000):
        ids = op.encode_ids(df, vocab, max_local=most).first().input_ids
        assert len(ids) == 3003 and 3 not in ids
    assert op.build_vocab(df, 14).count() == 10


def test_large_vocabularies_join_rare_tokens_only(spark, monkeypatch):
    lists = [(1, ["a", "b", None, "rare1", "a"]), (1, ["b", "rare2"]), (1, ["b", "rare2"]), (None, ["a", "new", "rare1"]), (2, []), (3, None), (4, ["a", "x" * 99, "a"])]
    df = spark.createDataFrame(lists, "id bigint, toks array<string>")
    vocab = op.build_vocab(df.select(F.expr("filter(toks, t -> t <> 'new')").alias("toks")))
    joined, join = [], tokens.hot_lookup
    monkeypatch.setattr(tokens, "hot_lookup", lambda rows, *rest, **more: joined.append(rows.count()) or join(rows, *rest, **more))
    few, whole = (sorted(op.encode_ids(df, vocab, max_local=n).select("id", "input_ids").collect(), key=repr) for n in (2, 100))
    assert few == whole
    assert joined == [7]  # all but the nine "a" and "b"


def test_running_totals_of_many_lists(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 != 0, F.array_repeat(F.lit(2), (F.col("id") % 5).cast("int"))).alias("a"))
    for row in df.withColumn("s", running_total("a")).collect():
        assert (row.s or []) == [2 * (i + 1) for i in range(len(row.a or []))]


def test_running_totals_hold_little_beside_their_result():
    sizes = np.full(2000, 1000)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.ones(sizes.sum(), np.int32)))
    tracemalloc.start()
    sums = running_total.func(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums[5].as_py() == list(range(1, 1001)) and peak < 2 * 4 * sizes.sum()
