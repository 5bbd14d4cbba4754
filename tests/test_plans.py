"""What the plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork.catalog import views as v
from glosswork.functions import flattened, snippet, tokens

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_k_is_pruned_before_the_shuffle(spark):
    text = plan(op.kshot(v.languages(spark, FOLDER), 16, 1))
    assert "WindowGroupLimit" in text.split("Exchange")[-1]


def test_gapless_ids_need_no_shuffle(spark):
    assert "Exchange" not in plan(op.dense_row_id(v.texts(spark, FOLDER), ["id"]))


def test_head_slice_reaches_the_scan(spark):
    rows = v.texts(spark, FOLDER).select(F.col("id").alias("row_id"))
    assert "LessThan(doc_id,100)" in plan(op.head_slice(rows, 100))


def test_projections_read_only_their_columns(spark):
    assert "ReadSchema: struct<text:string>" in plan(v.texts(spark, FOLDER).select(snippet(F.col("text"))))
    assert "ReadSchema: struct<embedding:array<float>>" in plan(op.predict(v.logits(spark, FOLDER)).select("pred"))


def test_flattening_computes_the_array_once(spark):
    rows = flattened(v.texts(spark, FOLDER), ["id"], tokens(F.col("text")), "token", "at")
    assert plan(rows).count("regexp_extract_all(") == 1


def test_packing_shuffles_once(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("bk"), F.array(F.lit(1)).alias("input_ids"))
    assert plan(op.pack_blocks(df, 8, "bk")).count("Exchange hashpartitioning") == 1


def test_rank_correlation_shares_its_pair_counts(spark):
    df = v.table(spark, FOLDER, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")
    found = op.spearman(df, "l_extendedprice", "l_quantity", ["l_returnflag"])
    found.collect()
    assert "Reused" in plan(found)


@pytest.mark.parametrize(
    "make",
    [
        lambda s: op.prompt_fill(v.knowledge(s, FOLDER)),
        lambda s: op.macro_f1(op.predict(v.logits(s, FOLDER)), 10),
        lambda s: op.gated_mixture(v.experts(s, FOLDER), v.gate_logits(s, FOLDER)),
    ],
)
def test_no_python_where_expressions_suffice(spark, make):
    text = plan(make(spark))
    assert "Python" not in text and "Pandas" not in text and "ArrowEval" not in text


def test_forgotten_tables_are_gone(spark):
    import os

    from glosswork.plans import forget, written

    table = written(spark.range(5).toDF("x"), "gone")
    again = written(table.select("x"), "kept")
    forget(table)
    assert not os.path.exists(table.scratch_path) and again.count() == 5
