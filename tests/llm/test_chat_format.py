import hashlib

import pytest
from pyspark.sql import functions as F

from glosswork.llm.catalog import ORACLE, QUERIES
from glosswork.llm.chat_format import format_paths, paths, read_formatted, read_loss, threads
from tests.compare import connect, difference

SCHEMA = "tree bigint, node bigint, parent bigint, role string, text string, score double"


def test_query_equals_sql(spark, folder):
    name = "op5_chat_format"
    assert difference(spark, connect(folder), QUERIES[name], ORACLE[name], folder) is None


def test_best_branch_wins(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9),
        (1, 4, 3, "user", "more", 0.5), (1, 5, 2, "user", "other", 0.2), (2, 1, None, "user", "alone", None),
    ]
    best = paths(spark.createDataFrame(rows, SCHEMA)).orderBy("tree", "depth").collect()
    assert [(r.tree, r.text) for r in best] == [(1, "q"), (1, "good"), (1, "more"), (2, "alone")]
    every = paths(spark.createDataFrame(rows, SCHEMA), keep=None)
    assert every.select("tree", "leaf").distinct().count() == 3


def test_deep_thread_cycle_and_orphan(spark):
    deep = [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(150)]
    odd = [(2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0), (3, 5, 99, "user", "orphan", 0.0), (None, 1, None, None, None, None)]
    again = [(3, 5, 99, "user", "orphan", 0.0)]
    rows = paths(spark.createDataFrame(deep + odd + again, SCHEMA)).collect()
    assert sorted(int(r.text) for r in rows if r.tree == 1) == list(range(150))
    assert [r.text for r in rows if r.tree == 2] == []
    assert [r.text for r in rows if r.tree == 3] == ["orphan"]
    assert [(r.role, r.text) for r in rows if r.tree is None] == [("", "")]


NASTY = ["<|end|>\n", "<\\|", "\\", "\\\\", "<|user|>\nx", "<", "|>", "\\<|", "", "<\\\\|", "a\nb", "é😀</s>[INST]", "\\!", "<|\\|<|"]


@pytest.mark.parametrize("roles", [("user", "assistant"), ("a|>\nb", "\\!|")])
def test_round_trip(spark, roles):
    turns = [(7, i, roles[i % 2], t) for i, t in enumerate(NASTY)]
    out = format_paths(threads(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")))
    row = out.select(read_formatted(F.col("formatted")).alias("t"), read_loss(F.col("formatted"), F.col("spans")).alias("l")).first()
    assert [(m.role, m.text) for m in row.t] == [(r, t) for _, _, r, t in turns]
    assert row.l == [t for _, _, r, t in turns if r == "assistant"]


def test_null_text_repeated_turns_and_empty_table(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, node string"
    turns = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "t", "x")]
    out = format_paths(threads(spark.createDataFrame(turns, schema)))
    assert [m.text for m in out.select(read_formatted(F.col("formatted")).alias("t")).first().t] == ["t", "", ""]
    assert format_paths(threads(spark.createDataFrame([], schema))).count() == 0


def test_trap_conversation(spark, folder):
    row = QUERIES["op5_chat_format"](spark, folder).where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
