"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from glosswork.catalog import oracle, queries
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Queries of other parts of the package have tests of their own.
QUERIES, ORACLE = queries.QUERIES, oracle.ORACLE


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.filterwarnings("ignore:the model's labels")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, QUERIES[name], ORACLE[name], FOLDER) is None


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["lang", "masked_tokens", "prompts"]
    assert found.count() > 0


@pytest.mark.filterwarnings("ignore:the model's labels")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_best", "stream_metric_rollup", "stream_prepare", "stream_replay"}))
def test_no_pairs_of_everything(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
