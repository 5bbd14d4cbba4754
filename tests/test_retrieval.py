"""Retrieval against brute force, on every physical path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork.operators import retrieval


def vectors(spark, matrix, key):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>").repartition(4)


def brute(asked, stored, k):
    scores = np.round(asked.astype(np.float32).astype(float) @ stored.astype(np.float32).astype(float).T, 9)
    found = []
    for q, row in enumerate(scores):
        order = sorted(range(len(row)), key=lambda i: (-row[i], i))[:k]
        found += [(q, rank + 1, i) for rank, i in enumerate(order)]
    return found


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize(
    "limits", [{}, {"query_bytes": 0, "query_block": 4}, {"query_bytes": 0}]
)
def test_topk_is_exact(spark, k, limits):
    rng = np.random.default_rng(k)
    asked, stored = rng.normal(size=(9, 6)), rng.normal(size=(30, 6))
    stored[10:20] = stored[0]  # a third of the record ties
    hits = op.retrieve_topk(vectors(spark, asked, "id"), vectors(spark, stored, "raw_id"), k, **limits)
    got = sorted((r.query_id, r.rank, r.raw_id) for r in hits.collect())
    assert got == sorted(brute(asked, stored, k))


def test_many_queries_read_the_record_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    both = rng.normal(size=(60, 6))
    scans, scan = [], retrieval._scan_with_queries
    monkeypatch.setattr(retrieval, "_scan_with_queries", lambda *args: scans.append(1) or scan(*args))
    hits = op.retrieve_topk(vectors(spark, both, "id"), vectors(spark, both, "raw_id"), 2, query_bytes=0, query_block=30)
    assert sorted((r.query_id, r.rank, r.raw_id) for r in hits.collect()) == sorted(brute(both, both, 2)) and not scans


def test_small_score_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 10)
    rng = np.random.default_rng(0)
    asked, stored = rng.normal(size=(7, 3)), rng.normal(size=(20, 3))
    scores, ids = retrieval._score(asked, stored, np.arange(20), 2)
    want = np.sort(np.round(asked @ stored.T, 9), axis=1)[:, ::-1][:, :2]
    assert np.allclose(scores, want)


def held(asked, stored, ids, k, floor=None):
    kept = retrieval._Held(asked, k, floor)
    for at in range(0, len(stored), 700):
        kept.add(stored[at : at + 700], ids[at : at + 700])
    return kept.hits(np.arange(len(asked))).to_pydict()


@pytest.mark.parametrize("kind", ["random", "copies", "ties", "long", "short"])
def test_single_precision_leaves_out_no_hit(kind):
    rng = np.random.default_rng(7)
    stored, asked = rng.normal(size=(3000, 12)), rng.normal(size=(600, 12))
    if kind == "copies":
        stored[::3] = stored[0]
    if kind == "ties":
        stored, asked = np.round(stored), np.round(asked)
    stored = stored * {"long": 1e16, "short": 1e-9}.get(kind, 1.0)
    ids = rng.permutation(3000)
    scores = np.round(asked @ stored.T, 9)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :4]
    got = held(asked, stored, ids, 4)
    assert got["raw_id"] == ids[order].ravel().tolist()
    assert np.allclose(got["score"], np.take_along_axis(scores, order, 1).ravel(), rtol=1e-9, atol=1.1e-9)
    floor = np.take_along_axis(scores, order, 1)[:, 1]
    reached = held(asked, stored, ids, 4, floor)
    assert {(q, i) for q, i in zip(reached["query_id"], reached["raw_id"])} >= {(q, i) for q in range(600) for i in ids[order[q, :1]]}


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng = np.random.default_rng(8)
    cells, whole = [], retrieval._score
    monkeypatch.setattr(retrieval, "_score", lambda asked, stored, *rest: cells.append(len(asked) * len(stored)) or whole(asked, stored, *rest))
    held(rng.normal(size=(500, 16)), rng.normal(size=(7000, 16)), np.arange(7000), 2)
    assert sum(cells) < 0.1 * 500 * 7000


def test_topk_of_nothing(spark):
    some, none = vectors(spark, np.ones((2, 3)), "id"), vectors(spark, np.ones((1, 3)), "raw_id").where("raw_id < 0")
    assert op.retrieve_topk(some, none, 3).count() == 0
    assert op.retrieve_topk(some.where("id < 0"), vectors(spark, np.ones((2, 3)), "raw_id"), 3).count() == 0


@pytest.mark.parametrize("hot", [2, 1_000_000])
def test_fetch_keeps_repeats_and_misses(spark, hot):
    hits = spark.createDataFrame([(q, 1, 7) for q in range(10)] + [(0, 2, 8), (1, 2, 99)], "query_id int, rank int, raw_id int")
    corpus = spark.createDataFrame([(7, "seven"), (8, "eight"), (9, "nine")], "raw_id int, text string")
    got = sorted((r.query_id, r.rank, r.text or "") for r in op.fetch_docs(hits, corpus, hot_rows=hot).collect())
    assert got == sorted([(q, 1, "seven") for q in range(10)] + [(0, 2, "eight"), (1, 2, "")])


def test_augment(spark):
    texts = spark.createDataFrame([(0, "zero"), (1, "one")], "id bigint, text string")
    hits = spark.createDataFrame([(0, 2, 5), (0, 1, 6)], "query_id bigint, rank bigint, raw_id bigint")
    corpus = spark.createDataFrame([(5, "a.b.c.d"), (6, "x")], "raw_id bigint, text string")
    got = {r.id: r.augmented for r in op.retrieval_augment(texts, hits, corpus).collect()}
    assert got == {0: "x</s>a b c</s>zero", 1: "one"}


def test_hashed_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([(0, "a b a"), (1, ""), (2, "b , c d e f")], "raw_id bigint, text string")
    got = {r.raw_id: r.embedding for r in op.embed_corpus(df, dims=8).collect()}
    assert set(got) == {0, 1, 2} and all(len(v) == 8 for v in got.values())
    assert sum(got[1]) == 0 and math.isclose(sum(x * x for x in got[2]), 1)


class Loader:
    def load(self):
        return lambda texts: np.array([[len(t), 1.0] for t in texts])


@pytest.mark.parametrize("encoder", [Loader(), Loader().load()])
def test_other_encoder(spark, encoder):
    df = spark.createDataFrame([(0, "abc"), (1, "")], "raw_id int, text string")
    assert {r.raw_id: r.embedding for r in op.embed_corpus(df, encoder).collect()} == {0: [3, 1], 1: [0, 1]}


@pytest.mark.parametrize(
    "name, act",
    [
        ("identity", lambda x: x),
        ("relu", lambda x: max(x, 0.0)),
        ("tanh", math.tanh),
        ("gelu", lambda x: x * 0.5 * (1 + math.erf(x / math.sqrt(2)))),
    ],
)
def test_dense_layer(spark, name, act):
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(20, 4)).astype(np.float32), rng.normal(size=(4, 3)), rng.normal(size=3)
    got = {r.id: r.output for r in op.dense_layer(vectors(spark, x, "id"), w, b, name).collect()}
    for i in range(20):
        assert np.allclose(got[i], [act(v) for v in x[i].astype(float) @ w + b])
    moved = op.project_queries(vectors(spark, x, "id"), w, b)
    assert moved.columns == ["id", "embedding"]


def test_replay_covers_every_hit(spark):
    rng = np.random.default_rng(2)
    domain = vectors(spark, rng.normal(size=(6, 3)), "id").withColumn("bk", F.col("id") % 2)
    corpus = spark.createDataFrame([(i, list(range(i + 1))) for i in range(8)], "raw_id bigint, input_ids array<int>")
    found = op.retrieval_replay(domain, vectors(spark, rng.normal(size=(8, 3)), "raw_id"), corpus, 2, 10)
    assert found.count() == 12 and found.select("item").distinct().count() == 12


def test_replay_needs_lengths_only(spark, monkeypatch):
    rng = np.random.default_rng(2)
    domain = vectors(spark, rng.normal(size=(6, 3)), "id").withColumn("bk", F.col("id") % 2)
    corpus = spark.createDataFrame([(i, [f"word{i}"] * (i + 1)) for i in range(8)], "raw_id bigint, input_ids array<string>")
    fetched, fetch = [], retrieval.fetch_docs
    monkeypatch.setattr(retrieval, "fetch_docs", lambda hits, docs: fetched.append(docs.dtypes) or fetch(hits, docs))
    found = op.retrieval_replay(domain, vectors(spark, rng.normal(size=(8, 3)), "raw_id"), corpus, 2, 10)
    assert found.count() == 12 and fetched == [[("raw_id", "bigint"), ("_size", "int")]]
