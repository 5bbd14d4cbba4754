"""Lists that are skipped by a bound give the hits of a full scan."""

import numpy as np
import pytest

from glosswork import operators as op
from glosswork.operators import vector_index
from tests.test_retrieval import vectors


def clustered(seed, clusters, each, width=8, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (centres[:, None, :] + spread * rng.normal(size=(clusters, each, width))).reshape(-1, width)


def rows(hits):
    return sorted((r.query_id, r.rank, r.raw_id, round(r.score, 8)) for r in hits.collect())


def test_lists_are_skipped_and_hold_everything(spark, tmp_path):
    stored, asked = clustered(1, 40, 30), clustered(1, 40, 2, spread=0.05)
    record, queries = vectors(spark, stored, "raw_id"), vectors(spark, asked, "id")
    index = op.build_index(record, str(tmp_path / "index"), lists=40)
    assert sorted(r.raw_id for r in index.lists.collect()) == list(range(len(stored)))
    lists = index.centres.count()
    hits, probes = op.search_with_probes(queries, index, 5)
    assert rows(hits) == rows(op.retrieve_topk(queries, record, 5))
    seen = probes.collect()
    assert len(seen) == len(set(seen)) and len(seen) < 0.5 * lists * len(asked)
    assert rows(op.search_index(queries, op.open_index(spark, str(tmp_path / "index")), 5)) == rows(hits)
    read = index.lists.where("list = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in read


@pytest.mark.parametrize("k", [1, 7, 500])
def test_copies_ties_and_small_cells(spark, tmp_path, k):
    rng = np.random.default_rng(3)
    stored = np.round(rng.normal(size=(300, 4)), 1)
    stored[:100] = stored[0]  # a third of all are copies: one list, many parts
    record, queries = vectors(spark, stored, "raw_id"), vectors(spark, np.vstack([stored[::20], np.zeros((1, 4))]), "id")
    index = op.build_index(record, str(tmp_path / "index"), part_rows=20)
    assert rows(op.search_index(queries, index, k, part_rows=16)) == rows(op.retrieve_topk(queries, record, k))


def test_empty_sides(spark, tmp_path):
    some = vectors(spark, np.ones((3, 2)), "raw_id")
    index = op.build_index(some, str(tmp_path / "a"))
    assert op.search_index(some.withColumnRenamed("raw_id", "id").limit(0), index, 2).count() == 0
    none = op.build_index(some.limit(0), str(tmp_path / "b"))
    assert op.search_index(some.withColumnRenamed("raw_id", "id"), none, 2).count() == 0


def test_second_look_makes_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    stored = rng.normal(size=(400, 16))  # no list can be skipped
    record, queries = vectors(spark, stored, "raw_id"), vectors(spark, stored, "id")
    index = op.build_index(record, str(tmp_path / "index"), lists=20)
    pairs, look = [], vector_index._search_lists
    monkeypatch.setattr(vector_index, "_search_lists", lambda probes, *rest: pairs.append(probes.count()) or look(probes, *rest))
    assert rows(op.search_index(queries, index, 3)) == rows(op.retrieve_topk(queries, record, 3))
    assert sum(pairs) <= vector_index.FIRST_LISTS * len(stored)


def test_blocks_of_queries(spark, tmp_path):
    stored = clustered(5, 20, 10)
    record, queries = vectors(spark, stored, "raw_id"), vectors(spark, stored, "id")
    index = op.build_index(record, str(tmp_path / "index"), lists=20)
    assert rows(op.search_index(queries, index, 3, query_bytes=2000)) == rows(op.retrieve_topk(queries, record, 3))


def spread_out(seed, directions, lengths, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(directions, width))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    return np.vstack([base * (1 + turn / 8) for turn in range(lengths)])


def test_first_look_finds_what_points_the_same_way(spark, tmp_path):
    stored = spread_out(6, 200, 4)  # directions at random, so some centres are single vectors and long
    record, queries = vectors(spark, stored, "raw_id"), vectors(spark, stored, "id")
    index = op.build_index(record, str(tmp_path / "index"), lists=20)
    asked = queries.selectExpr("id AS query_id", "CAST(embedding AS array<double>) AS v")
    probes = vector_index._probes(asked, index.shared(), 2, vector_index.FIRST_LISTS)
    found = vector_index._best(vector_index._search_lists(probes, index, 2, 4096), 2)
    right = op.retrieve_topk(queries, record, 2).select("query_id", "rank", "raw_id")
    assert found.select("query_id", "rank", "raw_id").intersect(right).count() > 0.9 * 2 * len(stored)


@pytest.mark.parametrize("kind", ["random", "copies", "ties", "zeros", "long", "no number"])
def test_lists_by_blocks_leave_out_no_hit(kind):
    stored, asked = spread_out(7, 400, 3), spread_out(8, 150, 2)
    asked[:100] = stored[:100]
    if kind == "copies":
        stored[::3] = stored[0]
    if kind == "ties":
        stored, asked = np.round(3 * stored), np.round(3 * asked)
    if kind == "zeros":
        stored[::5], asked[::7] = 0, 0
    if kind == "long":
        stored, asked = stored * 1e16, asked
    if kind == "no number":
        asked[3] = np.nan
    scores = np.round(asked @ stored.T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(len(stored)), scores.shape), -scores))[:, :3]
    best = np.take_along_axis(scores, order, 1)
    least = np.where(np.arange(len(asked)) % 2, best[:, 2], -np.inf)  # a threshold for every other query
    centres = vector_index._directions(stored[::100][:9] + (kind == "zeros"))
    near = vector_index._nearest(stored, centres)
    numbers = np.unique(near)
    compared = vector_index._Compared(asked, least, 3, np.linalg.qr(np.random.default_rng(0).normal(size=(16, 5)))[0])
    compared.add([(n, stored[near == n], np.flatnonzero(near == n)) for n in numbers], centres[numbers])
    got = compared.held.hits(np.arange(len(asked))).to_pydict()
    right = np.isfinite(asked).all(axis=1)
    assert [(q, i) for q, i in zip(got["query_id"], got["raw_id"]) if right[q]] == [(q, i) for q in np.flatnonzero(right) for i in order[q]]


def test_most_pairs_are_compared_by_pieces_or_not_at_all(monkeypatch):
    stored = spread_out(9, 3000, 4, width=48)
    compared = vector_index._Compared(stored, np.round(1.25 * np.linalg.norm(stored, axis=1), 9), 2, np.eye(48)[:, :22])
    centres = vector_index._directions(stored[:40])
    near, whole, pieces = vector_index._nearest(stored, centres), [], []
    pairs, block, some = compared.held.add_pairs, compared.held.add_block, compared._add_near
    monkeypatch.setattr(compared.held, "add_pairs", lambda part, stored, names, who, which: whole.append(len(who)) or pairs(part, stored, names, who, which))
    monkeypatch.setattr(compared.held, "add_block", lambda stored, names, rows: whole.append(len(stored) * len(rows)) or block(stored, names, rows))
    monkeypatch.setattr(compared, "_add_near", lambda stored, names, own, queries, wanted, *rest: pieces.append(len(stored) * len(wanted)) or some(stored, names, own, queries, wanted, *rest))
    for n in range(40):
        compared.add([(n, stored[near == n], np.flatnonzero(near == n))], centres[n : n + 1])
    assert sum(pieces) < 0.6 * len(stored) ** 2 and sum(whole) < 0.02 * len(stored) ** 2
    assert compared.held.ids[:, 0].tolist() == [i % 3000 + 9000 for i in range(len(stored))]
