import hashlib
import random
from collections import defaultdict

import pytest

from glosswork.llm import catalog, prefix_trie
from glosswork.llm.prefix_trie import SpillingQueue, conversation_trie
from tests.compare import connect, difference

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: tuple(t[2:] for t in sorted(ts)) for c, ts in turns.items()}
    members = defaultdict(list)
    for c, ts in said.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if said[c] == node))
        up = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(ids), len(node), up, len(ids), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def family(seed, n=120):
    """Conversations that share openings of every length, copies and one long thread with side branches."""
    draw = random.Random(seed)
    long = [("user" if i % 2 else "assistant", draw.choice(["a", "bb", "ccc"]) * 3) for i in range(60)]
    rows = []
    for conv in range(n):
        kind = draw.random()
        if kind < 0.4:
            said = long[: draw.randint(0, 60)] + [("user", str(draw.randrange(4)))] * draw.randint(0, 2)
        elif kind < 0.6:
            said = long[:7]
        else:
            said = [("user", str(draw.randrange(3))) for _ in range(draw.randint(1, 6))]
        rows += [(conv, t, role, text) for t, (role, text) in enumerate(said)]
    return rows


@pytest.mark.parametrize(("shard", "chunk"), [(1000, 4096), (3, 5)])
def test_against_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    monkeypatch.setattr(prefix_trie, "SORT_ROWS", 200)
    monkeypatch.setattr(prefix_trie.prefix_trie, "__defaults__", (shard,))
    rows = family(shard)
    got = conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "user", "b"), (1, 2, None, None), (1, 2, "user", "é"), (1, 2, "user", "é"), (None, 1, "user", "x"), (-5, 0, "user", "b"), (-5, 1, "", "")]
    rows += [(7, 5, "user", "long " * 100_000), (8, 1, "user", "long " * 100_000)]
    docs = spark.createDataFrame([(*r, 3, "z") for r in rows], SCHEMA + ", place int, member string")
    got = conversation_trie(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    assert conversation_trie(docs.limit(0)).count() == 0


def test_queue_spills_and_keeps_order():
    draw, queue, out = random.Random(1), SpillingQueue(limit=10, block=3), []
    items = [(draw.randrange(50), i) for i in range(1000)]
    for item in items[:500]:
        queue.push(item)
    for _ in range(200):
        out.append(queue.pop())
    for item in items[500:]:
        queue.push((item[0] + 100, item[1]))
    while queue.peek() is not None:
        out.append(queue.pop())
    assert queue.spilled > 50 and len(out) == 1000 and out == sorted(out)


def test_query_equals_sql(spark, folder):
    name = "op11_prefix_trie"
    assert difference(spark, connect(folder), catalog.QUERIES[name], catalog.ORACLE[name], folder) is None


def test_query_with_absent_bases_and_idle_conversations(spark, tmp_path):
    rows = [(c, t, "user", f"{c % 3} {t}") for c in [*range(100, 130), *range(230, 260), 300, 301, -40] for t in range(c % 4 + 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op11_prefix_trie"
    assert difference(spark, db, catalog.QUERIES[name], catalog.ORACLE[name], str(tmp_path)) is None
