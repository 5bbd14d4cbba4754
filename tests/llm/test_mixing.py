import pytest
from pyspark.sql import functions as F

from glosswork.llm import catalog, mixing
from glosswork.llm.mixing import mix, mixed_texts, quality_weight, targets
from tests.compare import connect, difference

SCHEMA = "doc_id bigint, source string, text string"


def waterfill(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, what is above a bound being shared out again among the others until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        left, parts = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in sizes if s not in fixed)
        above = {s: most * sizes[s] for s in sizes if s not in fixed and weight[s] * left > most * sizes[s] * parts}
        if not above:
            return {s: fixed.get(s, weight[s] * left / parts if parts else 0) for s in sizes}
        fixed |= above


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 500}, {"a": 0, "b": 7}, {None: 9}, {chr(97 + i): 3**i for i in range(9)}, {"z": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in targets(rows).collect()}
    assert got == pytest.approx(waterfill(sizes))


def sample(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None, " ".join(f"w{i}x{j}" for j in range(i % 90))) for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA)


def test_budgets_epochs_and_slices(spark, monkeypatch):
    documents = sample(spark)
    rows = mix(documents).collect()
    monkeypatch.setattr(mixing.plan, "__defaults__", (mixing.WEIGHTS, mixing.MOST, 50))
    assert sorted(map(str, mix(documents.repartition(7)).collect())) == sorted(map(str, rows))
    sums = {}
    for r in rows:
        assert r.taken == r.epochs * r.size + r.part and 0 <= r.part <= r.size and r.taken <= 3 * r.size
        sums.setdefault(r.source, []).append(r)
    wanted = waterfill({s: sum(r.size for r in own) for s, own in sums.items()})
    for source, own in sums.items():
        assert abs(sum(r.taken for r in own) - wanted[source]) <= 0.5
        assert sum(0 < r.part < r.size for r in own) <= 1  # only one document is cut


def test_texts_follow_the_plan(spark):
    documents = sample(spark).withColumn("epoch", F.lit("x")).withColumn("key", F.lit(1))
    planned = {r.doc_id: r for r in mix(documents).collect()}
    got = mixed_texts(documents)
    assert got.columns == ["doc_id", "source", "text", "key", "epoch", "words_taken"]
    words, seen = {}, set()
    for r in got.collect():
        assert len(r.text.split()) == r.words_taken and (r.doc_id, r.epoch) not in seen
        seen.add((r.doc_id, r.epoch))
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words_taken
    assert words == {d: r.taken for d, r in planned.items() if r.taken}


def test_better_documents_come_first(spark):
    # A source that gets too little for all of it takes nearly all of its heavier half first.
    rows = [(i, "b", "word " * 20 + ("1" if i % 2 else "#") * (0 if i % 2 else 60)) for i in range(2000)] + [(-1, "a", "x " * 60_000)]
    documents = spark.createDataFrame(rows, SCHEMA)
    assert {r.w for r in documents.where("doc_id >= 0").select(quality_weight(F.col("text")).alias("w")).distinct().collect()} == {5, 100}
    got = [r for r in mix(documents).collect() if r.source == "b" and r.part]
    assert sum(r.doc_id % 2 for r in got) > 980 and len(got) < 1500


def test_odd_rows(spark):
    rows = [(1, "s", "a b c"), (1, "s", "a b c"), (None, None, None), (3, None, "x " * 200_000), (4, "", ""), (None, "s", " \t")]
    documents = spark.createDataFrame([(*r, 1.5, None) for r in rows], SCHEMA + ", size double, target string")
    got = mix(documents).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 3, 3, 200_000]
    assert sum(r.taken for r in got) == sum(round(t) for t in {r.source: r.target for r in got}.values())
    assert mix(documents, weight=F.lit(None)).count() == 6
    assert mix(documents.limit(0)).count() == 0 and mixed_texts(documents.limit(0)).count() == 0


def test_query_equals_sql(spark, folder):
    name = "op12_source_mix"
    assert difference(spark, connect(folder), catalog.QUERIES[name], catalog.ORACLE[name], folder) is None
