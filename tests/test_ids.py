"""Ids, shuffles, samples and labels against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork.operators.labels import scan_end


def draw(seed, *keys):
    return int(hashlib.md5(":".join(map(str, (seed, *keys))).encode()).hexdigest()[:8], 16)


def rows(spark, n, labels=5, hot=0.5, seed=1):
    """Half of the rows share one label."""
    rng = random.Random(seed)
    data = [(i, "hot" if rng.random() < hot else f"l{rng.randrange(labels)}") for i in range(n)]
    return data, spark.createDataFrame(data, "id bigint, label string").repartition(5)


def shuffled(data, seed):
    return sorted(data, key=lambda r: (draw(seed, r[0]), r[0]))


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("values", [list(range(50)), [3 * i + 7 for i in range(50)], [-5, 2**60, 1, 9, 2**62]])
@pytest.mark.parametrize("bucket", [3, 1000])
def test_dense_ids_of_numbers(spark, values, bucket):
    df = spark.createDataFrame([(v,) for v in values], "k bigint").repartition(4)
    want = sorted((v, i) for i, v in enumerate(sorted(values)))
    assert pairs(op.dense_row_id(df, ["k"], "row_id", bucket), "k", "row_id") == want


@pytest.mark.parametrize("bucket", [4, 1000])
def test_dense_ids_of_text_and_nulls(spark, bucket):
    data = [(None, 1), ("a", None), ("b", 2), ("b", 1), ("é😀", 3), ("z", 0)] + [("k", i) for i in range(20)]
    df = spark.createDataFrame(data, "a string, b int").repartition(3)
    got = op.dense_row_id(df, ["a", "b"], "row_id", bucket).orderBy("row_id").collect()
    want = df.orderBy("a", "b").collect()
    assert [(r.a, r.b) for r in got] == [(r.a, r.b) for r in want]
    assert [r.row_id for r in got] == list(range(len(data)))


def test_dense_ids_of_floats_and_nothing(spark):
    df = spark.createDataFrame([(0.5,), (-1.0,), (None,), (7.25,)], "k double")
    assert [r.k for r in op.dense_row_id(df, ["k"], "i", 2).orderBy("i").collect()] == [None, -1.0, 0.5, 7.25]
    assert op.dense_row_id(df.where("k > 100"), ["k"]).collect() == []


def test_head_slice_follows_python(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    for size in (3, 0, 20, -1, -4, -30):
        assert [r[0] for r in pairs(op.head_slice(df, size), "row_id")] == list(range(10))[:size]
    assert op.head_slice(df, None).count() == 10


@pytest.mark.parametrize("bucket", [7, 1000])
def test_shuffle_is_a_fixed_permutation(spark, bucket):
    data, df = rows(spark, 100)
    want = sorted((r[0], i) for i, r in enumerate(shuffled(data, 9)))
    assert pairs(op.seeded_shuffle(df, 9, rows_per_bucket=bucket), "id", "shuffled") == want
    assert pairs(op.seeded_shuffle(df, 9, rows_per_bucket=bucket, below=11), "id", "shuffled") == [
        w for w in want if w[1] < 11
    ]


@pytest.mark.parametrize("n", [0, 3, 60, 200])
@pytest.mark.parametrize("max_sorted", [1, 1000])
def test_sample(spark, n, max_sorted):
    data, df = rows(spark, 100)
    got = op.sample_n(df, n, 9, rows_per_bucket=8, max_sorted=max_sorted)
    assert [r[0] for r in pairs(got, "id")] == sorted(r[0] for r in shuffled(data, 9)[:n])


def test_shards(spark):
    df = spark.range(11).withColumnRenamed("id", "row_id")
    drop = [[r[0] for r in pairs(op.corpus_shard(df, 4, s, remainder="drop"), "row_id")] for s in range(4)]
    assert drop == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert [r[0] for r in pairs(op.corpus_shard(df, 4, 3), "row_id")] == [6, 7, 8, 9, 10]
    assert [r[0] for r in pairs(op.corpus_shard(df, 4, 3, rebase=True), "row_id")] == [0, 1, 2, 3, 4]
    few = spark.range(3).withColumnRenamed("id", "row_id")
    assert [op.corpus_shard(few, 4, s).count() for s in range(4)] == [0, 0, 0, 3]
    with pytest.raises(ValueError):
        op.corpus_shard(df, 4, 0, remainder="other")


@pytest.mark.parametrize("k", [1, 4, 500])
@pytest.mark.parametrize("pruned", [0, 1000])
def test_kshot_loop(spark, k, pruned):
    data, df = rows(spark, 200)
    taken, want = {}, []
    for i, label in shuffled(data, 3):
        taken[label] = taken.get(label, 0) + 1
        if taken[label] <= k:
            want.append((i, label, taken[label]))
    got = op.kshot(df, k, 3, rows_per_bucket=16, pruned_rank=pruned)
    assert pairs(got, "id", "label", "shot") == sorted(want)


def test_kshot_without_limit(spark):
    _, df = rows(spark, 30)
    assert op.kshot(df, None, 3).count() == 30


@pytest.mark.parametrize("patience", [1, 3, 10, 60, 1000])
@pytest.mark.parametrize("head", [20, 100_000])
def test_early_stop_loop(spark, patience, head):
    data, df = rows(spark, 300, labels=30)
    taken, want, quiet = {}, [], 0
    for i, label in shuffled(data, 5):
        if label not in taken:
            taken[label], quiet = 0, 0
        else:
            quiet += 1
            if quiet == patience:
                break
        if taken[label] < 2:
            taken[label] += 1
            want.append((i, label))
    got = op.kshot_early_stop(df, 2, 5, patience, head_rows=head, rows_per_bucket=50)
    assert pairs(got, "id", "label") == sorted(want)


def test_early_stop_of_nothing(spark):
    _, df = rows(spark, 5)
    assert op.kshot_early_stop(df.where("id < 0"), 2, 5).count() == 0


@pytest.mark.parametrize("patience", [1, 2, 5])
def test_scan_end_loop(spark, patience):
    for seed in range(4):
        places = sorted(random.Random(seed).sample(range(40), 12))
        want = next(
            f + patience for f, g in zip(places, [*places[1:], 10**9]) if g - f > patience
        )
        df = spark.createDataFrame([(p,) for p in places], "p bigint")
        assert scan_end(df, patience, "p") == want


def test_first_seen_over_splits(spark):
    one = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "id bigint, label string")
    two = spark.createDataFrame([(0, "c"), (1, "a"), (2, "B")], "id bigint, label string")
    index = op.label_index_first_seen([one, two])
    assert pairs(index, "label", "label_id", "rows") == [("B", 3, 1), ("a", 1, 2), ("b", 0, 2), ("c", 2, 1)]
    only = op.label_index_first_seen([one])
    assert pairs(op.apply_label_index(two, only), "id", "label_id")[1:] == [(1, 1), (2, None)]
    with pytest.raises(Exception, match="unseen label"):
        op.apply_label_index(two, only, unseen="error").collect()


@pytest.mark.parametrize("limits", [{}, {"max_rows": 1, "hot_rows": 3}])
def test_labels_attach_small_and_hot(spark, limits):
    data, df = rows(spark, 200)
    index = op.label_index_sorted(df)
    names = sorted({label for _, label in data})
    want = sorted((i, names.index(label)) for i, label in data)
    assert pairs(op.apply_label_index(df, index, **limits), "id", "label_id") == want


def test_task_kind(spark):
    ints = spark.createDataFrame([(1, "a")], "label int, t string")
    floats = spark.createDataFrame([(1.5, "a")], "label double, t string")
    assert op.task_kind(ints) == "classification" and op.task_kind(floats) == "regression"
    assert op.task_kind(ints, "stsb") == "regression" and op.task_kind(floats, "cola") == "classification"
    assert op.num_labels(ints) == 1 and op.num_labels(floats) == 1


def test_reconcile_ignores_case_of_the_model(spark):
    model = spark.createDataFrame([("YES", 1), ("No", 0)], "name string, idx bigint")
    data = spark.createDataFrame([("no", 5), ("yes", 6)], "name string, idx bigint")
    assert pairs(op.label_reconcile(model, data), "name", "label_id", "from_model") == [("no", 0, True), ("yes", 1, True)]
    other = spark.createDataFrame([("No", 5), ("yes", 6)], "name string, idx bigint")
    with pytest.warns(UserWarning):
        assert pairs(op.label_reconcile(model, other), "name", "label_id") == [("No", 5), ("yes", 6)]


def test_minibatch_and_drop_last(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x")).repartition(3)
    full = op.minibatch(df, 4, ["x"]).orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows, r.x) for r in full] == [(0, 4, [0, 2, 4, 6]), (1, 4, [8, 10, 12, 14]), (2, 2, [16, 18])]
    assert op.minibatch(df, 4, ["x"], drop_last=True).count() == 2


def test_gather_trim_keeps_the_first(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 5, "b"), (2, 1, "c")], "id int, place int, x string")
    assert pairs(op.gather_trim(df, "id", "place"), "id", "place", "x") == [(1, 0, "a"), (2, 1, "c")]
    assert op.gather_trim(df, "id").count() == 2


def test_zip_shortest(spark):
    a = spark.createDataFrame([(5, "x"), (9, "y"), (7, "z")], "a int, l string")
    b = spark.createDataFrame([("q",), ("p",)], "b string")
    assert pairs(op.zip_shortest(a, b, ["a"], ["b"]), "pos", "a", "b") == [(0, 5, "p"), (1, 7, "q")]
