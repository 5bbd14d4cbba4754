"""Losses and metrics against plain arithmetic, edge cases included."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork import operators as op


def first(df):
    return df.first()[0]


def average_rank(values):
    order = sorted(values)
    return [(order.index(v) + 1 + order.index(v) + order.count(v)) / 2 for v in values]


@pytest.mark.parametrize("bucket", [5, 1_000_000])
@pytest.mark.parametrize("hot", [3, 1_000_000])
def test_spearman_with_ties_in_every_plan(spark, bucket, hot):
    rng = random.Random(4)
    data = [(g, rng.randrange(6) if rng.random() < 0.5 else rng.random() * 6, rng.randrange(8)) for g in "aab" for _ in range(60)]
    data += [(None, float(i), i % 3) for i in range(9)]
    df = spark.createDataFrame([(g, float(x), float(y)) for g, x, y in data], "g string, x double, y double")
    got = {r.g: r.spearman for r in op.spearman(df, "x", "y", ["g"], bucket, hot).collect()}
    for g in ("a", "b", None):
        xs, ys = zip(*[(x, y) for h, x, y in data if h == g])
        want = np.corrcoef(average_rank(xs), average_rank(ys))[0, 1]
        assert math.isclose(got[g], want, rel_tol=1e-9)


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert first(op.spearman(df, "x", "y")) is None and first(op.pearson(df, "x", "y")) is None


def test_predict_ties_to_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([-1.0, -2.0],)], "logits array<double>")
    assert [r.pred for r in op.predict(df).collect()] == [1, 0]
    assert [r.pred for r in op.predict(df, "regression").collect()] == [1.0, -1.0]


def test_softmax_sums_to_one_even_when_large(spark):
    df = spark.createDataFrame([([1000.0, 1001.0],), ([0.0],)], "logits array<double>")
    for r in op.softmax(op.softmax(df), name="logs", log=True).collect():
        assert math.isclose(sum(r.probs), 1) and np.allclose(np.exp(r.logs), r.probs)


def f1_loop(pairs, n, absent):
    scores = []
    for c in range(n):
        tp = sum(p == c == y for p, y in pairs)
        wrong = sum((p == c) != (y == c) for p, y in pairs)
        if tp + wrong == 0 and absent == "exclude":
            continue
        scores.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
    return sum(scores) / len(scores)


@pytest.mark.parametrize("absent", ["exclude", "zero"])
def test_macro_f1(spark, absent):
    rng = random.Random(0)
    pairs = [(rng.randrange(4), rng.randrange(3)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "pred int, label int")
    assert math.isclose(first(op.macro_f1(df, 6, absent)), f1_loop(pairs, 6, absent))
    assert math.isclose(first(op.accuracy(df)), sum(p == y for p, y in pairs) / 50)
    with pytest.raises(ValueError):
        op.macro_f1(df, 6, "other")


def test_named_metrics(spark):
    pairs = [(1, 1)] * 5 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 7
    df = spark.createDataFrame(pairs, "pred int, label int")
    values = lambda task: {r.metric: r.value for r in op.glue_metric(df, task).collect()}
    want = (5 * 7 - 2 * 3) / math.sqrt(7 * 8 * 9 * 10)
    assert math.isclose(values("cola")["matthews_correlation"], want)
    assert math.isclose(values("qqp")["f1"], 10 / 15) and math.isclose(values("qqp")["accuracy"], 12 / 17)
    assert list(values("rte")) == ["accuracy"] and set(values("stsb")) == {"pearson", "spearmanr"}
    same = spark.createDataFrame([(0, 0)], "pred int, label int")
    assert op.glue_metric(same, "cola").first().value == 0.0


def test_losses(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5], 2), ([40.0, 0.0, 0.0], -100)], "logits array<double>, label int")
    x = np.array([1.0, -2.0, 0.5])
    rows = op.loss_from_logits(df).collect()
    assert math.isclose(rows[0].loss, math.log(np.exp(x).sum()) - 0.5) and rows[1].loss is None
    multi = df.withColumn("label", F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0)))
    p, y = 1 / (1 + np.exp(-x)), np.array([1, 0, 1])
    want = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert math.isclose(op.loss_from_logits(multi, "multi").first().loss, want)
    assert op.loss_from_logits(df, "regression").first().loss == 1.0
    assert op.mean_loss(op.loss_from_logits(df).withColumn("g", F.lit(1)), ["g"]).first().loss == rows[0].loss


@pytest.mark.parametrize("hot", [2, 1_000_000])
def test_example_weights(spark, hot):
    rng = random.Random(2)
    data = [(b, i, rng.random() * 800, rng.random()) for b, n in ((0, 30), (1, 1), (2, 4)) for i in range(n)]
    df = spark.createDataFrame(data, "batch int, slot int, w double, loss double")
    got = {r.batch: r.loss for r in op.example_reweight(df, hot_rows=hot).collect()}
    shares = {(r.batch, r.slot): r.share for r in op.example_weights(df, hot_rows=hot).collect()}
    for b in (0, 1, 2):
        w = np.array([d[2] for d in data if d[0] == b])
        e = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        assert math.isclose(got[b], float((e * [d[3] for d in data if d[0] == b]).sum()), rel_tol=1e-9)
        assert np.allclose([shares[b, d[1]] for d in data if d[0] == b], e)


def test_cloze(spark):
    data = [
        (1, 0, True, 5, 5, -0.1),
        (1, 0, True, 0, 0, -9.0),  # a right id of 0 has no say in the score
        (1, 0, False, 5, 6, -7.0),
        (2, 0, True, 5, 6, -0.3),
        (3, 1, False, 5, 6, -0.3),  # nothing masked
    ]
    df = spark.createDataFrame(data, "id int, batch int, masked boolean, correct_id int, pred_id int, logp double")
    assert math.isclose(first(op.cloze_exact_match(df)), 66.67)
    want = (round(math.exp(-0.1) * 100, 2) + round(math.exp(-0.3) * 100, 2)) / 2
    assert abs(first(op.cloze_match_score(df)) - want) < 0.006
    losses = {r.batch: (r.loss, r.examples) for r in op.cloze_loss(df).collect()}
    assert math.isclose(losses[0][0], ((0.1 + 9.0) / 2 + 0.3) / 2) and losses[1] == (None, 0)


def test_layer_gap_and_total(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], [0.0, 0.0], True), (0, [1.0, 1.0], [1.0, 1.0], False), (1, [3.0], [0.0], True)], "layer int, a array<double>, b array<double>, m boolean")
    found = op.layer_mse(df)
    assert {r.layer: r.mse for r in found.collect()} == {0: 1.25, 1: 9.0}
    assert first(op.total_layer_mse(found)) == 5.125
    assert {r.layer: r.mse for r in op.layer_mse(df, mask="m").collect()} == {0: 2.5, 1: 9.0}
    both = spark.createDataFrame([(2.0, 3.0)], "knowledge_loss double, sample_loss double")
    total = lambda **parts: op.total_loss(both, **parts).first().total_loss
    assert (total(), total(sample=None), total(knowledge=None), total(factor=2.0)) == (4.0, 1.0, 3.0, 7.0)


def test_mixture(spark):
    experts = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 0, [0.0, 4.0])], "id int, expert int, v array<double>")
    gates = spark.createDataFrame([(0, [0.0, math.log(3.0)])], "id int, g array<double>")
    assert np.allclose(op.gated_mixture(experts, gates).first().mixed, [0.75, 1.0])
    assert op.gated_mixture(experts, None).first().mixed == [0.0, 4.0]


def test_gate_stats(spark):
    df = spark.createDataFrame([("t", 0, 7, 0, 0.2), ("t", 0, 11, 0, 0.6), ("t", 0, 7, 1, 0.9)], "split string, epoch int, layer int, expert int, w double")
    r = op.gate_stats(df).first()
    assert math.isclose(r["mean"], 0.4) and math.isclose(r["std"], 0.2) and r["rows"] == 2


def test_epoch_reports(spark):
    data = [("r", e, m, v) for e, m, v in [(0, "f1", -0.5), (1, "f1", 0.4), (2, "f1", 0.4), (3, "f1", 0.1), (0, "t", 9.0), (1, "t", 7.0), (2, "t", 8.0), (4, "t", 1.0)]]
    points = spark.createDataFrame(data, "run string, epoch int, metric string, value double")
    epochs = op.epoch_mean(points.unionAll(points))
    best = lambda floor: [r.best for r in op.best_so_far(epochs, floor).where("metric = 'f1'").orderBy("epoch").collect()]
    assert best(0.0) == [0.0, 0.4, 0.4, 0.4] and best(None) == [-0.5, 0.4, 0.4, 0.4]
    at = op.metric_at_best(epochs, "f1", "t").collect()
    assert [(r.run, r.epoch, r.valid, r.test) for r in at] == [("r", 1, 0.4, 7.0)]


def test_hot_values_keep_their_rows(spark):
    """A third of the rows share one value; every plan counts them all."""
    data = [(float(i % 3 == 0) * 5.0 or float(i), float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(data, "x double, y double")
    ranks = op.average_ranks(df, "x", [], "rank", rows_per_bucket=4)
    want = dict(zip((x for x, _ in data), average_rank([x for x, _ in data])))
    assert {r.x: r["rank"] for r in ranks.collect()} == want
    assert {r.x: r["rows"] for r in ranks.collect()} == dict(Counter(x for x, _ in data))


def test_ranks_of_a_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(12)] + [("a", 1.0)], "g string, x double")
    ranks = op.average_ranks(df, "x", ["g"], "rank", rows_per_bucket=3)
    got = sorted((r.g or "", r.x, r["rank"]) for r in ranks.collect())
    assert got == [("", float(i), i + 1.0) for i in range(12)] + [("a", 1.0, 1.0)]
