import zlib

import numpy as np
from pyspark.sql import functions as F

from glosswork.llm.catalog import QUERIES
from glosswork.llm.quality_model import FEATURES, fit, learn, scored, statistics, with_features
from glosswork.llm.shingles import WordHasher


def test_query_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op10_quality_model"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.93 * len(held)


def walk(forest, row):
    total = forest.base
    for at in forest.roots:
        while forest.feature[at] >= 0:
            at = forest.left[at] + (row[forest.feature[at]] > forest.cut[at])
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk():
    draw = np.random.default_rng(7)
    x = draw.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = fit(x, y)
    scores = forest.score(x)
    assert np.abs(scores - [walk(forest, r) for r in x]).max() < 1e-12
    assert ((scores > 0.5) == y).mean() > 0.97


def test_labels_of_one_kind_and_none():
    x = np.zeros((4, 3))
    assert np.allclose(fit(x, np.ones(4)).score(x), 0.999, atol=2e-3)
    assert np.allclose(fit(np.zeros((0, 3)), np.zeros(0)).score(x), 0.5)


def test_odd_texts_and_repeats(spark):
    texts = [None, "", "\n\n", "a", "é" * 10, "word " * 5000, "A!! B!!\nA!! B!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"features": F.lit(1), "score": F.lit(2)})
    rows = with_features(df)
    assert all(len(r.features) == len(FEATURES) and np.isfinite(r.features).all() for r in rows.collect())
    labels = spark.createDataFrame([(0, 1), (3, 0), (3, None), (99, 1), (5, 1), (5, 1)], "doc_id bigint, quality int")
    told = scored(rows, learn(rows, labels))
    assert told.count() == len(texts) and told.where("score < 0 or score > 1").count() == 0
    assert scored(rows.limit(0), learn(rows, labels.limit(0))).count() == 0


def test_sample_is_bounded(spark):
    texts = [(i, f"text number {i} " * (1 + i % 7)) for i in range(400)]
    rows = with_features(spark.createDataFrame(texts, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, quality int")
    seen = []
    import glosswork.llm.quality_model as module

    whole, module.fit = module.fit, lambda x, y: seen.append(len(y)) or whole(x, y)
    try:
        learn(rows, labels, max_rows=100)
    finally:
        module.fit = whole
    assert 50 <= seen[0] <= 200


def test_statistics_see_what_they_name():
    one = dict(zip(FEATURES, statistics(np.frombuffer(b"A b!! c | 12\nA b!! c | 12", np.uint8), WordHasher())))
    assert one["bars"] == 2 / 10 and one["marks"] == 4 / 10 and one["digits"] == 4 / 10 and one["capitals"] == 2 / 10
    assert one["repeated_lines"] == 0.5 and one["distinct_words"] == 0.5
