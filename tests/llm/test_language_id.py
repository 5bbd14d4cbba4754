import zlib

import numpy as np
from pyspark.sql import functions as F

from glosswork.llm.catalog import QUERIES
from glosswork.llm.language_id import BLOCK_BYTES, BUCKETS, UNKNOWN, Model, _grams, learn, mixture, predict, trigrams


def test_query_on_held_out_documents(spark, folder):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held)


SAID = {"aa": "bada gadu lamo nimo ", "bb": "xirt quep zovk wyst ", "cc": "ütöl ßräm ñoço éçal "}


def model(spark):
    rows = [(k, v * 30) for k, v in SAID.items()] + [(None, "qqq www"), ("aa", None)]
    return learn(spark.createDataFrame(rows, "lang string, text string"))


def test_mixtures(spark):
    texts = [SAID["aa"] * 9, SAID["aa"] * 20 + SAID["cc"] * 20, None, "", "123 !?", "7é", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = predict(df.withColumns({"score": F.lit("x"), "lang": F.lit("bb")}), model(spark)).orderBy("doc_id").collect()
    assert rows[0].lang_pred == "aa" and rows[0].score > 0.99 and len(rows[0].mixture) == 1
    assert set(rows[1].mixture) == {"aa", "cc"} and all(0.35 < x < 0.65 for x in rows[1].mixture.values())
    assert [(r.lang_pred, r.score) for r in rows[2:5]] == [(UNKNOWN, 0.0)] * 3
    assert all(r.lang_pred in SAID and 0 < r.score <= 1 for r in rows[5:])


def test_nothing_to_learn_from_and_empty_table(spark):
    none = learn(spark.createDataFrame([(None, "text")], "lang string, text string"))
    df = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert predict(df, none).first().lang_pred == UNKNOWN
    assert predict(df.limit(0), model(spark)).count() == 0


def test_likelihood_does_not_fall_and_proportions_sum_to_one():
    draw = np.random.default_rng(3)
    given = Model(["a", "b", "c"], draw.dirichlet(np.full(BUCKETS, 0.05) + 1e-3, 3) + 1e-12)
    for _ in range(20):
        found, times = trigrams(np.frombuffer(bytes(draw.integers(97, 122, 400, np.uint8)), np.uint8))
        assert abs(sum(mixture(given, found, times).values()) - 1) < 1e-6


def test_long_texts_in_blocks_are_the_same():
    raw = np.random.default_rng(1).integers(32, 127, 2 * BLOCK_BYTES + 77).astype(np.uint8)
    found, times = trigrams(raw)
    whole = np.bincount(_grams(raw), minlength=BUCKETS)
    assert (whole[found] == times).all() and whole.sum() == times.sum()
