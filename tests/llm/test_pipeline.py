from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from glosswork.llm.secret_scan import REDACTED
from tests.llm.test_near_dedup import brute
from tests.llm.test_secret_scan import base


def test_stages_on_the_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "secret_scan", "packing"]
    stages = dict(pipeline.STAGES)

    told = stages["language_id"](spark, docs, folder)
    assert told.columns == docs.columns
    assert {r.doc_id for r in told.collect()} == {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}

    single = stages["near_dedup"](spark, docs, folder)
    assert single.columns == docs.columns
    wanted = {d for d, _, component in brute([(d, r.text) for d, r in rows.items()], 5, 80) if d == component}
    assert {r.doc_id for r in single.collect()} == wanted and len(wanted) < len(rows)

    clean = stages["decontaminate"](spark, docs, folder)
    assert clean.columns == docs.columns
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    assert all(d not in left for d, r in rows.items() if any(i in (r.text or "") for i in items if i))
    assert 0 < len(rows) - len(left) < 0.1 * len(rows)

    masked = {r.doc_id: r for r in stages["secret_scan"](spark, docs, folder).collect()}
    assert set(masked) == set(rows)
    for d, r in rows.items():
        assert (masked[d].text == r.text) == (base(r.text) == "")
        assert base(masked[d].text) == "" and masked[d].n_chars == len(masked[d].text)
        assert (REDACTED in masked[d].text) == (base(r.text) != "")


def test_run(spark, folder):
    used = defaultdict(int)
    rows = pipeline.run(spark, folder).collect()
    for r in rows:
        used[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    assert all(n == 4096 for s, n in used.items() if s < max(used))
    assert sum({(r.doc_id): r.doc_tokens for r in rows}.values()) == sum(used.values())


def test_odd_rows_and_clashing_columns(spark, folder, tmp_path):
    text = "some plain words that make a short text of their own and nothing else at all"
    rows = [(1, text, None, "s", 1), (1, text, None, "s", 1), (None, "andere worte hier", "de", None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    rows += [(5, "token=abcdef12345 " + "é" * 30, "fr", "s", 9), (6, "123", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumns({n: F.lit(7) for n in ("row", "score", "spans", "key", "mixture", "lang_pred", "ids", "kept")})
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 13
    got = sorted(((r.doc_id, r.text, r.lang) for r in docs.collect()), key=str)
    assert [(d, t) for d, t, _ in got] == sorted([(1, text), (None, "andere worte hier"), (5, REDACTED + " " + "é" * 30)], key=str)
    assert all(x for _, _, x in got)
    assert pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == 3
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
