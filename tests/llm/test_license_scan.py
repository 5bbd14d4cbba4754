import math
import re

from pyspark.sql import functions as F

from glosswork.llm.catalog import QUERIES
from glosswork.llm.license_scan import COSINE, TEMPLATES, markers, scan, weights

TERM = re.compile("[a-z0-9]+")


def brute(files):
    """``license, score, share`` of every file's best line, no line being left out."""
    vocabulary = {t for texts in TEMPLATES.values() for x in texts for t in TERM.findall(x.lower())}
    df = {t: sum(t in set(TERM.findall((x or "").lower())) for _, x in files) for t in vocabulary}
    weight = {t: math.log((1 + len(files)) / (1 + df[t])) + 1 for t in vocabulary}
    vector = lambda words: {t: words.count(t) * weight.get(t, 1.0) for t in set(words)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(TERM.findall(x.lower()))) for name, texts in TEMPLATES.items() for x in texts]
    out = []
    for _, text in files:
        best, said = None, 0
        for line in (text or "").split("\n"):
            v = vector(TERM.findall(line.lower()))
            if not v:
                continue
            top = min((-round(sum(v.get(t, 0) * w for t, w in m.items()) / norm(v) / norm(m), 6), name) for name, m in templates)
            if -top[0] >= COSINE:
                best = min(best or top, top)
                said += len(TERM.findall(line.lower()))
        out.append((best[1], -best[0], said / len(TERM.findall(text.lower()))) if best else None)
    return out


def test_query_headers_equal_brute_force(spark, folder):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op9_license_scan"](spark, folder).collect()}
    assert len(rows) == len(docs)
    for (d, _), wanted in zip(docs, brute(docs)):
        if wanted is None:
            assert rows[d].how != "header"
        else:
            assert (rows[d].license, rows[d].how) == (wanted[0], "header") and abs(rows[d].score - wanted[1]) < 2e-6


def test_nearest_ancestor(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("LICENSE", mit), ("a/LICENSE.txt", apache + "\nand many other words " * 9), ("a/b/c/x.txt", "plain"), ("b/y.txt", "plain"),
        ("z.txt", None), ("a/b/own.txt", "a long intro of some words\n" * 3 + "Licensed under CC BY-NC 4.0."), ("ab/n.txt", ""), (None, "no path"), ("q/only.txt", mit),
        ("q/other.txt", "text"), ("q/other.txt", "text"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id bigint, path string, text string")
    df = df.withColumns({n: F.lit(1) for n in ("dir", "license", "term", "line")})
    got = {r.doc_id: (r.license, r.how, r.from_directory) for r in scan(df).collect()}
    assert len(got) == len(files)
    assert got[2] == ("Apache-2.0", "inherited", "a") and got[3] == ("MIT", "inherited", "") and got[4] == ("MIT", "inherited", "")
    assert got[5] == ("CC-BY-NC-4.0", "header", None) and got[6] == ("MIT", "inherited", "") and got[7] == ("MIT", "inherited", "")
    assert got[8][:2] == ("MIT", "header") and got[9] == ("MIT", "inherited", "q")
    assert scan(df.limit(0)).count() == 0


def test_every_line_over_the_bound_has_a_marker(spark):
    df = spark.createDataFrame([("the work is licensed under terms",)] * 5 + [("MIT",)], "text string")
    weight = weights(df)
    found = markers(weight)
    for texts in TEMPLATES.values():
        for text in texts:
            words = TERM.findall(text.lower())
            squares = {t: (words.count(t) * weight[t]) ** 2 for t in words}
            assert sum(v for t, v in squares.items() if t not in found) < COSINE**2 * sum(squares.values())


def test_notices_inside_long_lines(spark):
    words = " ".join(f"word{i}" for i in range(1000))
    notices = {"MIT": "Released under the MIT License.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    files = [(f"{name}/LICENSE", f"{words} {said} {words}") for name, said in notices.items()]
    files += [(f"{name}/x.txt", "plain") for name in notices] + [("other/LICENSE", words)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id bigint, path string, text string")
    got = {r.path: (r.license, r.how) for r in scan(df).collect()}
    assert all(got[f"{n}/LICENSE"] == (n, "header") and got[f"{n}/x.txt"] == (n, "inherited") for n in notices)
    assert got["other/LICENSE"] == (None, "none")
