import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glosswork.llm.catalog import QUERIES
from glosswork.llm.quality_rules import clean_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = clean_lines(df).orderBy("doc_id").collect()
    return rows, [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


def test_query_counts(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op1_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeated = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.kept and r.base_failed)


def test_query_separates_good_from_bad(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality_rules"](spark, folder).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept == bool(labels[r.doc_id]) for r in rows)


def test_odd_texts(spark):
    long = "word " * 70_000 + "end"
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "x\n\nx\nx ", "😀 😀 😀 😀", "\x0b\x0ca\rb", long, "a\x85b c d"]
    rows, got = found(spark, texts)
    assert got == [counts(t) for t in texts]
    assert not any(r.kept for r in rows)
    assert rows[0].cleaned == ""


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n|é\t", max_size=60), min_size=1, max_size=40))
def test_random_texts(spark, texts):
    assert found(spark, texts)[1] == [counts(t) for t in texts]


def test_lines(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    lines = {
        good: True,
        "Home | About | Contact | Login |": False,
        "BUY NOW!! CHEAP!! TODAY!!": False,
        "th*** in$$$ of### to&&&": False,
        "All rights reserved.": False,
        "Really? Yes! He said so.": True,
        "NASA said it was done.": True,
    }
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id bigint, text string")
    row = clean_lines(df).first()
    assert row.cleaned.split("\n") == [x for x, kept in lines.items() if kept]
    assert row.kept
    lost = spark.createDataFrame([(1, good + "\n" + "a | b | c | d | e |\n" * 60)], "doc_id bigint, text string")
    assert not clean_lines(lost).first().kept


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    df = df.withColumns({"n_words": F.lit("x"), "_words": F.lit(1), "Kept": F.lit(2), "a": F.lit(3), "s": F.lit(4), "p": F.lit(5), "u": F.lit(6), "x": F.lit(7)})
    out = clean_lines(df)
    row = out.first()
    assert (row.n_words, row["_words"], row.a, row.x) == (3, 1, 3, 7)
    assert clean_lines(df.limit(0)).count() == 0
