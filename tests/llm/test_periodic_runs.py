import random

import numpy as np
import pyarrow as pa

from glosswork.llm import catalog, periodic_runs
from glosswork.llm.periodic_runs import find_runs
from tests.compare import connect, difference


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(12, 2 * q):
                stop = i + q
                if not any(all(words[k] == words[k + d] for k in range(start, stop - d)) for d in range(1, q)):
                    out.append((start, stop - start, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sturmian(n, slope):
    return [str(int((i + 1) * slope) - int(i * slope)) for i in range(n)]


def texts():
    draw = random.Random(5)
    out = [["x"] * 700, [], ["a"], list("ababaab" * 30), list("ab" * 40 + "a" + "ab" * 70 + "aab"), list("abababa" * 60)]
    for unit in ("ab" * 60 + "a", "abc" * 60 + "a", "aab" * 50 + "aa"):  # two runs of one short period that touch
        out += [list("q" + unit + unit + "z"), list("qb" + unit + unit + "bz"), list(unit + unit + unit)]
    out += [sturmian(1000, s) for s in (0.381966, 0.29289, 0.0131)]
    out.append([str(bin(i).count("1") % 2) for i in range(700)])
    for _ in range(60):
        n, kinds = draw.randint(1, 900), draw.choice([1, 2, 3, 50, 1000])
        words = [str(draw.randrange(kinds)) for _ in range(n)]
        if draw.random() < 0.7:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randint(3, 10)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        out.append(words + words if draw.random() < 0.3 else words)
    return out


def test_every_run_of_every_text():
    rows = texts()
    for at in range(0, len(rows), 20):
        part = rows[at : at + 20]
        lengths, lists, left = periodic_runs._of_texts(pa.array([" ".join(t) for t in part]))
        for words, n, runs, text in zip(part, lengths, lists, left):
            wanted = brute(words)
            assert n == len(words) and [(r["start"], r["length"], r["period"]) for r in runs] == wanted
            assert text == collapsed(words, wanted).encode()


def test_equal_grams_are_never_paired_without_bound():
    # A text of one word has equal grams everywhere; none of them may become a seed.
    x = np.ones(20_000, np.int32)
    assert periodic_runs.word_runs(x, np.array([20_000])).tolist() == [[0, 20_000, 1]]


def test_odd_rows(spark):
    again = "one two three " * 8
    rows = [(1, again, "r", 5), (1, again, "r", 5), (None, None, None, None), (3, "", "x", 1), (4, " \t\n", "x", 1), (5, "é ü " * 9 + " ", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, found int")
    got = find_runs(docs)
    assert got.columns == ["doc_id", "text", "found", "n_words", "runs", "collapsed"]
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.found) for r in got.collect()), key=str)
    assert found == sorted(
        [
            (1, 24, [(0, 24, 3)], "one two three", 5),
            (1, 24, [(0, 24, 3)], "one two three", 5),
            (None, 0, [], "", None),
            (3, 0, [], "", 1),
            (4, 0, [], "", 1),
            (5, 19, [(0, 18, 2)], "é ü  ", 1),
        ],
        key=str,
    )
    assert find_runs(docs.limit(0)).count() == 0


def test_a_text_of_megabytes(spark):
    words = [str(i) for i in range(200_000)]
    text = " ".join(words + words[150_000:] * 2)
    row = find_runs(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert [tuple(r) for r in row.runs] == [(150_000, 150_000, 50_000)] and row.collapsed == " ".join(words)


def test_query_equals_sql(spark, folder):
    name = "op13_periodic_runs"
    assert difference(spark, connect(folder), catalog.QUERIES[name], catalog.ORACLE[name], folder) is None
