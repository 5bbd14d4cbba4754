import random
import re

from pyspark.sql import functions as F

from glosswork.llm.catalog import ORACLE, QUERIES
from glosswork.llm.near_dedup import BINS, _signatures, components, near_duplicates, without_near_duplicates
from glosswork.llm.shingles import WordHasher
from tests.compare import connect, difference

import numpy as np


def test_query_equals_sql(spark, folder):
    name = "op7_near_dedup"
    assert difference(spark, connect(folder), QUERIES[name], ORACLE[name], folder) is None


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(texts, width, percent):
    sets = [shingles(t, width) for _, t in texts]
    lead = list(range(len(texts)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                lead[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(texts):
        ids.setdefault(find(i), []).append(d)
    return [(d, len(s), min((x for x in ids[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(texts, sets))]


def family(draw, size, words, change):
    base = [f"w{draw.randrange(4000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        copy = list(base)
        for i in range(words):
            if draw.random() < change:
                copy[i] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_families_equal_brute_force(spark):
    draw = random.Random(3)
    texts = []
    for size, words, change in ((60, 120, 0.02), (30, 200, 0.035), (20, 60, 0.04), (10, 20, 0.03), (5, 400, 0.03)):
        texts += family(draw, size, words, change)
    texts += [texts[0]] * 40 + [None, "", " ", "One", "one", "one two", "ONE two", "é É", "é é"]
    draw.shuffle(texts)
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    for width, percent in ((3, 85), (5, 80)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = near_duplicates(df, width, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, width, percent))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_template_families_without_a_base_equal_brute_force(spark, monkeypatch):
    """Members are linked with each other and with no centre; blocks of few rows give the same as one block."""
    import glosswork.llm.near_dedup as module

    draw = random.Random(11)
    texts = []
    for size, words, slots, values in ((250, 150, 8, 12), (120, 150, 6, 9)):
        base, places = [f"w{draw.randrange(4000)}" for _ in range(words)], draw.sample(range(words), slots)
        for _ in range(size):
            copy = list(base)
            for p in places:
                copy[p] = f"v{draw.randrange(values)}"
            texts.append(" ".join(copy))
    base = [f"e{draw.randrange(4000)}" for _ in range(300)]
    for _ in range(150):
        copy = list(base)
        for p in draw.sample(range(300), draw.randrange(5, 11)):
            copy[p] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for width, percent, block in ((3, 85, 1024), (5, 80, 1024), (3, 85, 40)):
        monkeypatch.setattr(module, "PAIR_ROWS", block)
        got = near_duplicates(df, width, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, width, percent))


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (4, text), (4, text), (9, text + " more"), (9, None), (None, "single text here now then"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit(1), "sketch": F.lit(2), "_mark": F.lit(3), "kept": F.lit(4)})
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (9, 4, False), (9, 9, True), (None, None, True), (7, 7, True)], key=str)
    left = without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(4, text), (9, None), (None, "single text here now then"), (7, None)], key=str
    )
    assert near_duplicates(df.limit(0)).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[501] == 500


def test_densified_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    for size in (3, 20, 1000):
        near = []
        for _ in range(60):
            shared, own = draw.integers(0, 2**63, size * 8, np.uint64), draw.integers(0, 2**63, size * 2, np.uint64)
            a, b = np.unique(np.append(shared, own[:size]) * np.uint64(2)), np.unique(np.append(shared, own[size:]) * np.uint64(2))
            signed = _signatures([a, b])
            near.append((signed[0] == signed[1]).mean())
        assert abs(np.mean(near) - 0.8) < 0.06
    assert _signatures([np.zeros(0, np.uint64)]).shape == (1, BINS)


def test_words_in_blocks_are_the_same():
    raw = np.frombuffer((b"Word  and\twords " * 200_000) + b"x" * 3_000_000 + b" end", np.uint8)
    words = WordHasher().words(raw)
    short = WordHasher().words(np.frombuffer(b"word AND words\n", np.uint8))
    assert len(words) == 600_002 and (words[:3] == short).all() and (words[-5:-2] == short).all()
