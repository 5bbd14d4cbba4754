import re

from pyspark.sql import functions as F

from glosswork.llm.catalog import QUERIES
from glosswork.llm.decontaminate import leaks, without_leaks

ITEM = (
    "A train leaves the station at 9 and travels 120 km before Anna boards with 3 large bags while her brother Marco "
    "waits two hours at the next stop with 3 tickets and 120 coins in his pocket"
)
OTHER = (
    "A train leaves the station at 7 and travels 450 miles before Boris boards with 8 large bags while her brother Ivan "
    "waits five hours at the next stop with 8 tickets and 450 coins in his pocket"
)
MIXED = OTHER.replace("8 tickets", "5 tickets").replace("450 coins", "77 coins")


def found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in leaks(docs, bench).collect()}


def test_query_equals_brute_force_on_literal_windows(spark, folder):
    """In the given tables items come with at most one word changed, so plain windows tell the same documents."""
    cut = lambda t: re.findall(r"[\w]+", re.sub(r"[^\w\s]", "", (t or "").lower()))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [cut(t)] for i in range(len(w) - 4)}
    docs = {r.doc_id: grams(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: grams(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    wanted = {(d, i) for d, g in docs.items() for i, h in items.items() if h and len(g & h) >= 0.8 * len(h)}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op8_decontaminate"](spark, folder).collect()} == wanted and wanted


def test_kinds(spark):
    got = found(spark, [f"Intro words here. {ITEM}. More text.", f"x {OTHER} y", MIXED, "nothing to see", OTHER + " and then " + ITEM])
    assert got[0, 0].kind == "literal" and got[1, 0].kind == "reparameterised"
    assert (2, 0) not in got and (3, 0) not in got and (4, 0) in got


def test_symbols_and_case_do_not_hide(spark):
    loud = " ".join(w.upper() + "!!" for w in re.sub("[0-9]", "", "the quick brown fox jumps over the lazy dog and runs far away").split())
    assert (0, 0) in found(spark, [f"ABC {loud}"], ["the quick brown fox jumps over the lazy dog and runs far away"])


def test_odd_rows(spark):
    got = found(spark, [None, "", "a b c d", ITEM, ITEM], [None, "", "a b c d", ITEM, ITEM])
    assert set(got) == {(d, i) for d in (3, 4) for i in (3, 4)} | {(2, 2)}
    docs = spark.createDataFrame([(None, ITEM), (5, ITEM), (5, "clean text that stays"), (6, None)], "doc_id bigint, text string")
    docs = docs.withColumns({n: F.lit(1) for n in ("words", "item", "window", "_mark", "_leak_doc", "at", "t")})
    bench = spark.createDataFrame([(0, ITEM)], "item_id bigint, text string")
    left = without_leaks(docs, bench)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(5, "clean text that stays"), (6, None)]
    assert without_leaks(docs.limit(0), bench).count() == 0 and without_leaks(docs, bench.limit(0)).count() == 4


def test_many_windows_are_joined_not_broadcast(spark, monkeypatch):
    import glosswork.llm.decontaminate as module

    one = found(spark, [ITEM, OTHER])
    monkeypatch.setattr(module, "FEW_WINDOWS", 0)
    assert found(spark, [ITEM, OTHER]) == one


def test_edits_and_names_at_sentence_starts(spark):
    sold = "{0} sold clips to {1} of her friends in {2}. {0} then sold half as many clips in {3}. How many clips did she sell?"
    item = sold.format("Natalia", "48", "April", "May")
    plain = "the quick brown fox jumps over a lazy dog and runs far away into dark woods"
    texts = [
        "Some intro. " + sold.format("Marina", "36", "June", "July") + " The end.",
        "x " + plain.replace("lazy", "sleepy") + " y",
        plain.replace("jumps over", "jumps high over"),
        plain.replace("over a", "over"),
        "the quick brown fox jumps " + "other words come here now " * 3 + "into dark woods",
    ]
    assert set(found(spark, texts, [item, plain])) == {(0, 0), (1, 1), (2, 1), (3, 1)}


def test_names_at_sentence_starts(spark):
    item = "Anna has 3 apples. Ben has 4 pears. Cleo has 9 figs. Who has most fruit?"
    other = "Dora has 5 apples. Emil has 8 pears. Fritz has 2 figs. Who has most fruit?"
    mixed = "Anna has 3 apples. Anna has 4 pears. The box has 9 figs. Who has most fruit?"
    got = found(spark, [other, f"A test follows. {item}", mixed], [item])
    assert got[0, 0].kind == "reparameterised" and got[1, 0].kind == "literal"


def test_items_of_few_words(spark):
    texts = ["Tell me, what is the capital city?", "nothing of it", "is the What of capital", "42", "17"]
    got = found(spark, texts, ["What is the capital", "nothing of", "42", "Nothing more"])
    assert set(got) == {(0, 0), (1, 1), (3, 2)}


def test_number_lists_meet_only_their_copies(spark):
    numbers = lambda seed, n: " ".join(str((seed + i) ** 2 * seed % 1009) for i in range(n))
    item = numbers(5, 1000)
    texts = [numbers(77, 1000), "see: " + item + " end", numbers(901, 300), item[: len(item) // 4]]
    assert set(found(spark, texts, [item, numbers(400, 10)])) == {(1, 0)} | {(d, 1) for d in range(4) if numbers(400, 10) in texts[d]}


def test_against_brute_force_with_templates_and_slots(spark):
    """Plain loops over the same templates: windows met anywhere, slots compared along each diagonal, bands of diagonals."""
    import random
    from collections import defaultdict

    import regex

    from glosswork.llm import decontaminate as d

    def words(text):
        t = regex.sub(d.NUMERAL, d.NUMBER, text)
        t = regex.sub(d.NAMES, d.NAME, regex.sub(d.UNITS, d.UNIT, t))
        plain = regex.sub(d.KEPT_IN_WORDS, "", t).lower().split()
        raw = [w.lower() for w in text.split() if regex.search(r"[\p{L}\p{N}]", w)]
        assert len(plain) == len(raw)
        return plain, raw

    slot = lambda w: any(c in w for c in (d.NUMBER, d.UNIT, d.NAME))

    def agree(pairs):
        said, own = defaultdict(set), defaultdict(int)
        for i, x in pairs:
            said[i].add(x)
            own[i] += 1
        good = sum(n for i, n in own.items() if len(said[i]) == 1)
        return good * 100 >= sum(own.values()) * d.PERCENT

    def leaked(doc, item):
        (dw, dr), (iw, ir) = words(doc), words(item)
        cut = lambda w, p: tuple(w[p : p + 5])
        hits = [(p, q) for p in range(len(dw) - 4) for q in range(len(iw) - 4) if cut(dw, p) == cut(iw, q)]
        pairs = lambda p, q: [(ir[q + k], dr[p + k]) for k in range(5) if slot(iw[q + k])]
        once = {}
        for p, q in hits:
            key = cut(iw, q)
            once[key] = min(once.get(key, (p - q, pairs(p, q))), (p - q, pairs(p, q)))
        by = [((g, i), x) for g, ps in once.values() for i, x in ps]
        if once and len(once) * 100 >= len({cut(iw, q) for q in range(len(iw) - 4)}) * d.PERCENT and agree(by):
            return True
        for band in {b for p, q in hits for b in ((p - q) // 8 * 2, (p - q + 4) // 8 * 2 - 1)}:
            inside = [(p, q) for p, q in hits if band in ((p - q) // 8 * 2, (p - q + 4) // 8 * 2 - 1)]
            covered = {q + k for _, q in inside for k in range(5)}
            if len(covered) * 100 >= len(iw) * d.PERCENT and agree([x for p, q in inside for x in pairs(p, q)]):
                return True
        return False

    draw = random.Random(8)
    names, things = ["Anna", "Ben", "Cleo", "Dora"], "apples pears figs plums nuts boxes bags coins".split()

    def story(k):
        lines = []
        for i in range(draw.randint(2, 5)):
            lines.append(f"{names[(k + i) % 4]} gives {draw.choice([str(draw.randrange(2, 99)), 'three'])} {draw.choice(things)} to {draw.choice(names)} after {draw.randrange(2, 9)} days")
        return ". ".join(lines) + ". How many are left?"

    items = [story(k) for k in range(12)]
    texts = []
    for item in items:
        swap = dict(zip(names, draw.sample(["Gus", "Hal", "Ida", "Jon"], 4)))
        renamed = regex.sub("|".join(names), lambda m: swap[m.group()], item)
        shifted = regex.sub(r"[0-9]+", lambda m: str(int(m.group()) + 100), renamed)
        mixed = regex.sub(r"[0-9]+", lambda m: str(draw.randrange(100, 104)), item)
        cut = item.split()
        del cut[len(cut) // 2]
        texts += [f"Some text first. {renamed} And then more.", shifted, mixed, " ".join(cut), story(1)]
    wanted = {(a, b) for a, t in enumerate(texts) for b, i in enumerate(items) if leaked(t, i)}
    assert set(found(spark, texts, items)) == wanted and 40 < len(wanted) < 300
