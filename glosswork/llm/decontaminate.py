"""Benchmark decontamination by templates: numbers, units and names become typed placeholders.

A text's template is its words in small letters without punctuation, numbers, units after numbers and names inside
sentences being replaced by a placeholder of their type. Every window of ``WIDTH`` template words of a document is
looked up among the windows of all items by hash, and the words behind a met hash are compared. An item leaks into a
document when at least ``PERCENT`` percent of its windows are met there and the slots agree: along one diagonal (the
distance of the places in document and item) a slot value of the item stands for the same value of the document
wherever it comes, for at least ``PERCENT`` percent of the slots. As one changed word takes ``WIDTH`` windows away, an item
leaks as well when the windows met along neighbouring diagonals (an added or missing word moves the diagonal by one) cover
at least ``PERCENT`` percent of its words and the slots along them agree. A leak is ``literal`` when all slots have the item's
own values and ``reparameterised`` when they don't.

Windows are made and looked up inside one stage; only met windows are shuffled, as one row for each document, item and
place. The items' windows are broadcast when they have proved few and small, and joined by hash otherwise; texts take no
part in that join. A window of placeholders alone stands for its own words, so number lists meet only their copies.

Everything is built from string and array expressions. Defined results: no text, or one without a word, meets nothing and
is met by nothing; an item with fewer words than a window is one window of its own length; repeated items and repeated documents are each judged by
themselves, rows equal in id and text being one document. Null ids stay null. Other columns pass through
``without_leaks`` and don't come back from ``leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import WORD, free_name
from glosswork.plans import bounded, written

WIDTH = 5
PERCENT = 80
SHIFT = 4  # words added or missing inside a passage that is still one passage
FEW_WINDOWS = 200_000  # windows of items that may be sent to every task
WINDOW_BYTES = 96 << 20  # and their bytes

# The placeholders and what they stand for.
NUMBER, UNIT, NAME = "\ue000", "\ue001", "\ue002"  # private characters, taken out of texts first
PRIVATE = f"[{NUMBER}-{NAME}]"
NUMERAL = r"[0-9][0-9.,:/]*|\b(?:two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand|million)\b"
UNITS = (
    r"(?<=\ue000[ %]?)(?:km|kg|cm|mm|mg|ml|lbs?|oz|mph|m|g|s|h|miles?|met(?:er|re)s?|feet|foot|inch(?:es)?|litres?|liters?|grams?|"
    r"pounds?|dollars?|euros?|cents?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|percent)\b"
)
# Words that begin sentences without being names.
OPENERS = (
    "The A An In On At If When While What Who Whose Where Which Why How Is Are Was Were Do Does Did Can Could Will Would Should "
    "There This That These Those It He She They We You I My His Her Their Our And But Or So Then For From To With By As After "
    "Before Each Every Some All Both One Find Calculate Given Let Suppose"
)
# A capital is looked for first and then what stands around it: inside a sentence any word, at its start one in small letters.
NAMES = (
    r"\p{Lu}(?<!(?=(?:" + "|".join(OPENERS.split()) + r")\b).)(?:(?<=[\p{Ll}\p{Nd}\ue000\ue001,;:-] \p{Lu})"
    r"|(?<=(?:^|[\r\n]|[.!?)\"\u201d\u00bb] )\p{Lu})(?=\p{Ll}))[\p{L}'\u2019-]*"
)
KEPT_IN_WORDS = r"[^\p{L}\p{N}\x20\x09-\x0D" + f"{NUMBER}-{NAME}]+"
BESIDE_WORDS = ".,;:!?()[]\"'"


def _template(text: Column) -> Column:
    """The text with placeholders, without punctuation, in small letters: every expression named once."""
    marked = F.regexp_replace(F.regexp_replace(text, PRIVATE, ""), NUMERAL, NUMBER)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, UNITS, UNIT), NAMES, NAME), KEPT_IN_WORDS, "")
    return F.lower(F.coalesce(plain, F.lit("")))


def _split(plain: Column) -> Column:
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda x: x != "")


def template_words(text: Column) -> Column:
    """The words of a text's template, as many as the text has words with a letter or digit."""
    return _split(_template(text))


def _raw_words(text: Column) -> Column:
    """The words behind ``template_words``, one for one."""
    return F.filter(F.regexp_extract_all(F.regexp_replace(text, PRIVATE, ""), F.lit(WORD), F.lit(0)), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def _windows(texts: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep, at, window, words`` of every window of ``width`` words of rows with ``plain`` and ``text``.

    A window of nothing but placeholders says nothing; its own words stand in for them, so that lists of numbers or names
    meet only their copies. The template is a column of its own: what follows names it twice and would compute it twice.
    """
    blank = r"[\x20\x09-\x0D]+"
    bare = rf"(?:{PRIVATE}{blank}){{{width - 1}}}{PRIVATE}(?:{blank}|$)"
    own = F.transform(_raw_words(F.col("text")), lambda x: F.lower(F.trim(x, F.lit(BESIDE_WORDS))))
    none = F.array().cast("array<string>")
    cut = texts.select(*keep, _split(F.col("plain")).alias("words"), F.when(F.col("plain").rlike(bare), own).otherwise(none).alias("own"))
    places = F.when(F.size("words") >= width, F.sequence(F.lit(0), F.size("words") - width))
    # The outer form: a plain explode would compute the places, and with them all words, once more for a filter.
    at = cut.select(*keep, "words", "own", F.explode_outer(places).alias("at")).where(F.col("at").isNotNull())
    empty = F.lit(True)
    for i in range(width):
        empty = empty & F.get("words", F.col("at") + i).isin(NUMBER, UNIT, NAME)
    value = lambda i: F.when(empty, F.get("own", F.col("at") + i)).otherwise(F.get("words", F.col("at") + i))
    said = F.when(empty, F.slice("own", F.col("at") + 1, width)).otherwise(F.slice("words", F.col("at") + 1, width))
    return at.select(*keep, "at", F.xxhash64(F.lit(width), *[value(i) for i in range(width)]).alias("window"), said.alias("words"), F.lit(width).alias("width"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``window, width, item, item_id, item_at, item_size, item_words, item_raw, item_windows``: distinct windows of all items.

    An item with fewer than ``WIDTH`` template words is one window of its own length.
    """
    named = items.select(
        F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_id), F.col(text)).alias("item"), F.col(text).alias("text"), _template(F.col(text)).alias("plain")
    ).dropDuplicates(["item"])
    named = named.withColumn("item_size", F.size(_split(F.col("plain")))).withColumn("raw", _raw_words(F.coalesce("text", F.lit(""))))
    keep = ["item_id", "item", "item_size", "raw"]
    each = None
    for width in range(1, WIDTH + 1):
        fits = F.col("item_size") >= width if width == WIDTH else F.col("item_size") == width
        part = _windows(named.where(fits), keep, width)
        each = part if each is None else each.unionByName(part)
    each = each.select(
        "window", "width", "item_id", "item", F.col("at").alias("item_at"), "item_size", F.col("words").alias("item_words"),
        F.slice("raw", F.col("at") + 1, F.col("width")).alias("item_raw"),
    )
    sizes = each.groupBy(F.col("item").alias("_item")).agg(F.count_distinct("window").alias("item_windows"))
    return each.join(sizes, F.col("item") == F.col("_item")).drop("_item")


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each leak: ``doc_id, text_hash, item_id, met, item_windows, slots, agreeing, kind``."""
    windows = written(item_windows(items), "windows")
    widths = [r.width for r in windows.select("width").distinct().orderBy("width").collect()]  # WIDTH at most
    small = bounded(windows, FEW_WINDOWS, WINDOW_BYTES)
    windows = windows if small is None else F.broadcast(small)
    named = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    plain = named.withColumn("plain", _template(F.col("text")))
    met = None
    for width in widths or [WIDTH]:
        found = _windows(plain, ["doc_id", "text_hash"], width).join(windows, ["window", "width"]).where(F.col("words") == F.col("item_words"))
        met = found if met is None else met.unionByName(found)
    met = met.select("doc_id", "text_hash", "at", "width", "window", "item_id", "item", "item_windows", "item_size", "item_at", "item_words", "item_raw")
    # Written, as several questions are asked of it and the texts should be read for it once.
    met = written(met, "met")
    is_slot = lambda x: x.rlike(PRIVATE)
    has_slot = F.exists("item_words", is_slot)
    spots = met.where(has_slot).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_set("at").alias("spots"))
    few = bounded(spots)
    wanted = named.join(spots if few is None else F.broadcast(few), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    # The words behind a text's windows are taken out once, for all places at which it met one with a slot.
    raw = wanted.dropDuplicates(["doc_id", "text_hash"]).select("_d", "_h", "spots", _raw_words(F.col("text")).alias("raw"))
    spoken = raw.select("_d", "_h", "raw", F.explode_outer("spots").alias("_at")).select("_d", "_h", "_at", F.slice("raw", F.col("_at") + 1, WIDTH).alias("said"))
    filled = F.arrays_zip(F.col("item_words").alias("t"), F.col("item_raw").alias("i"), F.slice("said", F.lit(1), F.col("width")).alias("d"))
    pairs = F.transform(
        F.filter(filled, lambda x: is_slot(x["t"])), lambda x: F.struct(F.lower(x["i"]).alias("i"), F.lower(x["d"]).alias("d"))
    )
    none = F.array().cast("array<struct<i:string,d:string>>")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("at") == F.col("_at"))
    rows = met.join(spoken, same, "left").select(
        "doc_id", "text_hash", "item_id", "item", "item_windows", "item_size", "item_at", "window", "width",
        (F.col("at") - F.col("item_at")).alias("diagonal"), F.when(has_slot, pairs).otherwise(none).alias("pairs"),
    )
    rows = written(rows, "met")
    keys = ["doc_id", "text_hash", "item", "item_id"]
    once = rows.groupBy(*keys, "item_windows", "window").agg(F.min(F.struct("diagonal", "pairs")).alias("m"))
    shares = once.groupBy(*keys, "item_windows").agg(F.count(F.lit(1)).alias("met")).where(
        F.col("met") * 100 >= F.col("item_windows") * PERCENT
    )
    anywhere = _judged(shares, once.select(*keys, "m.diagonal", F.explode("m.pairs").alias("p")), keys, ["diagonal"], [])

    # Each diagonal lies in two bands that overlap by half, so diagonals up to SHIFT apart share one.
    width = 2 * SHIFT
    band = F.explode(F.array(F.floor(F.col("diagonal") / width) * 2, F.floor((F.col("diagonal") + SHIFT) / width) * 2 - 1)).alias("band")
    banded = rows.select("*", band)
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set("item_at"), lambda p: F.sequence(p, p + (WIDTH - 1))))))
    passages = banded.groupBy(*keys, "item_windows", "item_size", "band").agg(
        F.count_distinct("window").alias("met"), covered.alias("covered")
    ).where(F.col("covered") * 100 >= F.col("item_size") * PERCENT).select(*keys, "item_windows", "band", "met")
    inside = banded.select(*keys, "band", F.explode("pairs").alias("p"))
    aligned = _judged(passages, inside, keys, [], ["band"]).drop("band")
    both = anywhere.withColumn("order", F.lit(0)).unionByName(aligned.withColumn("order", F.lit(1)))
    columns = ["met", "item_windows", "slots", "agreeing", "kind"]
    # The whole item's own judgement comes first, then the passage with most windows.
    ranked = F.struct("order", (-F.col("met")).alias("less"), "kind", "slots", "agreeing", "met", "item_windows")
    return both.groupBy(*keys).agg(F.min(ranked).alias("r")).select("doc_id", "text_hash", "item_id", *[f"r.{c}" for c in columns])


def _judged(shares: DataFrame, filled: DataFrame, keys: list[str], inner: list[str], outer: list[str]) -> DataFrame:
    """Rows of ``shares`` whose slots agree; values ``p`` are compared inside the keys, ``inner`` and ``outer``."""
    keys = [*keys, *outer]
    values = filled.groupBy(*keys, *inner, "p.i").agg(F.count(F.lit(1)).alias("n"), F.min("p.d").alias("low"), F.max("p.d").alias("high"))
    agreed = values.groupBy(*keys).agg(
        F.sum("n").alias("slots"),
        F.sum(F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(0)).alias("agreeing"),
        F.sum(F.when((F.col("low") == F.col("high")) & (F.col("low") == F.col("i")), F.col("n")).otherwise(0)).alias("own"),
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = shares.join(agreed.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    slots = F.coalesce("slots", F.lit(0))
    return joined.where(F.coalesce("agreeing", F.lit(0)) * 100 >= slots * PERCENT).select(
        *keys, "met", "item_windows", slots.alias("slots"), F.coalesce("agreeing", F.lit(0)).alias("agreeing"),
        F.when(F.coalesce("own", F.lit(0)) == slots, "literal").otherwise("reparameterised").alias("kind"),
    )


def without_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    found = leaks(documents, items, doc_id, text).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    d, h, mark = free_name(documents, "_leak_doc"), free_name(documents, "_leak_hash"), free_name(documents, "_mark")
    found = found.select(F.col("_d").alias(d), F.col("_h").alias(h))
    marked = documents.withColumn(mark, F.xxhash64(text))
    return marked.join(found, marked[doc_id].eqNullSafe(found[d]) & (marked[mark] == found[h]), "left_anti").drop(mark)
