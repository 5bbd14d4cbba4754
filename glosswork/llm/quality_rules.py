"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much text go too.

A line fails when it is

- navigation: bars, arrows or bullets stand between its items;
- punctuation: more than ``SYMBOL_SHARE`` percent of its characters are symbols, it repeats exclamation or question marks, or it
  has three words and capitals but no small letter;
- boilerplate: a phrase that pages and licences repeat, and little else.

What remains is the cleaned text. A document is kept when its base counts pass and the kept lines hold at least
``KEPT_SHARE`` percent of its word characters.

Everything is built from string and array expressions inside the row: no row ever meets another, so nothing is
shuffled and no document can be hot. Windows of three words are compared as sorted 64-bit numbers, 40 bits of hash and
24 of place; windows whose hashes meet are compared again as words, so the counts are exact. A text too long for
24 bits of place compares all its windows as words.

Defined results: a null or empty text has no words, all counts are 0, it fails the base rule and is not kept; its
cleaned text is empty. Other columns pass through; one that is called like an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import BLANKS, WORD, free_name, put, word_list

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_SHARE = 12
KEPT_SHARE = 60
PLACE_BITS = 24

# What the rules look for.
SYMBOLS = "[#*$%&|<>{}~^=_\\\\]"
COUNTED_SYMBOLS = "[#*$%&|<>]"
SEPARATORS = "[|»›→•·]"
STOPS = "[!?]{2,}.*[!?]{2,}"
THREE_WORDS = r"\S\s+\S+\s+\S"
BOILERPLATE = (
    r"(?i)^[^\p{L}]*(all rights reserved|privacy policy|terms of (use|service)|cookie|subscribe|share this|click here|"
    r"copyright|powered by|enable javascript|lorem ipsum|read more|advertisement)[^.]{0,60}[.]?[^\p{L}]*$"
)


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column) -> Column:
    """Whether any rule speaks against a line."""
    size = F.length(line)
    symbols = size - _without(line, SYMBOLS)
    separators = size - _without(line, SEPARATORS)
    shouting = ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}{2}") & line.rlike(THREE_WORDS)
    return (
        (symbols * 100 > size * SYMBOL_SHARE)
        | ((separators >= 2) & (separators * 30 >= size))
        | shouting
        | line.rlike(STOPS)
        | line.rlike(BOILERPLATE)
    )


def _repeat_words(w: str) -> Column:
    """How many words of the array column stand in three-word windows that occur twice or more, the first included."""
    mask = (1 << PLACE_BITS) - 1
    windows = f"greatest(size({w}) - 2, 0)"
    marked = f"slice(transform({w}, (x, i) -> shiftleft(xxhash64(x, get({w}, i + 1), get({w}, i + 2)), {PLACE_BITS}) | i), 1, {windows})"
    hashed = lambda k: f"shiftrightunsigned({k}, {PLACE_BITS})"
    met = (
        f"transform(filter(s, (k, j) -> {hashed('k')} = {hashed('get(s, j - 1)')} or {hashed('k')} = {hashed('get(s, j + 1)')}),"
        f" k -> cast(k & {mask} as int))"
    )
    few = f"element_at(transform(array(sort_array({marked})), s -> {met}), 1)"
    every = f"if({windows} > 0, sequence(0, size({w}) - 3), cast(array() as array<int>))"
    candidates = f"if(size({w}) <= {mask}, {few}, {every})"
    shown = f"sort_array(transform({candidates}, p -> struct(get({w}, p) as a, get({w}, p + 1) as b, get({w}, p + 2) as c, p as p)))"
    same = lambda n: f"(t.a = get(u, j {n}).a and t.b = get(u, j {n}).b and t.c = get(u, j {n}).c)"
    repeated = f"element_at(transform(array({shown}), u -> filter(u, (t, j) -> {same('- 1')} or {same('+ 1')})), 1)"
    return F.expr(
        f"aggregate(sort_array(transform({repeated}, t -> t.p)), struct(cast(-3 as int) as last, cast(0 as bigint) as n), "
        "(a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
    )


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cleaned, kept_chars, base_failed, kept``."""
    w, lines = free_name(df, "_words"), free_name(df, "_lines")
    blank_free = lambda x: F.coalesce(F.length(F.regexp_replace(x, BLANKS, "")), F.lit(0)).cast("bigint")
    cut = df.withColumn(w, word_list(F.col(text))).withColumn(
        lines, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    )
    counted = put(
        cut,
        {
            "n_words": F.size(w).cast("bigint"),
            "word_chars": blank_free(F.col(text)),
            "n_symbols": (F.coalesce(F.length(text) - _without(F.col(text), COUNTED_SYMBOLS), F.lit(0))).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": _repeat_words(w),
            "cleaned": F.array_join(F.filter(lines, lambda x: ~line_fails(x)), "\n"),
        },
    ).drop(w, lines)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    whole = F.col("kept_chars") * 100 >= F.col("word_chars") * KEPT_SHARE
    judged = put(counted, {"kept_chars": blank_free(F.col("cleaned")), "base_failed": failed})
    return put(judged, {"kept": ~F.col("base_failed") & whole})
