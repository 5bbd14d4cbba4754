"""String expressions: prompt filling, snippets, word and punctuation tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.arrays import let

# What counts as a word and as blank space. Spelled out instead of
# \w and \s, which differ between regular-expression engines.
WORD = "[A-Za-zÀ-ÿ0-9]+"
MARK = "[^A-Za-zÀ-ÿ0-9 \\t\\r\\n]"
BLANK = "[ \\t\\r\\n]+"



def _spelled(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


# The same characters one by one, which Java looks up in a table instead of trying range after range.
_LETTERS = _spelled("A", "Z") + _spelled("a", "z") + _spelled("0", "9") + _spelled("À", "ÿ")
_WORD = f"[{_LETTERS}]++"
_MARK = f"[^{_LETTERS} \\t\\r\\n]"
_BLANK = "[ \\t\\r\\n]++"

# Characters Python's str.strip() removes.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# One piece of a prompt: an escaped brace, a slot, a stray brace, or plain text.
PROMPT_PIECE = r"\{\{|\}\}|\{\}|[{}]|[^{}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(f"{_WORD}|{_MARK}"), F.lit(0))


def token_pieces(text: Column) -> Column:
    """The whole text cut into tokens and the blanks between them."""
    return F.regexp_extract_all(text, F.lit(f"{_WORD}|{_MARK}|{_BLANK}"), F.lit(0))


def join_words(items: Column) -> Column:
    return F.array_join(items, " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(STRIPPED))


def snippet(text: Column, n: int = 3) -> Column:
    """The first ``n`` dot-separated pieces joined by a space.

    The split stops after ``n`` dots, so a long text costs no more than a short one.
    """
    return F.array_join(F.slice(F.split(text, r"\.", n + 1), 1, n), " ")


def letter_index(letter: Column) -> Column:
    """A, B, C ... to 0, 1, 2 ..."""
    return F.ascii(letter) - F.ascii(F.lit("A"))


def fill_slots(prompt: Column, targets: Column, strict: bool = True) -> Column:
    """Put targets into ``{}`` slots in order; doubled braces stand for themselves.

    Spare targets are ignored. A slot without a target, or any other use of a
    brace, is an error when ``strict``, and otherwise gives an empty string or
    the brace itself.
    """

    def filled(pieces: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: F.get(pieces, i - 1) == "{}")
        return let(places, lambda slots: F.array_join(F.transform(pieces, lambda p, i: value(p, i, slots)), ""))

    def value(piece: Column, i: Column, slots: Column) -> Column:
        number = F.array_position(slots, i + 1).cast("int")
        missing = F.raise_error(F.lit("prompt has more slots than targets")) if strict else F.lit("")
        stray = F.raise_error(F.lit("prompt has a brace that is neither a slot nor doubled")) if strict else piece
        return (
            F.when(piece == "{}", F.when(number > F.size(targets), missing.cast("string")).otherwise(F.get(targets, number - 1)))
            .when(piece == "{{", F.lit("{"))
            .when(piece == "}}", F.lit("}"))
            .when(piece.isin("{", "}"), stray.cast("string"))
            .otherwise(piece)
        )

    return let(F.regexp_extract_all(prompt, F.lit(PROMPT_PIECE), F.lit(0)), filled)
