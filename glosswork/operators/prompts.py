"""Cloze prompts: filling slots, matching spans, masking targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.arrays import flattened
from glosswork.functions.text import fill_slots, strip
from glosswork.operators.tokens import MASK_TEXT, tokenize


def prompt_fill(
    df: DataFrame, trim: bool = True, strict: bool = True, raw_if_empty: bool = False, name: str = "text"
) -> DataFrame:
    """Add the prompt with its targets filled in.

    ``raw_if_empty`` returns a prompt without targets untouched, braces included.
    """
    filled = fill_slots(F.col("prompt"), F.col("targets"), strict)
    if raw_if_empty:
        filled = F.when(F.size("targets") == 0, F.col("prompt")).otherwise(filled)
    return df.withColumn(name, strip(filled) if trim else filled)


def target_spans(text: Column, targets: Column, missing: str = "skip") -> Column:
    """``array<struct<b, e>>``: where each target first stands in the text.

    A target that is absent is skipped, or with ``missing='python'`` spans
    [-1, length - 1] as a failed search does in Python.
    """
    if missing not in ("skip", "python"):
        raise ValueError("missing is 'skip' or 'python'")

    def span(target: Column) -> Column:
        begin = F.instr(text, target) - 1
        return F.struct(begin.alias("b"), (begin + F.length(target)).alias("e"))

    spans = F.transform(targets, span)
    return F.filter(spans, lambda s: s["b"] >= 0) if missing == "skip" else spans


def touches(token: Column, span: Column) -> Column:
    """Whether a non-empty token overlaps a span; ends that only touch count."""
    return (token["b"] < token["e"]) & (token["e"] >= span["b"]) & (token["b"] <= span["e"])


def with_spans(df: DataFrame, missing: str = "skip") -> DataFrame:
    """Fill the prompts and add ``tokens`` with offsets and the target ``spans``."""
    tokenized = tokenize(prompt_fill(df))
    return tokenized.withColumn("spans", target_spans(F.col("text"), F.col("targets"), missing))


def span_match(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per token and span that touch: ``key, token_no, span_no, tok``.

    Tokens and spans of a text are arrays of the same row, so this range join
    needs no shuffle.
    """

    def hits(token: Column, i: Column) -> Column:
        numbered = F.transform("spans", lambda s, j: F.struct(j.alias("span_no"), touches(token, s).alias("hit")))
        return F.transform(
            F.filter(numbered, lambda n: n["hit"]),
            lambda n: F.struct(i.alias("token_no"), n["span_no"].alias("span_no"), token["tok"].alias("tok")),
        )

    return flattened(df, [key], F.flatten(F.transform("tokens", hits)), "m").select(key, "m.*")


def span_mask(df: DataFrame, missing: str = "skip", mask: str = MASK_TEXT) -> DataFrame:
    """Replace the tokens that touch a target's first occurrence by the mask.

    Adds ``masked`` (tokens shown), ``labels`` (the true tokens) and ``mask_flags``.
    """
    flagged = with_spans(df, missing).withColumn(
        "mask_flags", F.transform("tokens", lambda t: F.exists("spans", lambda s: touches(t, s)))
    )
    shown = F.zip_with("tokens", "mask_flags", lambda t, m: F.when(m, F.lit(mask)).otherwise(t["tok"]))
    return flagged.withColumn("masked", shown).withColumn("labels", F.col("tokens.tok")).drop("tokens", "spans")
