"""Mixing sources to target weights: Efraimidis-Spirakis sampling under token budgets.

Every source gets a share of the mix by its weight, at most ``MOST`` times its own size; what a source can't take is
shared out among the others by weight until none is above its bound. A budget takes complete epochs of its source first.
What is left is filled by a weighted sample without replacement: each document draws an exponential key whose rate is
its quality weight, and documents are taken by growing key until their sizes add up to the rest. The document that
crosses the budget gives as many words as are missing.

Keys come from a hash of seed, id and text, so every run draws the same. A source is never sorted whole: keys are cut at
their quantiles, each slice of a source is summed by itself and the sums of the slices carry over, so a source of a third
of all rows is many slices. Only ids, sizes and keys are shuffled, never texts. Targets take a few rounds over a table of
one row for each source; two numbers of each round reach the driver.

Defined results: no text has size 0 and is taken with 0 words. A null source is a source like any other, the last one.
A quality weight that is null, zero or negative counts as ``LEAST_WEIGHT``. Equal rows are sampled apart; among rows equal in
id and text it is not said which one a budget cuts. A null id draws as an empty one. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import running_start, word_list
from glosswork.operators.ids import number_rows
from glosswork.plans import bucket_of, quantile_bounds, written

WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
MOST = 3  # how often a document may be taken
SLICE_ROWS = 20_000  # rows that one task sorts
SLICES = 4096  # at most
LEAST_WEIGHT = 1e-6
SEED = 12


def quality_weight(text: Column) -> Column:
    """A weight of 5 to 100 from the text alone: symbols, digits and repeated lines lower it."""
    whole = F.coalesce(text, F.lit(""))
    odd = F.length(whole) - F.length(F.regexp_replace(whole, r"[0-9#*$%&|<>{}~^=_\\]", ""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x != "")
    again = F.size(lines) - F.size(F.array_distinct(lines))
    lost = F.call_function("div", 300 * odd, F.greatest(F.length(whole), F.lit(1)))
    repeated = F.call_function("div", 60 * again, F.greatest(F.size(lines), F.lit(1)))
    return F.greatest(F.lit(5), 100 - lost - repeated).cast("int")


def draw_key(doc_id: Column, text: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential variate with the weight as its rate, the same in every run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("bigint")
    uniform = (bits.cast("double") + 0.5) / float(1 << 52)
    rate = F.when(weight > LEAST_WEIGHT, weight.cast("double")).otherwise(F.lit(LEAST_WEIGHT))
    return -F.log(uniform) / rate


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, weight, target`` for rows ``source, size``: shares of the size of all by weight.

    Sources are ordered by code point, null last, and take the weights in turn. Each round fixes the sources whose share
    is above ``most`` times their size; when no further one is, the shares of the others stand.
    """
    owned = written(sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("source_size")), "sources")
    total = owned.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    numbered = number_rows(owned.select("source", F.col("source").isNull().alias("last")), ["last", "source"], "place")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.get(cycle, (F.col("place") % len(weights)).cast("int"))
    ranked = numbered.select(F.col("source").alias("_s"), weight.cast("bigint").alias("weight"))
    shared = written(owned.join(ranked, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "weights")
    bound = most * F.col("source_size")
    left, parts, fixed = int(total), None, -1
    while True:
        # A source is above its bound when weight * left > bound * parts; whole numbers decide without rounding.
        above = F.lit(False) if parts is None else F.col("weight") * F.lit(left).cast("decimal(30,0)") > bound * F.lit(parts).cast("decimal(30,0)")
        if parts == 0:
            above = F.lit(True)
        n, taken, free = shared.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, bound)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == fixed:
            share = F.lit(0.0) if not parts else (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(parts))
            return shared.withColumn("target", F.when(above, bound.cast("double")).otherwise(share))
        left, parts, fixed = int(total) - int(taken), int(free), n


def plan(documents: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """What the mix takes of rows ``row, source, size, key``: ``row, source_size, target, taken`` joined to them.

    ``row`` names a row and the table must be a written one.
    """
    rows = documents.count()
    shares = targets(documents.select("source", "size"), weights, most)
    budget = F.least(F.floor(F.col("target") + 0.5).cast("bigint"), most * F.col("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.call_function("div", budget, F.col("source_size"))).otherwise(F.lit(0))
    shares = shares.select(
        F.col("source").alias("_s"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest")
    )
    bounds = quantile_bounds(documents, "key", max(slice_rows, math.ceil(rows / SLICES)), rows)
    sliced = documents.withColumn("slice", bucket_of(F.col("key"), bounds, "double"))
    before = running_start(sliced, ["source"], "slice", ["key", "row"], "size", "before").drop("slice")
    joined = before.join(shares, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return joined.withColumn("part", part.cast("bigint")).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("bigint"))


def _drawn(documents: DataFrame, doc_id: str, text: str, source: str, weight: Column | None, seed: int) -> list[Column]:
    body = F.col(f"`{text}`")
    quality = quality_weight(body) if weight is None else weight
    return [
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.size(word_list(body)).cast("bigint").alias("size"),
        draw_key(F.col(f"`{doc_id}`"), body, quality, seed).alias("key"),
    ]


def mix(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
    weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, epochs, part, taken`` of every document.

    A document is in the mix ``epochs`` times whole and once more with its first ``part`` words.
    """
    drawn = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), *_drawn(documents, doc_id, text, source, weight, seed))
    planned = plan(written(drawn, "sized"), weights, most)
    return planned.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", "taken")


def mixed_texts(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
    weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """The mix itself: the documents' rows once for each ``epoch`` (from 0), with ``words_taken``.

    A text that a budget cuts is its first words, joined by one space. The documents are written once beside a name for
    each row, so that no retry can part plan and texts.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    whole = written(documents.select(doc, *_drawn(documents, doc_id, text, source, weight, seed)), "mixed")
    chosen = plan(whole.select("row", "source", "size", "key"), weights, most).where("taken > 0")
    last = F.col("epochs").cast("int") - F.when(F.col("part") > 0, 0).otherwise(1)
    chosen = chosen.select("row", "epochs", "part", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))
    joined = whole.join(chosen, "row")
    fraction = F.col("epoch") == F.col("epochs")
    cut = fraction & (F.col("part") < F.col("size"))
    body = F.col(f"doc.`{text}`")
    head = F.array_join(F.slice(word_list(body), F.lit(1), F.col("part").cast("int")), " ")
    new = {"epoch": F.col("epoch"), "words_taken": F.when(fraction, F.col("part")).otherwise(F.col("size"))}
    kept = [c for c in documents.columns if c.lower() not in new]
    values = [F.when(cut, head).otherwise(body).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in kept]
    return joined.select(*values, *[v.alias(k) for k, v in new.items()])
