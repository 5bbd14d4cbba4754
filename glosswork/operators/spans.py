"""Interval joins: tokens and spans that are tables of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.arrays import whole_div
from glosswork.plans.spread import bounded, written

BIN = 4096  # places of a text in one bin
BIN_SPANS = 10_000  # spans in a bin from which they are split


def _bins(begin: Column, end: Column, width: int) -> Column:
    return F.sequence(whole_div(begin, width), whole_div(end, width))


def span_join(
    tokens: DataFrame, spans: DataFrame, key: str = "id", width: int = BIN, bin_spans: int = BIN_SPANS
) -> DataFrame:
    """One row per token and span of one text that touch: ``key, token_no, span_no, tok``.

    ``tokens`` has ``key, token_no, b, e, tok`` and ``spans`` ``key, span_no, b, e``, places being 0 or more; as in
    ``span_match``, empty tokens match nothing and ends that only touch count. Both sides go to the bins of ``width``
    places that they reach into and meet there, so one very long text is as many tasks as it has bins. A pair is given
    out in the bin where its common part begins and nowhere else. A bin into which very many spans reach is split by a hash
    of the span, and its tokens, which don't overlap, are copied. Spans with a null end, or an end before their start, match nothing.
    """
    tokens = tokens.where("b < e").select(
        F.col(key).alias("_key"), "token_no", F.col("b").alias("_tb"), F.col("e").alias("_te"), "tok", F.explode_outer(_bins(F.col("b"), F.col("e"), width)).alias("_bin")
    )
    spans = written(
        spans.where("b <= e").select(
            F.col(key).alias("_key"), "span_no", F.col("b").alias("_sb"), F.col("e").alias("_se"), F.explode_outer(_bins(F.col("b"), F.col("e"), width)).alias("_bin")
        ),
        "spans",
    )
    full = spans.groupBy("_key", "_bin").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bin_spans)
    full = written(full.select("_key", "_bin", F.ceil(F.col("_n") / bin_spans).cast("int").alias("_parts")), "full-bins")
    at = ["_key", "_bin"]
    if full.limit(1).count():
        small = bounded(full)
        parts = full if small is None else F.broadcast(small)
        many = F.coalesce("_parts", F.lit(1))
        spans = spans.join(parts, at, "left").withColumn("_part", F.pmod(F.xxhash64("span_no", "_sb", "_se"), many).cast("int")).drop("_parts")
        tokens = tokens.join(parts, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
        at = [*at, "_part"]
    met = tokens.join(spans, at).where((F.col("_te") >= F.col("_sb")) & (F.col("_tb") <= F.col("_se")))
    once = met.where(whole_div(F.greatest("_tb", "_sb"), width) == F.col("_bin"))
    return once.select(F.col("_key").alias(key), "token_no", "span_no", "tok")
