"""Multiple-choice items: one row per choice and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def choice_expand(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """One row per question and choice; a question without exactly ``n`` choices is an error."""
    found = F.size("choices.text")
    wrong = F.raise_error(F.concat(F.lit("wrong number of choices: "), found.cast("string")))
    checked = F.when(found == n, F.col("choices.text")).otherwise(wrong.cast("array<string>"))
    return df.select(key, "question", "answerKey", F.posexplode(checked).alias("choice", "choice_text"))


def choice_regroup(df: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    """Scores per choice back to one row: ``key, scores, winner``, ties to the lowest choice."""
    best = F.max_by("choice", F.struct(F.col("score"), -F.col("choice")))
    scores = F.array_sort(F.collect_list(F.struct("choice", "score")))
    grouped = df.groupBy(key).agg(scores.alias("_s"), best.alias("winner"))
    wrong = F.raise_error(F.lit("wrong number of scores")).cast("array<double>")
    lists = F.when(F.size("_s") == n, F.col("_s.score").cast("array<double>")).otherwise(wrong)
    return grouped.select(key, lists.alias("scores"), "winner")
