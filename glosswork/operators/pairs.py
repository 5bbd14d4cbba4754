"""Text columns of a task: choosing them and giving them standard names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.plans.spread import attach

# The text columns of the named pair tasks.
TASK_COLUMNS = {
    "cola": ("sentence", None),
    "mnli": ("premise", "hypothesis"),
    "mrpc": ("sentence1", "sentence2"),
    "qnli": ("question", "sentence"),
    "qqp": ("question1", "question2"),
    "rte": ("sentence1", "sentence2"),
    "sst2": ("sentence", None),
    "stsb": ("sentence1", "sentence2"),
    "wnli": ("sentence1", "sentence2"),
}


def resolve_text_columns(df: DataFrame, task: str | None = None) -> tuple[str, str | None]:
    """The task's own columns, else ``sentence1, sentence2``, else the first two (or one) beside the label."""
    if task is not None:
        return TASK_COLUMNS[task]
    others = [c for c in df.columns if c != "label"]
    if {"sentence1", "sentence2"} <= set(others):
        return "sentence1", "sentence2"
    return (others[0], others[1]) if len(others) > 1 else (others[0], None)


def project_pairs(
    df: DataFrame, task: str | None = None, label_map: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``text1, text2, labels`` and nothing else but the ``keep`` columns.

    ``label_map`` (``label, label_id``) replaces the labels by ids. How many
    rows a label has is counted here unless the map's ``rows`` tells.
    """
    plain = df.drop(*keep)
    first, second = resolve_text_columns(plain, task)
    columns = [F.col(first).alias("text1")]
    if second is not None:
        columns.append(F.col(second).alias("text2"))
    if "label" not in df.columns:
        return df.select(*keep, *columns)
    if label_map is None:
        return df.select(*keep, *columns, F.col("label").alias("labels"))
    mapping = label_map
    if "rows" not in label_map.columns:
        mapping = label_map.join(df.groupBy("label").agg(F.count(F.lit(1)).alias("rows")), "label")
    mapped = attach(df, mapping.select("label", "rows", "label_id"), ["label"], [first])
    return mapped.select(*keep, *columns, F.col("label_id").alias("labels"))
