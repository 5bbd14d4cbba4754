"""Writing prompts, labelled text, embeddings and metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.functions.arrays import whole_div


def write_knowledge(df: DataFrame, path: str, file_rows: int = 1_000) -> None:
    """``id, prompt, targets`` as JSON array files, ``file_rows`` rows each, whose paths sort in id order.

    Every file has a folder of its own, named by its number in 20 digits, so the
    order holds for any number of files and tasks.
    """
    number = whole_div(F.col("id"), file_rows)
    rows = F.array_sort(F.collect_list(F.struct("id", F.to_json(F.struct("prompt", "targets")).alias("j"))))
    text = F.concat(F.lit("["), F.array_join(rows["j"], ",\n"), F.lit("]"))
    arrays = df.groupBy(number.alias("file")).agg(text.alias("value"))
    numbered = arrays.select(F.lpad(F.col("file").cast("string"), 20, "0").alias("file"), "value")
    numbered.write.partitionBy("file").text(path)


def write_task_jsonl(df: DataFrame, path: str) -> None:
    df.select("text", "label").write.json(path)


def write_embeddings(df: DataFrame, path: str, shard: str | None = None) -> None:
    """Ids and vectors side by side, in one folder per shard when there is a shard column."""
    columns = ["raw_id", "embedding"]
    if shard is None:
        df.select(*columns).write.parquet(path)
    else:
        df.select(*columns, F.col(shard).alias("shard")).write.partitionBy("shard").parquet(path)


def write_metrics(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("metric",)) -> None:
    """Append metric points. Metric names are few, so they make the folders; runs may be many."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
