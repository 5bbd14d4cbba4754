"""Reading prompts, labelled text, task splits, corpora and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.operators.ids import dense_row_id
from glosswork.operators.pairs import TASK_COLUMNS
from glosswork.plans.spread import attach, written
from glosswork.sources.json_arrays import read_json_array

KNOWLEDGE = "prompt string, targets array<string>"
TASK = "text string, label string"
CHOICE_TASK = "csqa"


PLACE = ("_metadata.file_path", "_metadata.file_block_start")


def _in_file_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with each row's file, block and a number that grows within the block."""
    file, block = PLACE
    return df.select(
        *columns,
        F.col(file).alias("_file"),
        F.col(block).alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _numbered(placed: DataFrame, name: str) -> DataFrame:
    """Ids in file order: files by path, blocks and rows as they stand in a file.

    Nothing is sorted. Rows of a block are consecutive already, so counting each
    block and adding up the counts of earlier ones is enough. That table has a
    row per block read. Which rows a task reads may change with the number of
    cores, so the rows have been written once.
    """
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_low"))
    found = attach(placed, _starts(blocks, ["_file", "_block"]), ["_file", "_block"], ["_row"], "_n", "inner")
    return found.withColumn(name, (F.col("_start") + F.col("_row") - F.col("_low")).cast("bigint"))


def _starts(sizes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_start``, the rows in all earlier files or blocks."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def read_knowledge(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Prompts from JSON array files of ``{prompt, targets}``: ``id, prompt, targets``.

    ``path`` may be a folder of such files, which are taken in name order. Each file
    is read by one task, or with ``split``, for large files, by many
    (``read_json_array``). Malformed JSON fails.
    """
    if split:
        return read_json_array(spark, path, KNOWLEDGE)
    raw = spark.read.schema(KNOWLEDGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    placed = written(_in_file_order(raw, ["prompt", "targets"]), "file-order")
    return _numbered(placed, "id").select("id", "prompt", "targets")


def read_task_jsonl(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Labelled text, one JSON object per line. ``numbered`` adds ids in file order."""
    raw = spark.read.schema(TASK).option("mode", "FAILFAST").json(path)
    if not numbered:
        return raw
    placed = written(_in_file_order(raw, ["text", "label"]), "file-order")
    return _numbered(placed, "id").select("id", "text", "label")


def read_custom(
    spark: SparkSession, train: str, valid: str, schema: str | None = None, multi_line: bool = False
) -> dict[str, DataFrame]:
    """Train and validation data from csv or json, told apart by extension.

    Without a schema, a csv file is read twice to infer one. ``multi_line`` reads
    csv with line breaks inside quotes; such a file is not split between tasks.
    """

    def one(path: str) -> DataFrame:
        extension = path.rstrip("/").rsplit(".", 1)[-1]
        if extension not in ("csv", "json"):
            raise ValueError(f"expected a .csv or .json file: {path}")
        reader = spark.read.option("mode", "FAILFAST")
        if schema is not None:
            reader = reader.schema(schema)
        if extension == "json":
            return reader.json(path)
        reader = reader.option("header", True).option("quote", '"').option("escape", '"')
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.option("multiLine", multi_line).csv(path)

    if train.rstrip("/").rsplit(".", 1)[-1] != valid.rstrip("/").rsplit(".", 1)[-1]:
        raise ValueError("train and validation files must have the same extension")
    return {"train": one(train), "validation": one(valid)}


def read_corpus(spark: SparkSession, path: str, text: str = "text", order: str | None = None) -> DataFrame:
    """``raw_id, text`` from a parquet corpus, other columns unread.

    Ids follow ``order``, a unique column, or else the order of the files.
    """
    raw = spark.read.parquet(path)
    if order is not None:
        return dense_row_id(raw.select(order, F.col(text).alias("text")), [order], "raw_id").select("raw_id", "text")
    # Parquet knows each row's place in its file.
    placed = raw.select(
        F.col(text).alias("text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    found = attach(placed, _starts(sizes, ["_file"]), ["_file"], ["_row"], "_n", "inner")
    return found.select((F.col("_start") + F.col("_row")).cast("bigint").alias("raw_id"), "text")


def read_embeddings(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """The retrieval record ``raw_id, embedding`` of all shards, or of one."""
    stored = spark.read.parquet(path)
    if shard is not None:
        stored = stored.where(F.col("shard") == shard)
    return stored.select("raw_id", "embedding")


def load_named_task(spark: SparkSession, name: str, root: str) -> dict[str, DataFrame]:
    """The splits of a task stored as ``root/name/split.parquet``.

    Pair tasks give their text columns and the label; the multiple-choice task
    gives ``question, choices, answerKey``. mnli validates on its matched split and
    has the other one as ``validation_mismatched``.
    """
    if name == CHOICE_TASK:
        columns = ["question", "choices", "answerKey"]
    elif name in TASK_COLUMNS:
        columns = [c for c in TASK_COLUMNS[name] if c] + ["label"]
    else:
        raise ValueError(f"unknown task: {name}")
    validation = "validation_matched" if name == "mnli" else "validation"

    def split(which: str) -> DataFrame:
        stored = spark.read.parquet(f"{root.rstrip('/')}/{name}/{which}.parquet")
        return stored.select(*[c for c in ("id",) if c in stored.columns], *columns)

    found = {"train": split("train"), "validation": split(validation)}
    if name == "mnli":
        found["validation_mismatched"] = split("validation_mismatched")
    return found


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
