"""Row ids for a corpus whose files keep arriving: ids that were given never move."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.plans.spread import attach, written

LEDGER = "step bigint, file string, rows bigint, first bigint"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``step, file, rows, first`` of every file that has ids; empty before the first step."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger}/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def number_new_files(spark: SparkSession, path: str, ledger: str) -> int:
    """Give the rows of parquet files that the ledger doesn't know the next ids, files by name; the number of new files.

    Only file names and row numbers are read. Each call that finds something adds one step, whose folder is named by its
    number, so that of two calls at once the second fails. A known file whose number of rows has changed is an error.
    """
    sizes = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes, "files")
    known = written(read_ledger(spark, ledger), "ledger")
    was = known.select(F.col("file").alias("_file"), F.col("rows").alias("_rows"))
    changed = sizes.join(was, F.col("file") == F.col("_file")).where(F.col("rows") != F.col("_rows")).select("file").first()
    if changed is not None:
        raise ValueError(f"rows have changed in {changed.file}")
    fresh = written(sizes.join(was, F.col("file") == F.col("_file"), "left_anti"), "new-files")
    count = fresh.count()
    if count == 0:
        return 0
    step, taken = known.agg(F.coalesce(F.max("step"), F.lit(0)), F.coalesce(F.max(F.col("first") + F.col("rows")), F.lit(0))).first()
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each new file
    first = (F.lit(taken) + F.coalesce(F.sum("rows").over(before), F.lit(0))).cast("bigint")
    rows = fresh.select(F.lit(step + 1).cast("bigint").alias("step"), "file", "rows", first.alias("first"))
    rows.write.mode("error").parquet(f"{ledger}/{step + 1:012d}")
    return count


def read_numbered(spark: SparkSession, path: str, ledger: str, text: str = "text") -> DataFrame:
    """``raw_id, text`` of the corpus's files that the ledger knows."""
    placed = spark.read.parquet(path).select(
        F.col(text).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_row")
    )
    known = read_ledger(spark, ledger).select("file", "rows", F.col("first").alias("_first"))
    found = attach(placed, known, ["file"], ["_row"], how="inner")
    return found.select((F.col("_first") + F.col("_row")).cast("bigint").alias("raw_id"), "text")
