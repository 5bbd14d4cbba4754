"""Reading experiment settings out of run names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.operators.pairs import TASK_COLUMNS

RUN_NAME = r"^([^_]+)_(.+)_([0-9]+)_([0-9.eE+-]+)_seed([0-9]+)$"


def parse_manifest(
    df: DataFrame, domain_suffix: str, run_name: str = "run_name", shots: str | None = None
) -> DataFrame:
    """Add the settings in a name ``dataset_type_batch_lr_seedN``.

    A type ending in ``domain_suffix`` (with its hyphen) loads the domain
    adapter; the part before the last hyphen is the task adapter, none for
    plain fine-tuning. The dataset decides the runner. ``shots`` names a column
    where 0 means that nothing is sampled; the result is then NULL.
    """
    part = lambda i: F.regexp_extract(run_name, RUN_NAME, i)
    kind = F.col("type")
    prefix = F.when(kind.contains("-"), F.regexp_extract(kind, "^(.*)-[^-]*$", 1)).otherwise(kind)
    runner = (
        F.when(F.col("dataset") == "csqa", "csqa").when(F.col("dataset").isin(*TASK_COLUMNS), "glue").otherwise("others")
    )
    parsed = (
        df.withColumn("dataset", part(1))
        .withColumn("type", part(2))
        .withColumn("batch_size", part(3).cast("int"))
        .withColumn("lr", part(4).cast("double"))
        .withColumn("seed", part(5).cast("bigint"))
        .withColumn("domain_adapter", kind.endswith(domain_suffix))
        .withColumn("adapter_type", F.when(prefix != "finetune", prefix))
        .withColumn("runner", runner)
    )
    if shots is not None:
        parsed = parsed.withColumn("few_shot", F.when(F.col(shots) != 0, F.col(shots)))
    return parsed
