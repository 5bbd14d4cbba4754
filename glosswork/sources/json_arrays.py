"""Reading one large JSON array in many tasks.

A text scan with ``}`` as its line end cuts a file anywhere and gives the fragments between braces, so any number of tasks
can share a file. What a fragment means depends on whether it starts inside a string and how deep: each byte range adds up
its quotes and braces for both cases, and running sums over the ranges give every range its start. A second scan then
cuts each range into whole records, which are parsed where they are; only a record that crosses from one range into
another is put together from pieces. Texts are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.plans.spread import attach, bounded, written

RANGES = 1_000_000  # byte ranges whose starts may be sent to every task
RANGE_BYTES = 256 << 20
SPACE = r"[ \t\r\n]*"


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, range, row, text, quotes, even, odd``: opening braces between even and odd numbers of quotes."""
    raw = spark.read.option("lineSep", "}").text(path)
    # Escapes stand in strings alone and don't reach over a closing brace, which needs none.
    plain = F.regexp_replace("value", r"\\.", "")
    parts = F.split(F.regexp_replace(plain, r'[^{"]', ""), '"', -1)
    braces = lambda rest: F.aggregate(F.filter(parts, lambda _, i: i % 2 == rest), F.lit(0), lambda n, p: n + F.length(p))
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.col("value").alias("text"),
        (F.size(parts) - 1).alias("quotes"),
        braces(0).alias("even"),
        braces(1).alias("odd"),
    )


def _spans(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of one range's fragments, in order."""
    if not batch.num_rows:
        return
    files, starts = batch["file"].dictionary_encode(), batch["range"].to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(starts, prepend=-1) != 0)).tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield (batch["file"][a].as_py(), int(starts[a])), batch.slice(a, b - a)


def _walk(part: pa.RecordBatch, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a string is open after each fragment, and by how much each changes the depth, its closing brace included."""
    after = (inside + np.cumsum(part["quotes"].to_numpy())) % 2
    before = np.append(inside, after[:-1])
    opened = np.where(before == 0, part["even"].to_numpy(), part["odd"].to_numpy())
    return after, opened - (after == 0)


def _range_sums(fragments: DataFrame) -> DataFrame:
    """``file, range, quotes, outside, inside``: how a range changes the depth when it starts outside or inside a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for at, part in _spans(batch):
                own = sums.setdefault(at, [0, 0, 0])
                for start in (0, 1):
                    own[1 + start] += int(_walk(part, (start + own[0]) % 2)[1].sum())
                own[0] = (own[0] + int(part["quotes"].to_numpy().sum())) % 2
        columns = [[k[0] for k in sums], [k[1] for k in sums], *[[v[i] for v in sums.values()] for i in range(3)]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "range", "quotes", "outside", "inside"])

    return fragments.drop("text").mapInArrow(run, "file string, range bigint, quotes bigint, outside bigint, inside bigint")


def _pieces(fragments: DataFrame) -> DataFrame:
    """``file, range, n, ends, text``: the records that end in a range, in order, and what is left behind the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, string, depth, n, pending = None, 0, 0, 0, []
        rows: list[tuple] = []

        def cut() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, ["file", "range", "n", "ends", "text"])

        for batch in batches:
            for key, part in _spans(batch):
                if key != at:
                    if pending:
                        rows.append((*at, n, False, "}".join(pending) + "}"))
                    at, n, pending = key, 0, []
                    string, depth = part["start_string"][0].as_py(), part["start_depth"][0].as_py()
                after, change = _walk(part, string)
                level = depth + np.cumsum(change)
                string, depth = int(after[-1]), int(level[-1])
                texts = part["text"].to_pylist()
                begin = 0
                for end in (np.flatnonzero((after == 0) & (level == 0)) + 1).tolist():
                    rows.append((*at, n, True, "}".join([*pending, *texts[begin:end]]) + "}"))
                    n, begin, pending = n + 1, end, []
                pending += texts[begin:]
            yield cut()
        if pending:
            rows.append((*at, n, False, "}".join(pending) + "}"))
        yield cut()

    return fragments.mapInArrow(run, "file string, range bigint, n bigint, ends boolean, text string")


def _in_order(fragments: DataFrame, starts: DataFrame) -> DataFrame:
    """Fragments with their range's start; they stay where they were read while the starts prove small enough to send."""
    small = bounded(starts, RANGES, RANGE_BYTES)
    if small is not None:
        return fragments.join(F.broadcast(small), ["file", "range"])
    rows = written(fragments.withColumn("row", F.monotonically_increasing_id()), "fragments")
    return rows.join(starts, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "row")


def read_json_array(spark: SparkSession, path: str, schema: str, name: str = "id") -> DataFrame:
    """The objects of JSON array files with consecutive ids in the order of files, by name, and of places in them.

    Malformed files fail: when they are scanned if their braces, quotes or commas don't make an array, else when the
    record is parsed.
    """
    fragments = _fragments(spark, path)
    sums = written(_range_sums(fragments), "ranges")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    strings = sums.withColumn("start_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("start_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    depths = F.coalesce(F.sum(change).over(before), F.lit(0))
    starts = strings.select("file", "range", "start_string", depths.alias("start_depth"))
    pieces = written(_pieces(_in_order(fragments, starts)), "pieces")

    ranges = pieces.groupBy("file", "range").agg(F.count_if("ends").alias("records"), F.count_if(~F.col("ends")).alias("left"))
    after = Window.partitionBy("file").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    target = F.first(F.when(F.col("records") > 0, F.col("range")), ignorenulls=True).over(after)
    linked = ranges.withColumn("target", target).withColumn("first", F.coalesce(F.sum("records").over(earlier), F.lit(0)) == 0)
    linked = written(linked, "ranges")
    tails = pieces.where(~F.col("ends")).join(linked.where("left > 0").select("file", "range", "target"), ["file", "range"])
    tails = written(tails, "tails")  # one row for each range at most

    rest = tails.where(F.col("target").isNull()).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("range", "text")))["text"], "").alias("rest"))
    held = linked.groupBy("file").agg(F.sum("records").alias("records")).join(rest, "file", "left")
    closed = F.when(F.col("records") > 0, F.col("rest").rlike(rf"^{SPACE}\]{SPACE}\}}$")).otherwise(F.col("rest").rlike(rf"^{SPACE}\[{SPACE}\]{SPACE}\}}$"))
    bad = held.where(~F.coalesce(closed, F.lit(False))).select("file").first()
    if bad is not None:
        raise ValueError(f"not a JSON array: {bad.file}")

    whole = pieces.where("ends").join(
        tails.where(F.col("target").isNotNull()).select("file", F.col("target").alias("range"), F.lit(0).cast("bigint").alias("n")).distinct(),
        ["file", "range", "n"],
        "left_anti",
    )
    heads = pieces.where("ends AND n = 0").join(tails.where(F.col("target").isNotNull()).select("file", F.col("target").alias("range")).distinct(), ["file", "range"], "left_semi")
    parts = tails.where(F.col("target").isNotNull()).select("file", F.col("target").alias("to"), "range", "text")
    parts = parts.unionByName(heads.select("file", F.col("range").alias("to"), "range", "text"))
    joined = parts.groupBy("file", F.col("to").alias("range")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("range", "text")))["text"], "").alias("text"))
    records = whole.select("file", "range", "n", "text").unionByName(joined.select("file", "range", F.lit(0).cast("bigint").alias("n"), "text"))

    ordered = Window.orderBy("file", "range").rowsBetween(Window.unboundedPreceding, -1)
    counts = linked.select("file", "range", "first", F.col("records").alias("_n"), F.coalesce(F.sum("records").over(ordered), F.lit(0)).alias("_start"))
    placed = attach(records, counts, ["file", "range"], ["n"], "_n", "inner")
    opening = F.regexp_extract("text", rf"^{SPACE}([\[,]){SPACE}\{{", 1)
    wanted = F.when(F.col("first") & (F.col("n") == 0), "[").otherwise(",")
    body = F.when(opening == wanted, F.expr("substring(text, locate('{', text))")).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON array: "), "file"))
    )
    parsed = F.from_json(body, schema, {"mode": "FAILFAST"})
    return placed.select((F.col("_start") + F.col("n")).cast("bigint").alias(name), parsed.alias("_record")).select(name, "_record.*")
