"""An exact index for the largest inner products: inverted lists around directions, skipped by a bound.

A list holds the stored vectors whose direction is nearest to its centre, a vector of unit length. A vector goes some way
along its centre and some way across it, and so does a query; both products together are the most that the two can score.
A search first looks into the few lists whose centres score best; the k-th best score found there is a threshold, and of
the other lists only those whose bound reaches it are read, and in them only blocks of vectors whose own bound does. So
the hits are those of a full scan; how much is skipped depends on directions and lengths. Pairs of query and list are
never rows of that second look: blocks of queries are sent to the tasks that read the lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions.draws import HEX_SPAN, draw
from glosswork.operators.retrieval import HITS, LONGEST, QUERY_BYTES, SCAN_TASKS, _best, _Held, _matrix, _without_spare_copies
from glosswork.plans.spread import scratch_folder, written

CENTRE_BYTES = 64 << 20  # centres are sent to every task
SAMPLE_ROWS = 64  # vectors for each centre that it is fitted on
ROUNDS = 6  # of moving the centres
PART_ROWS = 4096  # vectors of a list, and queries of a list, that one task compares at a time
FIRST_LISTS = 4  # lists that every query looks into
SLACK = 1e-8  # more than scores are rounded by
ROUNDED = 1e-11  # share of a score's greatest value that its bounds may be off by
ROUNDING = 1e-13  # share of a length's square that a difference of squares may be off by
NAMED_LISTS = 10_000  # lists that a filter names one by one
BOUND_ROWS = 128  # vectors of a list that have a bound of their own
BOUND_STEPS = 256  # directions of a query to a centre that a bound tells apart
AXES = 22  # directions in which pairs are compared before all of their numbers are
PAIR_ROWS = 2048  # queries of one such product
NEAR_SHARE = 0.03  # pairs that it may leave, beyond which whole vectors are compared at once
LISTS_AT_ONCE = 8  # lists whose centres are multiplied with the queries at once
BLOCKS_AT_ONCE = 2  # blocks of queries under way, so that one is sent while another is compared


@dataclass
class VectorIndex:
    """``lists`` has ``list, part, raw_id, v``; ``centres`` has a row for each list.

    That is ``list, centre, rows``, the least and most that its vectors go along the centre (``low, high``), the most that they
    go across it (``off``) and the length of the longest.
    """

    lists: DataFrame
    centres: DataFrame

    def shared(self) -> Broadcast:
        """Centres, their bounds, sizes, list numbers and main axes, at most ``CENTRE_BYTES`` and a little."""
        found = self.centres.orderBy("list").toArrow()
        bounds = tuple(found[name].to_numpy() for name in ("low", "high", "off", "longest"))
        centres, rows = _matrix(found["centre"]), found["rows"].to_numpy()
        weighed = np.nan_to_num(centres) * np.sqrt(rows)[:, None]
        axes = np.linalg.eigh(weighed.T @ weighed)[1][:, ::-1][:, :AXES]
        arrays = centres, bounds, rows, found["list"].to_numpy(), axes
        return self.centres.sparkSession.sparkContext.broadcast(arrays)


def _directions(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre nearest to the direction of every vector, the lowest number among equals."""
    least = np.empty(len(vectors), np.int64)
    step = max(1, (4 << 20) // len(centres))
    for at in range(0, len(vectors), step):
        least[at : at + step] = (vectors[at : at + step] @ centres.T).argmax(axis=1)
    return least


def _split(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each vector goes along its centre, and across it."""
    along = (vectors * centres).sum(axis=1)
    off = vectors - along[:, None] * centres
    return along, np.sqrt((off * off).sum(axis=1))


def fit_centres(vectors: DataFrame, count: int, key: str = "raw_id", vector: str = "v", rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """At most ``count`` directions from ``rounds`` rounds of k-means on those of about ``SAMPLE_ROWS`` vectors for each.

    The sample and the first centres are the vectors with the smallest draws of their keys, so they don't depend on the
    order of the rows. Each task adds up its vectors by centre; only those sums are combined.
    """
    total = vectors.count()
    chance = min(1.0, SAMPLE_ROWS * count / max(1, total))
    drawn = vectors.select(F.col(vector).alias("v"), draw(seed, F.col(key).cast("string")).alias("d"), F.col(key).alias("k"))
    sample = written(drawn.where(F.col("d") < int(math.ceil(chance * HEX_SPAN))), "sample")
    first = sample.orderBy("d", "k").limit(count).toArrow()
    centres = np.unique(np.round(_directions(_matrix(first["v"])), 12), axis=0)
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, rows = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
            for batch in batches:
                if batch.num_rows:
                    matrix = _directions(_matrix(batch["v"]))
                    near = _nearest(matrix, shared.value)
                    np.add.at(total, near, matrix)
                    rows += np.bincount(near, minlength=len(rows))
            some = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(rows[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["centre", "n", "total"]
            )

        parts = sample.select("v").mapInArrow(sums, "centre bigint, n bigint, total array<double>")
        each = parts.select("centre", "n", F.posexplode("total").alias("dim", "x")).groupBy("centre", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        moved = each.groupBy("centre").agg(F.array_sort(F.collect_list(F.struct("dim", (F.col("x") / F.col("n")).alias("x"))))["x"].alias("mean"))
        found = moved.toArrow()
        centres = centres.copy()
        centres[found["centre"].to_numpy()] = _directions(_matrix(found["mean"]))
        shared.unpersist()
    return np.unique(np.round(centres, 12), axis=0)


def build_index(
    record: DataFrame, path: str, lists: int | None = None, raw_id: str = "raw_id", vector: str = "embedding", part_rows: int = PART_ROWS
) -> VectorIndex:
    """Write every vector of the record to the list of its nearest direction, a partition of the table under ``path``.

    By default there are as many lists as the square root of the number of vectors, and never more centres than fit
    ``CENTRE_BYTES``. A list that holds very many vectors, such as copies of one, is many parts.
    """
    spark = record.sparkSession
    # Written, as it is read several times.
    named = written(record.select(F.col(raw_id).cast("bigint").alias("raw_id"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    rows, width = named.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    count = min(lists or max(1, round(math.sqrt(rows))), max(1, CENTRE_BYTES // (8 * max(1, width))))
    centres = fit_centres(named, count) if rows else np.zeros((1, width))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch["v"])
                near = _nearest(matrix, shared.value)
                along, across = _split(matrix, shared.value[near])
                named = [batch["raw_id"], batch["v"], pa.array(near), pa.array(along), pa.array(across)]
                yield pa.RecordBatch.from_arrays(named, ["raw_id", "v", "list", "along", "across"])

    placed = written(named.mapInArrow(assign, "raw_id bigint, v array<double>, list bigint, along double, across double"), "placed")
    longest = F.max(F.hypot("along", "across"))
    held = placed.groupBy("list").agg(
        F.count(F.lit(1)).alias("rows"), F.min("along").alias("low"), F.max("along").alias("high"), F.max("across").alias("off"), longest.alias("longest")
    )
    found = held.toArrow()
    table = found.append_column("centre", pa.array(list(centres[found["list"].to_numpy()]), pa.list_(pa.float64())))
    schema = T.StructType.fromDDL("list bigint, rows bigint, low double, high double, off double, longest double, centre array<double>")
    small = spark.createDataFrame(table, schema=schema) if table.num_rows else spark.createDataFrame([], schema)
    small.coalesce(1).write.parquet(f"{path}/centres")
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    sized = placed.join(F.broadcast(small.select("list", parts.alias("parts"))), "list")
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("raw_id"), F.col("parts")).cast("int")).select("raw_id", "v", "part", "list")
    dealt.repartition("list", "part").write.partitionBy("list").parquet(f"{path}/lists")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    lists = spark.read.schema("raw_id bigint, v array<double>, part int, list bigint").parquet(f"{path}/lists")
    return VectorIndex(lists, spark.read.parquet(f"{path}/centres"))


def _chosen(asked: np.ndarray, k: int, centres: np.ndarray, rows: np.ndarray, first: int) -> np.ndarray:
    """Which lists every query looks into first: the best centres, ``first`` at least and enough to hold ``k`` vectors."""
    scores = asked @ centres.T
    mask, each, held = np.zeros(scores.shape, bool), np.arange(len(asked)), np.zeros(len(asked), np.int64)
    for place in range(len(rows)):
        # Only queries whose lists hold too few vectors go on after the first ones.
        each = each if place < first else each[held[each] < k]
        if not len(each):
            break
        best = scores[each].argmax(axis=1) if place >= first else scores.argmax(axis=1)
        mask[each, best], scores[each, best] = True, -np.inf
        held[each] += rows[best]
    return mask


def _reached(asked: np.ndarray, least: np.ndarray, centres: np.ndarray, bounds: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which lists can hold a vector that scores ``least``, for every query."""
    low, high, off, longest = bounds
    square = (asked * asked).sum(axis=1)[:, None]
    along, length = asked @ centres.T, np.sqrt(square)
    across = np.sqrt(np.maximum(square - along * along, 0) + ROUNDING * square)
    most = np.minimum(np.maximum(along * low, along * high) + across * off, length * longest)
    return ~(most + ROUNDED * length * longest < least[:, None] - SLACK * (1 + length))


def _probes(queries: DataFrame, shared: Broadcast, k: int, first: int) -> DataFrame:
    """``query_id, v, list``: the first lists of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _, rows, numbers, _ = shared.value
        step = max(1, (2 << 20) // max(1, len(rows)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(rows) else 0, step):
                part = batch.slice(at, step)
                who, which = np.nonzero(_chosen(_matrix(part["v"]), k, centres, rows, first))
                for i in range(0, len(who), PART_ROWS):
                    take = pa.array(who[i : i + PART_ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [part["query_id"].take(take), part["v"].take(take), pa.array(numbers[which[i : i + PART_ROWS]])], ["query_id", "v", "list"]
                    )

    return queries.mapInArrow(run, "query_id bigint, v array<double>, list bigint")


def _rest(queries: DataFrame, shared: Broadcast, k: int, first: int) -> DataFrame:
    """``query_id, list`` of the other lists whose bound reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, bounds, rows, numbers, _ = shared.value
        step = max(1, (2 << 20) // max(1, len(rows)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(rows) else 0, step):
                part = batch.slice(at, step)
                asked = _matrix(part["v"])
                mask = ~_chosen(asked, k, centres, rows, first) & _reached(asked, part["least"].to_numpy(), centres, bounds)
                who, which = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays([part["query_id"].take(pa.array(who)), pa.array(numbers[which])], ["query_id", "list"])

    return queries.mapInArrow(run, "query_id bigint, list bigint")


def _needed(queries: DataFrame, shared: Broadcast) -> list[int]:
    """Numbers of the lists that some query of the table can have a hit in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, bounds, rows, numbers, _ = shared.value
        step = max(1, (2 << 20) // max(1, len(rows)))
        some = np.zeros(len(rows), bool)
        for batch in batches:
            for at in range(0, batch.num_rows if len(rows) else 0, step):
                part = batch.slice(at, step)
                some |= _reached(_matrix(part["v"]), part["least"].to_numpy(), centres, bounds).any(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[some], pa.int64())], ["list"])

    return queries.mapInArrow(run, "list bigint").distinct().toArrow()["list"].to_pylist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, vectors and ids of each list in turn, at most about ``PART_ROWS`` of one at a time."""
    number, parts = None, []

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        return number, np.vstack([v for v, _ in parts]), np.concatenate([i for _, i in parts])

    for batch in batches:
        if not batch.num_rows:
            continue
        stored, ids, lists = _matrix(batch["v"]), batch["raw_id"].to_numpy(), batch["list"].to_numpy()
        begins = np.flatnonzero(np.diff(lists, prepend=lists[0] - 1))
        for begin, end in zip(begins, np.append(begins[1:], len(lists))):
            if parts and (lists[begin] != number or sum(len(i) for _, i in parts) + end - begin > PART_ROWS):
                yield whole()
                parts = []
            number = lists[begin]
            parts.append((stored[begin:end], ids[begin:end]))
    if parts:
        yield whole()


def _steps(cosine: np.ndarray) -> np.ndarray:
    """Which of the ``BOUND_STEPS`` stretches of cosines a query's cosine to a centre lies in."""
    return np.fmin(np.fmax((cosine + 1) * (BOUND_STEPS / 2), 0), BOUND_STEPS - 1).astype(np.int64)


def _most(along: np.ndarray, across: np.ndarray) -> np.ndarray:
    """The largest score that a query of unit length can have with a block of vectors, by the stretch its cosine lies in.

    A vector that goes ``along`` a centre and ``across`` it scores at most ``along cos + across sin`` with a query at that
    angle to the centre. Over a stretch of angles that is greatest at an end, or where both angles are the same.
    """
    cosine = np.linspace(-1.0, 1.0, BOUND_STEPS + 1)
    edges = (np.outer(cosine, along) + np.outer(np.sqrt(1 - cosine * cosine), across)).max(axis=1)
    most, length = np.maximum(edges[:-1], edges[1:]), np.hypot(along, across)
    np.maximum.at(most, _steps(np.divide(along, length, out=np.zeros_like(along), where=length > 0)), length)
    return most + ROUNDED * length.max()


def _pieces(along: np.ndarray, heads: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Vectors as the way along a centre, their places on a few axes across it and the length of what is left.

    The product of two such rows is the most that the two vectors can score.
    """
    rest = np.sqrt(np.maximum(square - along * along - (heads * heads).sum(axis=1), 0) + ROUNDING * square)
    return np.column_stack([along, heads, rest]).astype(np.float32)


class _Compared:
    """The queries of one block, as the tasks compare them with lists."""

    def __init__(self, asked: np.ndarray, least: np.ndarray, k: int, axes: np.ndarray):
        self.held, self.axes, self.heads = _Held(asked, k, least), axes, asked @ axes
        self.per_length = np.divide(1.0, self.held.length, out=np.ones_like(self.held.length), where=self.held.length > 0)

    def add(self, runs: list[tuple[int, np.ndarray, np.ndarray]], centres: np.ndarray) -> None:
        """Take in a few lists, each with its centre."""
        held = self.held
        # What a query of unit length would have to score; nothing is left out for one without length.
        edges = held.edges(np.arange(len(held.asked)))
        need = np.where(held.length > 0, (edges - SLACK) * self.per_length, -np.inf)
        for (_, stored, ids), centre, way in zip(runs, centres, centres @ held.asked.T):
            self._add_list(*_without_spare_copies(stored, ids, held.k), centre, way, need, edges)

    def _add_list(self, stored: np.ndarray, ids: np.ndarray, centre: np.ndarray, way: np.ndarray, need: np.ndarray, edges: np.ndarray) -> None:
        held, along, across = self.held, *_split(stored, centre[None, :])
        order, lowest, blocks = np.argsort(-across, kind="stable"), need.min(), []
        for at in range(0, len(order), BOUND_ROWS):
            block = order[at : at + BOUND_ROWS]
            most = _most(along[block], across[block])
            if not most.max() < lowest:
                blocks.append((block, most))
        if not blocks:
            return
        step = _steps(way * self.per_length)
        some = np.flatnonzero(~(np.max([most for _, most in blocks], axis=0)[step] < need))
        step, need = step[some], need[some]
        pieces = _pieces(along, (stored - along[:, None] * centre) @ self.axes, (stored * stored).sum(axis=1))
        longest = float(np.hypot(along, across).max())
        quick = held.plain and longest < LONGEST
        if quick:
            asked, middle = np.empty((len(some), pieces.shape[1]), np.float32), centre @ self.axes
            for at in range(0, len(some), PART_ROWS):
                part = some[at : at + PART_ROWS]
                asked[at : at + PART_ROWS] = _pieces(way[part], self.heads[part] - way[part][:, None] * middle, held.length[part] ** 2)
            slack = (pieces.shape[1] + 16) * 2.0**-22 * held.length[some] * longest + SLACK
            low = np.nextafter((edges[some] - slack).astype(np.float32), np.float32(-np.inf))
        for block, most in blocks:
            wanted = np.flatnonzero(~(most[step] < need))
            if not quick:
                held.add_block(stored[block], ids[block], some[wanted])
            elif len(wanted):
                self._add_near(stored[block], ids[block], pieces[block], some, wanted, asked, low)

    def _add_near(self, block: np.ndarray, ids: np.ndarray, pieces: np.ndarray, some: np.ndarray, wanted: np.ndarray, asked: np.ndarray, low: np.ndarray) -> None:
        """Compare a block of vectors with the ``wanted`` ones of ``some`` queries, by their pieces first."""
        for at in range(0, len(wanted), PAIR_ROWS):
            part = wanted[at : at + PAIR_ROWS]
            most = pieces @ asked[part].T
            near = np.flatnonzero(most.max(axis=0) >= low[part])
            if not len(near):
                continue
            who, which = np.nonzero(most[:, near].T >= low[part[near], None])
            if len(who) > NEAR_SHARE * len(part) * len(block):
                self.held.add_block(block, ids, some[wanted[at:]])
                return
            self.held.add_pairs(some[part[near]], block, ids, who, which)


def _scan_lists(queries: DataFrame, lists: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """The best ``k`` of every query of one block that score ``least`` or more, from the lists, which lie list by list.

    The queries are sent to every task. The vectors of a list are ordered by how far they lie off the line through its
    centre and cut into blocks; a block is compared with those queries alone whose bound for it reaches what they look for.
    """
    table = queries.toArrow()
    sent = queries.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), _matrix(table["v"]), table["least"].to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked, least = sent.value
        centres, _, _, numbers, axes = shared.value
        if not len(query_ids):
            return
        compared, runs = _Compared(asked, least, k, axes), _runs(batches)
        while some := list(islice(runs, LISTS_AT_ONCE)):
            compared.add(some, centres[np.searchsorted(numbers, [number for number, _, _ in some])])
        yield compared.held.hits(query_ids)

    return lists.mapInArrow(scan, HITS)


def _search_lists(probes: DataFrame, index: VectorIndex, k: int, part_rows: int) -> DataFrame:
    """The best ``k`` of every query in every part of the lists it looks into.

    Queries and vectors of one list meet in cells of at most about ``part_rows`` of each.
    """
    asked = written(probes, "probes")
    counts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("chunks"))
    # One row for each list at most, so the broadcast is bounded like the centres.
    plan = F.broadcast(counts.join(index.centres.select("list", F.ceil(F.col("rows") / part_rows).cast("int").alias("parts")), "list"))
    left = asked.join(plan, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), "query_id", "v"
    )
    cut = F.pmod(F.xxhash64("raw_id"), F.col("parts")).cast("int")
    right = index.lists.join(plan, "list").select(
        "list", cut.alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "raw_id", "v"
    )

    def cell(queries: pa.Table, stored: pa.Table) -> pa.Table:
        if not queries.num_rows or not stored.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "raw_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        held = _Held(_matrix(queries["v"]), k)
        held.add(_matrix(stored["v"]), stored["raw_id"].to_numpy())
        return pa.Table.from_batches([held.hits(queries["query_id"].to_numpy())])

    keys = ("list", "part", "chunk")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, HITS)


def search_index(
    queries: DataFrame,
    index: VectorIndex,
    k: int,
    query_id: str = "id",
    vector: str = "embedding",
    first_lists: int = FIRST_LISTS,
    part_rows: int = PART_ROWS,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """``query_id, rank, raw_id, score`` as ``retrieve_topk`` gives them, from the lists that can hold a hit."""
    hits, _ = search_with_probes(queries, index, k, query_id, vector, first_lists, part_rows, query_bytes)
    return hits


def search_with_probes(
    queries: DataFrame,
    index: VectorIndex,
    k: int,
    query_id: str = "id",
    vector: str = "embedding",
    first_lists: int = FIRST_LISTS,
    part_rows: int = PART_ROWS,
    query_bytes: int = QUERY_BYTES,
    query_block: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``search_index``, and ``query_id, list`` of every list that a query looked into.

    More than ``query_bytes`` of queries go in blocks of that size, or of ``query_block`` queries, with one look into the
    lists each. The lists are dealt to the tasks once for all blocks.
    """
    spark, shared = queries.sparkSession, index.shared()
    asked = written(queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).cast("array<double>").alias("v")), "asked")
    first = _probes(asked, shared, k, first_lists)
    found = written(_best(_search_lists(first, index, k, part_rows), k), "hits")
    edge = found.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), "score")
    rows, width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    block = query_block or max(1, query_bytes // max(1, 8 * width))
    blocks = max(1, math.ceil(rows / block))
    # A query with fewer than k hits has no threshold yet.
    thresholds = asked.join(edge, F.col("query_id") == F.col("_q"), "left").select(
        "query_id", "v", F.coalesce("score", F.lit(-math.inf)).alias("least"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    )
    rest = lambda known: first.select("query_id", "list").union(_rest(known, shared, k, first_lists))
    tasks = SCAN_TASKS * spark.sparkContext.defaultParallelism
    # Lists stay together, so that each is compared at once; of long ones their parts do.
    dealt = lambda lists: lists.repartition(tasks, "list", "part").sortWithinPartitions("list")
    if blocks == 1:
        known, lists = written(thresholds, "thresholds"), index.lists
        needed = _needed(known, shared)
        if len(needed) <= min(NAMED_LISTS, len(shared.value[3]) - 1):
            lists = lists.where(F.col("list").isin(needed))
        return _best(_scan_lists(known.drop("block"), dealt(lists), shared, k), k), rest(known)
    path = scratch_folder(spark, "thresholds")
    thresholds.repartition("block").write.partitionBy("block").parquet(path)
    known = spark.read.schema(thresholds.schema).parquet(path)
    kept = dealt(index.lists).persist(StorageLevel.DISK_ONLY)

    def look(number: int) -> DataFrame:
        part = known.where(F.col("block") == number).drop("block")
        return written(_best(_scan_lists(part, kept, shared, k), k), "hits")

    with ThreadPoolExecutor(BLOCKS_AT_ONCE) as pool:
        found = list(pool.map(look, range(blocks)))
    kept.unpersist()
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    return hits, rest(known)
