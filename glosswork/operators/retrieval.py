"""Embedding a corpus, finding the nearest documents and using them as text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.functions.draws import draw
from glosswork.functions.text import snippet
from glosswork.functions.text import tokens as token_list
from glosswork.operators.packing import length_batches
from glosswork.plans.spread import HOT_ROWS, hot_lookup, scratch_folder, written

QUERY_BYTES = 64 << 20  # queries up to this size are sent to every task
SCAN_TASKS = 4  # tasks for each core that scan the record: each gives out k hits for every query
SCORE_CELLS = 4 << 20  # scores held at once
ASKED_ROWS, STORED_ROWS = 512, 2048  # queries and vectors of one product in single precision
FIRST_ROWS = 256  # vectors of the first one, when no k-th score is known
NEAR_PAIRS = 64  # pairs for each query of a slice that are scored singly
LONGEST = 1e15  # vectors up to this length are compared in single precision first
SCORE_DIGITS = 9  # scores closer than this rank as equal, whatever the block shapes
HITS = "query_id bigint, raw_id bigint, score double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row, highest score first and then lowest id.

    A wide matrix is first narrowed to the columns that reach some row's k-th score.
    """
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > 4 * k:
        edge = np.partition(scores, -k, axis=1)[:, -k]
        width = int((scores >= edge[:, None]).sum(axis=1).max())
        near = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, near, 1), np.take_along_axis(ids, near, 1)
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _score(
    asked: np.ndarray, stored: np.ndarray, ids: np.ndarray, k: int, held: tuple | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Best k of the stored vectors and of those already held, a slice of queries at a time."""
    step = max(1, SCORE_CELLS // len(stored))
    found = [
        _top(np.round(asked[i : i + step] @ stored.T, SCORE_DIGITS), ids, k) for i in range(0, len(asked), step)
    ]
    scores, best = np.vstack([f[0] for f in found]), np.vstack([f[1] for f in found])
    if held is None:
        return scores, best
    return _top(np.hstack([held[0], scores]), np.hstack([held[1], best]), k)


def _without_spare_copies(stored: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors that are equal only the ``k`` lowest ids: no others can be hits."""
    if len(stored) <= k or not stored.shape[1]:
        return stored, ids
    whole = np.ascontiguousarray(stored).view(np.dtype((np.void, stored.dtype.itemsize * stored.shape[1]))).ravel()
    _, group = np.unique(whole, return_inverse=True)
    if group.max() + 1 == len(stored):
        return stored, ids
    order = np.lexsort((ids, group))
    begins = np.flatnonzero(np.diff(group[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
    kept = order[place < k]
    return stored[kept], ids[kept]


class _Held:
    """The best ``k`` vectors of every query, kept while blocks of vectors come in.

    Products in single precision find the pairs that can reach the k-th score so far, or ``floor`` where that is higher:
    a pair is left out only when it misses it by more than all rounding together. Those pairs alone are scored in double
    precision. Queries of a slice with very many of them, as ties give, are scored against the whole block.
    """

    def __init__(self, asked: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.asked, self.k, self.floor, self.seen = asked, k, floor, 0
        self.scores = np.full((len(asked), k), -np.inf)
        self.ids = np.zeros((len(asked), k), np.int64)
        self.real = np.zeros((len(asked), k), bool)
        self.length = np.sqrt((asked * asked).sum(axis=1))
        self.plain = bool((self.length < LONGEST).all())
        self.narrow = asked.astype(np.float32) if self.plain else None

    def edges(self, rows: np.ndarray) -> np.ndarray:
        least = np.where(self.real[rows, -1], self.scores[rows, -1], -np.inf)
        return least if self.floor is None else np.maximum(least, self.floor[rows])

    def add(self, stored: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Take in vectors, for all queries or for those in the given places."""
        rows = np.arange(len(self.asked)) if rows is None else rows
        stored, ids = _without_spare_copies(stored, ids, self.k)
        at = 0
        while at < len(stored):
            few = max(FIRST_ROWS, 4 * self.k, self.seen) if self.floor is None else STORED_ROWS
            block, names = stored[at : at + min(few, STORED_ROWS)], ids[at : at + min(few, STORED_ROWS)]
            at, self.seen = at + len(block), self.seen + len(block)
            self.add_block(block, names, rows)

    def add_block(self, block: np.ndarray, names: np.ndarray, rows: np.ndarray) -> None:
        """Take in a block of a few thousand vectors at most."""
        longest = float(np.sqrt((block * block).sum(axis=1)).max())
        quick = self.plain and longest < LONGEST
        narrow = block.astype(np.float32).T if quick else None
        for i in range(0, len(rows), ASKED_ROWS):
            part = rows[i : i + ASKED_ROWS]
            if quick:
                self._add_near(part, block, narrow, names, longest)
            else:
                self._add_all(part, block, names)

    def _add_near(self, part: np.ndarray, block: np.ndarray, narrow: np.ndarray, names: np.ndarray, longest: float) -> None:
        near = self.narrow[part] @ narrow
        # Rounding of both vectors, of each product and of the sums, twice over, and that of the scores.
        slack = (block.shape[1] + 8) * 2.0**-23 * self.length[part] * longest + 3 * 10.0**-SCORE_DIGITS
        edge = self.edges(part) - slack
        some = np.flatnonzero(near.max(axis=1) >= edge)
        if not len(some):
            return
        low = np.nextafter(edge[some].astype(np.float32), np.float32(-np.inf))
        who, which = np.nonzero(near[some] >= low[:, None])
        part = part[some]
        if len(who) > NEAR_PAIRS * len(part):
            self._add_all(part, block, names)
            return
        self.add_pairs(part, block, names, who, which)

    def add_pairs(self, part: np.ndarray, block: np.ndarray, names: np.ndarray, who: np.ndarray, which: np.ndarray) -> None:
        """Take in single pairs: places in ``part``, in rising order, and places in the block."""
        scores = np.round(np.einsum("ij,ij->i", self.asked[part[who]], block[which]), SCORE_DIGITS)
        better = scores >= self.edges(part)[who]
        who, scores, found = who[better], scores[better], names[which[better]]
        if len(who):
            counts = np.bincount(who, minlength=len(part))
            touched = np.flatnonzero(counts)
            row = np.searchsorted(touched, who)
            column = np.arange(len(who)) - (np.cumsum(counts) - counts)[who]
            shape = len(touched), int(counts.max())
            wide, named, real = np.full(shape, -np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)
            wide[row, column], named[row, column], real[row, column] = scores, found, True
            self._merge(part[touched], wide, named, real)

    def _add_all(self, part: np.ndarray, block: np.ndarray, names: np.ndarray) -> None:
        scores, found = _score(self.asked[part], block, names, self.k)
        self._merge(part, scores, found, np.ones(scores.shape, bool))

    def _merge(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        scores, ids, real = (np.hstack(x) for x in ((self.scores[rows], scores), (self.ids[rows], ids), (self.real[rows], real)))
        order = np.lexsort((ids, -scores, ~real))[:, : self.k]
        self.scores[rows], self.ids[rows], self.real[rows] = (np.take_along_axis(x, order, 1) for x in (scores, ids, real))

    def hits(self, query_ids: np.ndarray) -> pa.RecordBatch:
        who, place = np.nonzero(self.real)
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[who], pa.int64()), pa.array(self.ids[who, place], pa.int64()), pa.array(self.scores[who, place], pa.float64())],
            names=["query_id", "raw_id", "score"],
        )


def retrieve_topk(
    queries: DataFrame,
    record: DataFrame,
    k: int,
    query_id: str = "id",
    raw_id: str = "raw_id",
    vector: str = "embedding",
    query_bytes: int = QUERY_BYTES,
    query_block: int | None = None,
) -> DataFrame:
    """The ``k`` stored vectors with the largest inner product: ``query_id, rank, raw_id, score``.

    Exact. Pairs are compared as matrix products inside tasks and only each task's
    own best ``k`` per query leave it, so the pairs themselves never become
    rows. Queries that measure at most ``query_bytes`` are sent to every task
    and the record is read once, dealt to a few tasks for each core, since
    every task gives out hits for every query. More queries go in blocks of that size,
    or of ``query_block`` queries, over the record laid out in lists around centres, so
    that a first look into a few lists gives each query a threshold and most of the
    pairs are left out by a bound on their score. Ties go to the lower id.
    """
    queries = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(vector).alias("v"))
    record = record.select(F.col(raw_id).cast("bigint").alias("raw_id"), F.col(vector).alias("v"))
    rows, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if rows * width * 8 <= query_bytes:
        return _best(_scan_with_queries(queries, record, k), k)
    from glosswork.operators.vector_index import build_index, search_with_probes  # it needs this module

    index = build_index(record, scratch_folder(queries.sparkSession, "lists"), raw_id="raw_id", vector="v")
    hits, _ = search_with_probes(queries, index, k, "query_id", "v", query_bytes=query_bytes, query_block=query_block)
    return hits


def _scan_with_queries(queries: DataFrame, record: DataFrame, k: int) -> DataFrame:
    table = queries.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), _matrix(table["v"])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asked = shared.value
        held = None
        for batch in batches:
            if batch.num_rows and len(query_ids):
                held = held or _Held(asked, k)
                held.add(_matrix(batch["v"]), batch["raw_id"].to_numpy())
        if held is not None:
            yield held.hits(query_ids)

    tasks = SCAN_TASKS * record.sparkSession.sparkContext.defaultParallelism
    return record.repartition(tasks, "raw_id").mapInArrow(scan, HITS)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "raw_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("bigint"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "raw_id", "score")
    )


def fetch_docs(
    hits: DataFrame,
    corpus: DataFrame,
    raw_id: str = "raw_id",
    by: tuple[str, ...] = ("query_id", "rank"),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the documents of retrieved ids, keeping ranks and repeats.

    A document that very many queries retrieve is copied to many tasks. Only
    documents that were retrieved at all leave the corpus scan. Hits are written,
    as they are counted first.
    """
    hits = written(hits, "hits")
    counts = hits.groupBy(raw_id).agg(F.count(F.lit(1)).alias("rows"))
    wanted = corpus.join(counts, raw_id)
    return hot_lookup(hits, wanted, [raw_id], list(by), how="left", hot_rows=hot_rows, counts=counts)


def retrieval_augment(
    texts: DataFrame, hits: DataFrame, corpus: DataFrame, key: str = "id", text: str = "text", pieces: int = 3
) -> DataFrame:
    """Prefix every text with the snippets of its hits in rank order: ``s1</s>s2</s>text``.

    Snippets are cut before the join, so whole documents are never shuffled. The
    result is text; tokenizing comes after. A text without hits stays as it is.
    """
    snippets = corpus.select("raw_id", snippet(F.col("text"), pieces).alias("snippet"))
    found = fetch_docs(hits, snippets)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "snippet")))["snippet"]
    prefixes = found.groupBy(F.col("query_id").alias(key)).agg(ordered.alias("snippets"))
    full = F.array_join(F.concat(F.col("snippets"), F.array(F.col(text))), "</s>")
    return (
        texts.join(prefixes, key, "left").withColumn("augmented", F.coalesce(full, F.col(text))).drop("snippets")
    )


def retrieval_replay(
    domain: DataFrame,
    record: DataFrame,
    corpus: DataFrame,
    k: int,
    budget: int,
    group: str = "bk",
    key: str = "id",
    search: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """Documents retrieved for each domain batch, cut into batches by length.

    ``domain`` holds ``key, group, embedding``; ``corpus`` holds ``raw_id`` and
    ``input_ids``. The result has one row per hit: ``group, item, raw_id,
    n_items, batch_no``. ``record`` may be whatever ``search`` takes in place of
    ``retrieve_topk``, such as an index for ``search_index``.
    """
    hits = (search or retrieve_topk)(domain, record, k, query_id=key)
    grouped = hits.join(domain.select(F.col(key).alias("query_id"), group), "query_id")
    # Lengths decide, so the lists themselves stay where they are.
    found = fetch_docs(grouped, corpus.select("raw_id", F.size("input_ids").alias("_size")))
    items = written(found.select(group, (F.col("query_id") * k + F.col("rank") - 1).alias("item"), "raw_id", "_size"), "items")
    return length_batches(items, budget, group, "item", "_size").select(group, "item", "raw_id", "n_items", "batch_no")


def hashed_embedding(df: DataFrame, dims: int, seed: int = 0, key: str = "raw_id", text: str = "text") -> DataFrame:
    """Feature-hashed token counts scaled to unit length: ``key, embedding``.

    All of it happens inside the row: tokens become bucket numbers, and an Arrow
    batch of them is counted at once. A text without tokens gives zeros.
    """
    buckets = F.transform(token_list(F.col(text)), lambda t: (draw(seed, t) % dims).cast("int"))

    @F.arrow_udf("array<double>")
    def counted(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists)), sizes)
        cells = rows * dims + lists.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(cells, minlength=len(lists) * dims).astype(np.float64).reshape(len(lists), dims)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        scaled = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
        offsets = pa.array(np.arange(len(lists) + 1) * dims, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(scaled.ravel()))

    return df.select(key, counted(buckets).alias("embedding"))


def embed_corpus(
    df: DataFrame,
    encoder: Callable[[pd.Series], np.ndarray] | None = None,
    dims: int = 64,
    key: str = "raw_id",
    text: str = "text",
) -> DataFrame:
    """One vector per document: ``key, embedding``.

    ``encoder`` maps a Series of texts to a matrix and runs on Arrow batches; if
    it is an object with a ``load`` method, that is called once per task, for
    models. Without one, hashed token counts are used. To embed one shard, pass
    the rows of ``corpus_shard``.
    """
    if encoder is None:
        return hashed_embedding(df, dims, key=key, text=text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder.load() if hasattr(encoder, "load") else encoder
        for frame in frames:
            matrix = np.asarray(model(frame[text]))
            yield pd.DataFrame({key: frame[key], "embedding": list(matrix.astype(np.float64))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def erf(x: np.ndarray) -> np.ndarray:
    """The error function by its series of like-signed terms; beyond 6 it is 1 to the last digit."""
    near = np.clip(x, -6.0, 6.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 160):
        term = term * (2.0 * near * near / (2 * n + 1))
        total = total + term
    return 2.0 / math.sqrt(math.pi) * np.exp(-near * near) * total


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2.0)))


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda x: x,
    "relu": lambda x: np.maximum(x, 0.0),
    "tanh": np.tanh,
    "gelu": gelu,
}
MATRIX_BYTES = 256 << 20  # columns of weights that are sent to every task at a time


def dense_layer(
    df: DataFrame,
    weight: np.ndarray,
    bias: np.ndarray,
    activation: str = "identity",
    vector: str = "embedding",
    name: str = "output",
    matrix_bytes: int = MATRIX_BYTES,
) -> DataFrame:
    """Add ``activation(x W + b)`` for a vector column, one matrix product per Arrow batch.

    The weights are a model parameter, not data, and are sent to every task; more
    than ``matrix_bytes`` of them in blocks of columns, whose outputs are joined.
    """
    weight, bias = np.asarray(weight, dtype=np.float64), np.asarray(bias, dtype=np.float64)
    act = ACTIVATIONS[activation]
    wide = max(1, matrix_bytes // max(1, 8 * weight.shape[0]))

    def block(start: int) -> Column:
        shared = df.sparkSession.sparkContext.broadcast((weight[:, start : start + wide], bias[start : start + wide]))

        @F.arrow_udf("array<double>")
        def layer(lists: pa.Array) -> pa.Array:
            w, b = shared.value
            out = act(_matrix(lists).reshape(-1, w.shape[0]) @ w + b)
            offsets = pa.array(np.arange(len(lists) + 1) * w.shape[1], pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

        return layer(F.col(vector))

    blocks = [block(start) for start in range(0, max(1, weight.shape[1]), wide)]
    return df.withColumn(name, blocks[0] if len(blocks) == 1 else F.concat(*blocks))


def project_queries(queries: DataFrame, weight: np.ndarray, bias: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Move query vectors into the space of the stored ones."""
    return dense_layer(queries, weight, bias, "identity", vector, "_projected").withColumn(
        vector, F.col("_projected")
    ).drop("_projected")
