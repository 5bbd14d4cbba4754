"""Near duplicates: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

A document is the set of its distinct word shingles. Equal sets are one class from the start, so a group of copies is
one row in all that follows. One pass hashes every shingle once; the smallest hash in each of ``BINS`` bins is the
signature, and an empty bin takes the value of a filled one that its own sequence of draws meets first. Bins are
joined to bands; classes that agree in a band share a bucket.

In a bucket edges from one centre to the other members become candidates first. The centre is the member that shares
most buckets, counted with their sizes: in a family of near copies that is the text the others were made from. Edges
whose signatures agree too little to reach the threshold are left out, and the rest is confirmed on full sets. What is
left over are buckets whose members are not one component: there the signatures of all pairs from different components
are compared, as matrices inside tasks, each pair in the first bucket it shares. Members that are near to one of another
component get their full sets, in the units they were found in, and are confirmed inside the task; fewer edges than
members leave it, so no pair ever becomes a row. Every pair that shares a bucket is either in one component or was
compared, whatever centres there were. A leftover bucket of more than ``PAIR_ROWS`` members, or very large ones, is dealt
out as pairs of blocks, so a task holds two blocks at a time.

Components come from taking the smallest label around and jumping to the label's label, table by table. Bucket sizes,
centres and labels are minima, maxima and counts that combine before the shuffle. Full sets are joined with the centre
copied for each ``CENTRE_ROWS`` of its members, so a centre of a third of all classes is read by many tasks.

Defined results: no text, or one without words, has an empty set and is linked with nothing. Rows with equal ids are
documents of their own. A null id is never the smallest; a component without any id has none. Other columns do not
come back. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.common import free_name, slices
from glosswork.llm.shingles import WordHasher, mixed, raw_texts
from glosswork.plans import forget, written

BINS = 128
BAND_BINS = 5  # 25 bands: two sets at 0.85 share none with a chance of 4e-7
CENTRE_ROWS = 200
PAIR_ROWS = 1024  # members of a leftover bucket that are compared with as many others at a time
PAIR_SHINGLES = 1 << 20  # and the shingles that they may have together
PAIRS = 1 << 16  # pairs whose bands are compared at a time
GROUP_ROWS = 8192  # members of smaller leftover buckets that one call compares
MAP_BITS = 1 << 28  # bits of the map of documents whose sets are wanted: 32 MB
SKETCH_MARGIN = 0.15  # how far the estimate of a signature may lie below the truth: more than four deviations


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BINS`` smallest hashes for each set; rows of empty sets are zero."""
    edges = (np.arange(BINS + 1, dtype=object) * (1 << 64) // BINS)[:-1].astype(np.uint64)
    out = np.zeros((len(sets), BINS), np.uint64)
    filled = np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        stop = np.append(at[1:], len(s))
        filled[i] = at < stop
        out[i, filled[i]] = s[at[filled[i]]]
    todo = ~filled & filled.any(axis=1)[:, None]
    attempt = 0
    bins = np.arange(BINS, dtype=np.uint64)
    while todo.any():
        attempt += 1
        draw = (mixed(bins * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        rows, cols = np.nonzero(todo)
        hit = filled[rows, draw[cols]]
        out[rows[hit], cols[hit]] = out[rows[hit], draw[cols[hit]]]
        todo[rows[hit], cols[hit]] = False
    return out


def sketches(documents: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, key, n_shingles, bands, sketch`` of every document; ``key`` names its set, null without words."""
    schema = "doc_id bigint, text_hash bigint, key binary, n_shingles bigint, bands array<bigint>, sketch binary"
    bands = BINS // BAND_BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        weights = mixed(np.arange(1, BAND_BINS + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                sets = [hasher.shingles(raw, width) for raw in raw_texts(batch.column(1).slice(start, stop - start))]
                signed = _signatures(sets)
                rows = signed[:, : bands * BAND_BINS].reshape(len(sets), bands, BAND_BINS)
                buckets = mixed((rows * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).astype(np.int64)
                short = (mixed(signed) & np.uint64(0xFFFF)).astype("<u2")
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        batch.column(2).slice(start, stop - start),
                        pa.array(keys, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([b if len(s) else [] for b, s in zip(buckets, sets)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() for x in short], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "key", "n_shingles", "bands", "sketch"],
                )

    named = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    return named.mapInArrow(run, schema)


def shingle_sets(documents: DataFrame, width: int) -> DataFrame:
    """``key, shingles`` for rows ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                sets = [hasher.shingles(raw, width) for raw in raw_texts(batch.column(0).slice(start, stop - start))]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), lists], ["key", "shingles"])

    return documents.select("text").mapInArrow(run, "key binary, shingles array<bigint>")


def _bit(doc_id: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(bits)) + 1


def _with_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose ``doc_id`` is among the ``ids`` and a few others, without a shuffle of texts.

    The ids' hashes set bits of a map of ``MAP_BITS`` bits at most, which is broadcast whatever the number of ids; a map that
    is nearly full lets nearly all texts pass, and what passes by chance is sorted out by key afterwards.
    """
    wanted = max(1, ids.count())
    bits = min(MAP_BITS, 1 << max(15, (16 * wanted - 1).bit_length()))
    marked = ids.select(_bit("doc_id", bits).alias("bit"))
    maps = marked.groupBy(F.bitmap_bucket_number("bit").alias("_slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    place = F.bitmap_bit_position(_bit("doc_id", bits))
    met = texts.join(F.broadcast(maps), F.bitmap_bucket_number(_bit("doc_id", bits)) == F.col("_slot"))
    byte = F.conv(F.hex(F.substring("_map", (F.call_function("div", place, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*texts.columns)


@F.arrow_udf(T.DoubleType())
def _agreement(left: pa.Array, right: pa.Array) -> pa.Array:
    a = np.frombuffer(b"".join(left.to_pylist()), "<u2").reshape(-1, BINS)
    b = np.frombuffer(b"".join(right.to_pylist()), "<u2").reshape(-1, BINS)
    return pa.array((a == b).mean(axis=1))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of the edges ``a, b``: the smallest node that can be reached."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(seen, labels.node == seen.a, "left").select("node", "root", F.least("root", "near").alias("low"))
        above = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = lower.join(above, lower.low == above["_n"], "left").select(
            "node", F.least("low", F.coalesce("_r", "low")).alias("root"), (F.least("low", F.coalesce("_r", "low")) < F.col("root")).alias("moved")
        )
        step = written(jumped, "labels")
        forget(labels)
        labels, moved = step.select("node", "root"), step.where("moved").limit(1).count()
        labels.scratch_path = step.scratch_path
        if not moved:
            forget(both)
            return labels


def _stars(members: DataFrame) -> DataFrame:
    """``bucket, a`` with the centre of every bucket: the best-shared member."""
    return members.groupBy("bucket").agg(F.max(F.struct("score", "key"))["key"].alias("a"))


def _near_pairs(left: np.ndarray, right: np.ndarray, roots_l: np.ndarray, roots_r: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs from different components whose signatures agree in ``least`` bins at least, some at a time."""
    for start in range(0, len(left), 256):
        part, roots = left[start : start + 256], roots_l[start : start + 256]
        other = np.flatnonzero(roots_r != roots[0]) if (roots == roots[0]).all() else np.arange(len(right))
        if not len(other):
            continue
        facing = right[other]
        if len(part) * len(facing) <= 4096:
            agree = (part[:, None, :] == facing[None, :, :]).sum(axis=2)
        else:
            agree = np.zeros((len(part), len(facing)), np.uint8)
            for a, b in zip(np.ascontiguousarray(part.T), np.ascontiguousarray(facing.T)):
                agree += a[:, None] == b[None, :]
        i, j = np.nonzero((agree >= least) & (roots[:, None] != roots_r[other][None, :]))
        for at in range(0, len(i), PAIRS):
            yield i[at : at + PAIRS] + start, other[j[at : at + PAIRS]]


def _sides(unit: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For rows sorted by unit: the rows of every unit's two sides, and whether they are one and the same."""
    starts = np.flatnonzero(np.diff(unit, prepend=unit[:1] - 1))
    for start, stop in zip(starts, [*starts[1:], len(unit)]):
        rows = np.arange(start, stop)
        whole = bool(side[start] == 2)
        yield (rows, rows, True) if whole else (rows[side[rows] == 0], rows[side[rows] == 1], False)


def _unlinked_members(members: DataFrame, roots: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``unit, side, key, root, n`` of members that have a near one of another component in a unit.

    A unit is a bucket, or a pair of blocks of a large one. A pair counts in the first bucket that it shares. Pairs stay
    inside the task: what leaves it are at most the members that came in.
    """
    placed = members.join(roots, "key", "left").select("bucket", "key", "n", F.xxhash64(F.coalesce("root", "key")).alias("root"))
    placed = written(placed, "placed")
    held = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    # The only pair of a bucket of two has been an edge of its star.
    apart = held.where((F.col("low") != F.col("high")) & (F.col("rows") > 2))
    parts = F.greatest(F.ceil(F.col("rows") / PAIR_ROWS), F.ceil(F.col("shingles") / PAIR_SHINGLES)).cast("int")
    left = written(placed.join(apart.select("bucket", parts.alias("parts")), "bucket"), "leftover")
    forget(placed)
    groups = max(1, left.count() // GROUP_ROWS)
    mine = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    dealt = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    work = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(unit)
    cells = dealt.select("bucket", "key", "n", "root", work.alias("work"), unit.alias("unit"), side.alias("side")).join(
        classes.select("key", "sketch", "bands"), "key"
    )

    def run(cut: pa.Table) -> pa.Table:
        cut = cut.combine_chunks()
        column = lambda name: cut[name].to_numpy()
        order = np.lexsort((column("root"), column("unit")))
        unit, root, side, bucket = (column(n)[order] for n in ("unit", "root", "side", "bucket"))
        sketch = np.frombuffer(b"".join(cut["sketch"].to_pylist()), "<u2").reshape(-1, BINS)[order]
        bands = cut["bands"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        near = np.zeros(len(order), bool)
        for a, b, _ in _sides(unit, side):
            for i, j in _near_pairs(sketch[a], sketch[b], root[a], root[b], least):
                i, j = a[i], b[j]
                first = bands[i, (bands[i] == bands[j]).argmax(axis=1)] == bucket[i]
                near[i[first]] = near[j[first]] = True
        return cut.select(["unit", "side", "key", "root", "n"]).take(pa.array(np.sort(order[near])))

    return cells.groupBy("work").applyInArrow(run, "unit bigint, side int, key binary, root bigint, n bigint")


def _forest(unlinked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that join what is linked in each unit: fewer than its members.

    A unit's shingles are numbered; a member marks its own and counts the marks of all others of other components at once.
    Linked components become one, so a pair that is already joined is not compared.
    """
    unlinked = written(unlinked, "unlinked")
    total = unlinked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / PAIR_SHINGLES))
    big = unlinked.groupBy("unit").agg((F.sum("n") > PAIR_SHINGLES // 2).alias("alone"))
    work = F.when(F.col("alone"), F.col("unit")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(groups)))
    dealt = unlinked.join(big, "unit").withColumn("work", work).join(sets.select("key", "shingles"), "key")

    def run(cut: pa.Table) -> pa.Table:
        cut = cut.combine_chunks()
        unit = cut["unit"].to_numpy()
        order = np.argsort(unit, kind="stable")
        cut = cut.take(pa.array(order))
        unit, side, root = (cut[n].to_numpy() for n in ("unit", "side", "root"))
        lists = cut["shingles"].combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
        left, right = [], []
        for a, b, whole in _sides(unit, side):
            rows = a if whole else np.concatenate([a, b])
            low, high = rows.min(), rows.max()
            begin = ends[low] - sizes[low]
            number = np.unique(flat[begin : ends[high]], return_inverse=True)[1]
            owned = lambda i: number[ends[i] - sizes[i] - begin : ends[i] - begin]
            marks = np.zeros(number.max(initial=0) + 1, np.int32)
            component = root.copy()
            for i in a.tolist():
                facing = (b[b > i] if whole else b)
                facing = facing[component[facing] != component[i]]
                if not len(facing):
                    continue
                marks[owned(i)] = 1
                cells = np.concatenate([owned(j) for j in facing.tolist()])
                met = np.add.reduceat(marks[cells], np.cumsum(sizes[facing]) - sizes[facing])
                marks[owned(i)] = 0
                linked = facing[100 * met >= percent * (sizes[i] + sizes[facing] - met)]
                for j in linked.tolist():
                    if component[j] != component[i]:
                        left.append(i)
                        right.append(j)
                        component[rows[component[rows] == component[j]]] = component[i]
        keys = cut["key"].combine_chunks()
        take = lambda at: keys.take(pa.array(np.array(at, np.int64)))
        return pa.table({"a": take(left), "b": take(right)})

    return dealt.groupBy("work").applyInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, met, size_a, size_b`` of pairs: the sizes of their sets and of what they share."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CENTRE_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    mine = sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b"))
    centres = sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a")).join(parts, "a")
    copies = centres.select("a", "set_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = dealt.drop("parts").join(mine, "b").join(copies, ["a", "part"])
    return joined.select(
        "a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("met"), F.size("set_a").alias("size_a"), F.size("set_b").alias("size_b")
    )


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept, key`` of every document.

    Documents are linked when 100 times what their sets share is at least ``percent`` times what they hold together.
    """
    texts = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = written(sketches(texts, width), "sketches")
    classes = signed.where(F.col("key").isNotNull()).dropDuplicates(["key"]).select("key", "sketch", "bands", "n_shingles")
    classes = written(classes, "classes")
    rows = written(signed.select("doc_id", "text_hash", "n_shingles", "key"), "rows")
    forget(signed)
    labels = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("label"))
    spread = classes.select("key", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    inside = written(spread.join(shared, "bucket"), "buckets")
    scores = inside.groupBy("key").agg(F.sum(F.col("size") - 1).alias("score"))
    members = written(inside.join(scores, "key").select("bucket", "key", "n", "score"), "members")
    forget(inside)

    least = math.ceil((percent / 100 - SKETCH_MARGIN) * BINS - 1e-9)  # bins in which the signatures of a near pair agree

    def sets_of(keys: DataFrame) -> DataFrame:
        names = written(keys.join(labels, "key").select(F.col("label").alias("doc_id")), "names")
        return written(shingle_sets(_with_ids(texts, names), width).dropDuplicates(["key"]).join(keys, "key", "left_semi"), "sets")

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        enough = 100 * F.col("met") >= percent * (F.col("size_a") + F.col("size_b") - F.col("met"))
        return written(_confirmed(pairs, sets).where(enough).select("a", "b"), "links")

    pairs = members.join(written(_stars(members), "stars"), "bucket").where(F.col("key") != F.col("a")).select("a", F.col("key").alias("b")).distinct()
    sketch = classes.select("key", "sketch")
    left = sketch.select(F.col("key").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sketch.select(F.col("key").alias("b"), F.col("sketch").alias("sketch_b"))
    likely = pairs.join(right, "b").join(left, "a").where(_agreement("sketch_a", "sketch_b") * BINS >= least)
    tried = written(likely.select("a", "b"), "candidates")
    wanted = written(tried.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    sets = sets_of(wanted)
    links = linked(tried, sets)

    roots = components(links).withColumnRenamed("node", "key")
    unlinked = written(_unlinked_members(members, roots, classes, least), "unlinked")
    forget(members, classes)
    if unlinked.limit(1).count():
        more = written(unlinked.select("key").distinct().join(wanted, "key", "left_anti"), "wanted")
        later = sets_of(more)
        links = links.union(written(_forest(unlinked, sets.union(later), percent), "links"))
        forget(later)
    forget(sets)

    root = components(links)
    named = root.join(labels.withColumnRenamed("key", "node"), "node")
    lowest = named.groupBy("root").agg(F.min("label").alias("component_id"))
    grouped = named.join(lowest, "root").select(F.col("node").alias("key"), "component_id")
    own = labels.join(grouped, "key", "left").select("key", F.coalesce("component_id", "label").alias("component_id"))
    final = rows.select("doc_id", "text_hash", "n_shingles", "key").join(own, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return final.select(
        "doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key"
    )


def without_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the near duplicates of one with a smaller id, with all their columns; of equal rows one stays."""
    told = written(near_duplicates(documents, width, percent, doc_id, text).select("doc_id", "text_hash", "kept"), "told")
    d, h, mark = free_name(documents, "_copy_doc"), free_name(documents, "_copy_hash"), free_name(documents, "_mark")
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    marked = documents.withColumn(mark, F.xxhash64(text))
    stay = marked.join(gone, marked[doc_id].cast("bigint").eqNullSafe(gone[d]) & (marked[mark] == gone[h]), "left_anti")
    repeated = told.where("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.limit(1).count():
        stay = stay.dropDuplicates([doc_id, mark])
    return stay.drop(mark)
