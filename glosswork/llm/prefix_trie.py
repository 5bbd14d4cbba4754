"""Prefix trie of conversations: time-forward processing of subtree totals, in shards and then across their roots.

A node is a distinct sequence of first turns. Its name is the exclusive or of a 128-bit hash of each turn and its place,
so a conversation's prefixes are a running aggregate over its turns and a parent's name needs no look-up. Long
conversations are cut into chunks whose sums carry over.

Nodes with the same members form a straight stretch, named by smallest member and number of members; totals along it
are differences of a running sum, so only stretches take part in what follows and a long conversation of its own is one
of them. Stretches are sorted externally by reverse level order; each takes the totals that have been sent to it
from a priority queue, adds its own and sends the sum to its parent. The queue is ordered like the nodes, holds at most
``QUEUE`` messages in memory and spills sorted runs to files of its own task, which vanish with it.

A shard of the first tier is a subtree of at most ``SHARD`` members under a larger one; the next tier has subtrees of at
most ``SHARD`` squared, without what the tiers below have done, and so on up to the root. The roots of a tier's shards
send their totals, summed by receiver, to the next tier. There are as many tiers as powers of ``SHARD`` in the number of
conversations. Copies of one conversation add members, not stretches. A stretch with side branches at every turn, above all
tiers, is the one shape that stays long inside a shard; it streams through one task in bounded memory.

Look-ups by node split the nodes that hold more than a thousandth of all rows. The ids of conversations that end at a
node are sorted by range, joined in pieces and hashed as a stream, so the list of a hot node is never in memory.

Defined results: a null role or text is empty; turns are ordered by turn (null first), then role, then text; equal rows are
two turns. Rows without a conversation id belong to none and are left out. Other columns are ignored. Without any
conversation there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.plans import hot_lookup, written

SORT_ROWS = 200_000  # rows of one range
SORT_PARTS = 20_000  # ranges at most
CHUNK = 4096  # turns of a conversation that one window holds
SHARD = 1000  # members of a first-tier subtree
QUEUE = 200_000  # messages that a queue holds in memory
PIECE = 512  # ids joined before they are shuffled
_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition number above these


class SpillingQueue:
    """A priority queue of tuples that keeps at most ``limit`` of them in memory."""

    def __init__(self, limit: int = QUEUE, block: int = 1000):
        self.limit, self.block = limit, block
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # the first tuple of each spilled run, its number and the rest
        self.spilled = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = self._spill(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.runs, (next(run), self.spilled, run))
            self.spilled += 1

    def _spill(self, items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for at in range(0, len(items), self.block):
            pickle.dump(items[at : at + self.block], file)
        file.seek(0)

        def back(blocks: int) -> Iterator[tuple]:
            with file:
                for _ in range(blocks):
                    yield from pickle.load(file)

        return back(-(-len(items) // self.block))

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, run))
            return item
        return heapq.heappop(self.heap)


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, digest, chars``: the place of every turn in its conversation, from 1, and what it says.

    Texts are shuffled once, for the sort; a conversation of any length is spread over the ranges it fills.
    """
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    named = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said(role).alias("role"), said(text).alias("text")
    )
    parts = min(SORT_PARTS, max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns.count() / SORT_ROWS)))
    order = ["conv_id", "turn", "role", "text"]
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = named.repartitionByRange(parts, "conv_id", "turn").sortWithinPartitions(*order)
    rows = written(rows.select("conv_id", F.monotonically_increasing_id().alias("at"), digest.alias("digest"), F.length("text").cast("bigint").alias("chars")), "turns")
    cut = rows.withColumn("range", F.shiftright("at", _PLACE_BITS))
    stretches = cut.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("before") + F.col("at") - F.col("first") + 1
    return cut.join(stretches, ["conv_id", "range"]).select("conv_id", place.cast("bigint").alias("place"), "digest", "chars")


def _prefixes(messages: DataFrame, longest: int) -> DataFrame:
    """``conv_id, place, a, b, total``: names of the prefixes that end at each turn and the code points up to there."""
    hashes = {n: F.xxhash64("place", "digest", F.lit(s)) for n, s in (("a", 1), ("b", 2))}
    rows = messages.select("conv_id", "place", "chars", "length", F.call_function("div", F.col("place") - 1, F.lit(CHUNK)).alias("chunk"), *[h.alias(n) for n, h in hashes.items()])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"a": F.bit_xor("a"), "b": F.bit_xor("b"), "total": F.sum("chars")}
    running = rows.select("conv_id", "place", "chars", "length", "chunk", *[s.over(inside).alias(n) for n, s in sums.items()])
    if longest <= CHUNK:
        return running.drop("chunk")
    chunks = rows.groupBy("conv_id", "chunk").agg(*[s.alias(n) for n, s in sums.items()])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    over = {"a": F.bit_xor("a"), "b": F.bit_xor("b"), "total": F.sum("total")}
    carried = chunks.select("conv_id", "chunk", *[F.coalesce(s.over(before), F.lit(0)).alias(f"_{n}") for n, s in over.items()])
    joined = running.join(carried, ["conv_id", "chunk"])
    return joined.select(
        "conv_id", "place", "chars", "length", F.col("a").bitwiseXOR(F.col("_a")).alias("a"), F.col("b").bitwiseXOR(F.col("_b")).alias("b"), (F.col("total") + F.col("_total")).alias("total")
    )


def _send_up(stretches: DataFrame) -> DataFrame:
    """Time-forward processing of shards: the totals of every stretch.

    Rows ``shard, depth, member, up_depth, up_member, inside, leaf, own, in_leaves, in_saved`` give ``member, depth,
    up_member, up_depth, inside, leaves, below, saved``.
    """
    schema = "member bigint, depth bigint, up_member bigint, up_depth bigint, inside boolean, leaves bigint, below bigint, saved bigint"
    names = ("member", "depth", "up_member", "up_depth", "inside", "leaf", "own", "in_leaves", "in_saved")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue()
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            done: list[tuple] = []
            for member, depth, up_member, up_depth, inside, leaf, own, leaves, below in zip(*columns):
                leaves += leaf
                while (head := queue.peek()) is not None and head[:2] == (-depth, member):
                    _, _, more, saved = queue.pop()
                    leaves, below = leaves + more, below + saved
                if inside:
                    queue.push((-up_depth, up_member, leaves, below + own))
                done.append((member, depth, up_member, up_depth, inside, leaves, below, below + own))
            fields = [pa.array(c, pa.bool_() if i == 4 else pa.int64()) for i, c in enumerate(zip(*done))] if done else []
            if fields:
                yield pa.RecordBatch.from_arrays(fields, ["member", "depth", "up_member", "up_depth", "inside", "leaves", "below", "saved"])
        if queue.peek() is not None:
            raise ValueError("a total was sent to a node outside its shard")

    ordered = stretches.repartition("shard").sortWithinPartitions(F.desc("depth"), "member")
    return ordered.select(*names).mapInArrow(run, schema)


def _ends_digest(ends: DataFrame) -> DataFrame:
    """``member, depth, ends_sha256`` for rows ``member, depth, conv_id``: hash of the ids in ascending order, comma-joined."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ids: list[str] = []
            at = None
            for member, depth, conv in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (member, depth) != at or len(ids) == PIECE:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, first, ids = (member, depth), conv, []
                ids.append(str(conv))
            if ids:
                out.append((*at, first, ",".join(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["member", "depth", "first", "ids"]
                )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for member, depth, _, ids in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (member, depth) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (member, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, state.hexdigest()), kinds)], names)

    kinds, names = (pa.int64(), pa.int64(), pa.string()), ["member", "depth", "ends_sha256"]
    rows = ends.repartitionByRange("member", "depth", "conv_id").sortWithinPartitions("member", "depth", "conv_id")
    pieces = rows.select("member", "depth", "conv_id").mapInArrow(join, "member bigint, depth bigint, first bigint, ids string")
    pieces = pieces.repartition("member", "depth").sortWithinPartitions("member", "depth", "first")
    return pieces.mapInArrow(digest, "member bigint, depth bigint, ends_sha256 string")


def prefix_trie(messages: DataFrame, conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conversations`` has one row ``conv_id, length`` for each conversation, those without turns included, and ``messages``
    their turns ``conv_id, place, digest, chars, length``, places running from 1 to ``length``.
    """
    members, smallest, longest, turns, idle = conversations.agg(
        F.count(F.lit(1)), F.min("conv_id"), F.max("length"), F.sum("length"), F.count_if(F.col("length") == 0)
    ).first()
    chain = written(_prefixes(messages, longest or 0), "chain")
    name = ["place", "a", "b"]
    last = F.col("place") == F.col("length")
    nodes = chain.groupBy(*name).agg(F.count(F.lit(1)).alias("rows"), F.min("conv_id").alias("member"))
    nodes = written(nodes.withColumn("n", F.col("rows")), "nodes")
    hot = max(1000, (turns or 0) // 1000)  # so that at most a thousand nodes are hot
    met = written(hot_lookup(chain, nodes, name, ["conv_id"], hot_rows=hot).drop("a", "b"), "met")

    above = met.select(F.col("conv_id").alias("_c"), (F.col("place") + 1).alias("_p"), F.col("member").alias("up"), F.col("n").alias("up_n"))
    own = met.where(F.col("conv_id") == F.col("member")).select("member", F.col("place").alias("depth"), "n", "chars", "total")
    hung = own.join(above, (F.col("member") == F.col("_c")) & (F.col("depth") == F.col("_p")), "left").drop("_c", "_p")
    hung = hung.withColumn("up", F.coalesce("up", F.lit(smallest))).withColumn("up_n", F.coalesce("up_n", F.lit(members)))
    zero = F.lit(0).cast("bigint")
    root = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("member")).where("n > 0").select(
        "member", zero.alias("depth"), "n", zero.alias("chars"), zero.alias("total"), F.lit(None).cast("bigint").alias("up"), F.lit(None).cast("bigint").alias("up_n")
    )
    hung = written(hung.unionByName(root), "hung")
    children = hung.where(F.col("depth") > 0).groupBy(F.col("up").alias("member"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    full = written(hung.join(children, ["member", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    stretch = full.groupBy("member", "n").agg(
        F.min("depth").alias("top"),
        F.max("depth").alias("depth"),
        F.max("total").alias("stop"),
        F.min(F.col("total") - F.col("chars")).alias("start"),
        F.min_by(F.struct("up", "up_n"), "depth").alias("over"),
        F.max_by(F.when(F.col("n_children") == 0, 1).otherwise(0), "depth").cast("bigint").alias("leaf"),
    )
    bounds = [shard]
    while bounds[-1] < (members or 0):
        bounds.append(bounds[-1] * shard)
    tier = F.lit(0)
    for t, bound in enumerate(bounds[:-1]):
        tier = F.when(F.col("n") > bound, t + 1).otherwise(tier)
    stretch = stretch.select(
        "member", "n", "depth", "stop", tier.alias("tier"), F.col("over.up").alias("up_member"), (F.col("top") - 1).alias("up_depth"),
        F.col("over.up_n").alias("up_n"), "leaf", ((F.col("n") - 1) * (F.col("stop") - F.col("start"))).alias("own"),
    )
    if len(bounds) > 1:
        first = [F.min_by(F.struct("member", "place"), F.when(F.col("n") <= bound, F.col("place"))).alias(f"t{t}") for t, bound in enumerate(bounds[:-1])]
        subtree = met.groupBy(F.col("conv_id").alias("member")).agg(*first)
        stretch = stretch.join(subtree, "member", "left")
        found = F.lit(0).cast("bigint")
        for t in range(len(bounds) - 1):
            found = F.when(F.col("tier") == t, F.xxhash64(f"t{t}")).otherwise(found)
        stretch = stretch.withColumn("shard", found).drop(*[f"t{t}" for t in range(len(bounds) - 1)])
    else:
        stretch = stretch.withColumn("shard", zero)
    stretch = written(stretch, "stretches")

    done: list[DataFrame] = []
    for t, bound in enumerate(bounds):
        rows = stretch.where(F.col("tier") == t).withColumn("inside", F.coalesce(F.col("up_n") <= bound, F.lit(False)))
        if done:
            sent = done[0]
            for more in done[1:]:
                sent = sent.unionByName(more)
            sent = sent.where(~F.col("inside") & F.col("up_member").isNotNull()).groupBy(F.col("up_member").alias("member"), F.col("up_depth").alias("depth"))
            rows = rows.join(sent.agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved")), ["member", "depth"], "left")
            rows = rows.withColumns({c: F.coalesce(c, zero) for c in ("in_leaves", "in_saved")})
        else:
            rows = rows.withColumn("in_leaves", zero).withColumn("in_saved", zero)
        done.append(written(_send_up(rows), "totals"))
    totals = done[0]
    for more in done[1:]:
        totals = totals.unionByName(more)
    totals = totals.select("member", "depth", "leaves", "below").join(stretch.select("member", "depth", "n", "stop"), ["member", "depth"]).drop("depth")

    ends = met.where(last).select("member", F.col("place").alias("depth"), "conv_id")
    if idle:
        ends = ends.unionByName(conversations.where("length = 0").select(F.lit(smallest).alias("member"), zero.alias("depth"), "conv_id"))
    digests = _ends_digest(ends)
    joined = full.join(totals, ["member", "n"]).join(digests, ["member", "depth"], "left")
    return joined.select(
        F.col("member").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("below") + (F.col("n") - 1) * (F.col("stop") - F.col("total") + F.col("chars"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, **names: str) -> DataFrame:
    """``prefix_trie`` of conversations given as rows ``conv_id, turn, role, text``."""
    numbered = written(numbered_turns(turns, **names), "numbered")
    lengths = written(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")), "lengths")
    full = hot_lookup(numbered, lengths.withColumn("rows", F.col("length")), ["conv_id"], ["place"])
    return prefix_trie(full, lengths)
