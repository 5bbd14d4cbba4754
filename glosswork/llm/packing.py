"""Mixture-controlled packing: deficit round-robin over one queue for each source fills every window.

Each source queues its documents in a hashed order. In every round a source may send its share of a window's tokens;
what is too little for one more packet is its deficit and is carried to the next round. A queue that is never idle
sends packet number ``j`` of ``G`` tokens in round ``floor((j G + offset) / quantum)``, so a packet's round follows from
its place in the queue alone and no round waits for another. The offset is a source's opening deficit, which keeps small
sources from all sending in the first round. Rounds laid end to end, sources in order inside each, are cut into
windows. A round holds a window's worth of tokens but for carried deficits, so every window meets the target within a
packet for each source while all queues last; when one runs dry its rounds are shared out among the others.

Places in queues and in the whole order are running sums that are taken bucket by bucket; the sums of the buckets
carry over. A document is cut where its packets go to different rounds and where a window ends. Its tokens travel
once, to its list of pieces, and are never gathered by source, round or window.

Defined results: no text is an empty one and its document has the end id alone. A null source is a source like any
other. Equal rows are queued apart. A source that ``shares`` does not name, or names with no positive weight, gets the
weight of its own tokens. An empty table gives no pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.llm.common import free_name, running_start
from glosswork.plans import written

WINDOW = 4096
PACKET = 128  # tokens that a source sends at a time
BUCKET_ROWS = 20_000  # rows of a queue that one task orders


def _buckets(rows: int, least: int = 256) -> int:
    return max(least, math.ceil(rows / BUCKET_ROWS))


def plan_pieces(
    sizes: DataFrame, shares: Mapping[str, float] | None = None, window: int = WINDOW, packet: int = PACKET
) -> DataFrame:
    """Where every token of documents ``row, source, order, size`` goes: ``row, start, length, sequence_id, offset``.

    ``row`` names a document and ``order`` says where it stands in its queue. ``shares`` maps sources to weights; by
    default a source has the weight of its tokens, so that all queues end together.
    """
    rows, tokens = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = _buckets(rows)
    queued = running_start(
        sizes.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 16), F.lit(buckets))),
        ["source"], "bucket", ["order", "row"], "size", "at",
    ).select("row", "source", "size", "at")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("own"))
    weight = F.col("own") / F.lit(max(tokens, 1))
    if shares:
        given = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        named = F.element_at(given, F.coalesce("source", F.lit("")))
        weight = F.when(named > 0, named.cast("double")).otherwise(weight)
    weighed = totals.withColumn("weight", weight)
    scale = weighed.agg(F.sum("weight")).first()[0] or 1.0
    quantum = F.greatest(F.lit(window) * F.col("weight") / F.lit(scale), F.lit(1e-9))
    opening = F.pmod(F.xxhash64("source"), F.lit(packet)).cast("double")
    queues = weighed.select(F.col("source").alias("_s"), quantum.alias("quantum"), opening.alias("opening"))
    placed = queued.join(queues, F.col("source").eqNullSafe(F.col("_s")))

    packets = F.sequence(F.call_function("div", F.col("at"), F.lit(packet)), F.call_function("div", F.col("at") + F.col("size") - 1, F.lit(packet)))
    turn: Column = lambda j: F.floor((j * packet + F.col("opening")) / F.col("quantum")).cast("bigint")
    sent = placed.where(F.col("size") > 0).select("row", "source", "at", "size", "opening", "quantum", F.explode(packets).alias("j"))
    low = F.greatest(F.col("at"), F.col("j") * packet)
    high = F.least(F.col("at") + F.col("size"), (F.col("j") + 1) * packet)
    parts = sent.select("row", "source", turn(F.col("j")).alias("round"), low.alias("low"), (low - F.col("at")).alias("start"), (high - low).alias("length"))
    parts = parts.groupBy("row", "source", "round").agg(F.min("low").alias("low"), F.min("start").alias("start"), F.sum("length").alias("length"))

    wide = max(16, math.isqrt(math.ceil(tokens / window)))
    span = parts.withColumn("bucket", F.call_function("div", F.col("round"), F.lit(wide)))
    order = running_start(span, [], "bucket", ["round", "source", "low", "row"], "length", "place")
    first, last = F.call_function("div", F.col("place"), F.lit(window)), F.call_function("div", F.col("place") + F.col("length") - 1, F.lit(window))
    cut = order.select("row", "start", "length", "place", F.explode(F.sequence(first, last)).alias("sequence_id"))
    begin = F.greatest(F.col("place"), F.col("sequence_id") * window)
    end = F.least(F.col("place") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return cut.select(
        "row",
        (F.col("start") + begin - F.col("place")).alias("start"),
        (end - begin).alias("length"),
        "sequence_id",
        (begin - F.col("sequence_id") * window).alias("offset"),
    )


def pack(
    documents: DataFrame, ids: str = "ids", source: str = "source", doc_id: str = "doc_id", width: int = 2,
    shares: Mapping[str, float] | None = None, window: int = WINDOW, packet: int = PACKET, row: str | None = None,
) -> DataFrame:
    """Pieces of tokenized documents: ``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` holds little-endian numbers of ``width`` bytes; the pieces' ids are little-endian 32-bit numbers. ``row`` is a
    column that names each row and has been written with it. Without one, the rows are written here with a name, as two
    scans are not sure to number rows alike when executors come and go.
    """
    if row is None:
        row = free_name(documents, "row")
        documents = written(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = documents.select(
        F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(ids, F.lit(b"")).alias("ids")
    )
    order = F.xxhash64("doc_id", "row")
    sizes = named.select("row", "source", order.alias("order"), F.call_function("div", F.octet_length("ids"), F.lit(width)).alias("size"))
    pieces = plan_pieces(sizes, shares, window, packet)
    lists = pieces.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    schema = "doc_id bigint, source string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    joined = named.join(lists, F.col("row") == F.col("_row")).select("doc_id", F.col("source").cast("string"), "ids", "pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("pieces")
                flat = lists.flatten()
                fields = {name: flat.field(i).to_numpy() for i, name in enumerate(("start", "length", "sequence_id", "offset"))}
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                texts = [np.frombuffer(x, f"<u{width}").astype("<u4") for x in part.column("ids").to_pylist()]
                cut = [texts[o][s : s + n].tobytes() for o, s, n in zip(owner.tolist(), fields["start"].tolist(), fields["length"].tolist())]
                whole = np.array([len(t) for t in texts], np.int64)[owner]
                take = pa.array(owner)
                columns = [
                    part.column("doc_id").take(take), part.column("source").take(take), pa.array(fields["start"]), pa.array(fields["length"]),
                    pa.array(whole), pa.array(fields["sequence_id"]), pa.array(fields["offset"]), pa.array(cut, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return joined.mapInArrow(run, schema)


def assemble(pieces: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """The windows themselves: ``sequence_id, used, padded, input_ids, doc_starts``.

    Only the last window can hold less than ``window`` tokens; it is padded to the next power of two.
    """
    row = F.struct("offset", "doc_id", "length", F.hex("ids").alias("ids"))
    lists = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("length").alias("used"))
    raw = F.unhex(F.array_join(F.col("rows.ids"), ""))
    power = F.pow(F.lit(2.0), F.ceil(F.log2("used"))).cast("bigint")
    padded = lists.select("sequence_id", "used", F.least(power, F.lit(window)).alias("padded"), raw.alias("raw"), F.col("rows.offset").alias("doc_starts"))

    @F.arrow_udf("array<bigint>")
    def numbers(raws: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for x, n in zip(raws.to_pylist(), widths.to_pylist()):
            ids = np.full(n, pad_id, np.int64)
            found = np.frombuffer(x, "<u4")
            ids[: len(found)] = found
            out.append(ids)
        return pa.array(out, pa.list_(pa.int64()))

    return padded.select("sequence_id", "used", "padded", numbers("raw", "padded").alias("input_ids"), "doc_starts")
