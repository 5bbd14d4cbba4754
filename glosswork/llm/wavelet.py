"""Token ids on disk as wavelet matrices: one compressed file of succinct bit planes for each shard.

A wavelet matrix keeps a sequence of numbers as one bit plane for each bit, the highest first. After each plane the
sequence is parted stably, zeros before ones, so that counting bits answers three questions without the sequence:
which token stands at a place, how often a token occurs before a place, and where its k-th occurrence is.

A shard's file holds, after a fixed header, the ids of its documents, their sizes, the number of zeros of each plane
and the planes, cut into blocks of ``BLOCK_BITS`` bits. Each block is a compressed frame of its own, and a directory
has its place and the ones before it, so that a question touches one block of each plane. A shard is one row of a
Parquet table, which is what any store that Spark reads can hold and what a lost executor's task writes again without
harm.

Defined results: documents are ordered by id, nulls first, equal ids by their token ids. A document without tokens,
a shard of one document and an empty table are ordinary. Columns beside the id and the tokens are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"WVM1"
HEADER = "<4sIQQII"  # magic, planes, documents, tokens, bits in a block, bytes of the directory
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 20  # tokens from which a shard is closed: about 2 MB of planes, which stay in a core's cache


def build(ids: np.ndarray, planes: int) -> list[tuple[np.ndarray, int]]:
    """The bit planes of a sequence and the number of zeros in each."""
    level = np.ascontiguousarray(ids, _narrow(planes))
    out = []
    for shift in range(planes - 1, -1, -1):
        bits = (level & level.dtype.type(1 << shift)) != 0
        zeros = np.compress(~bits, level)
        out.append((bits, len(zeros)))
        level = np.concatenate([zeros, np.compress(bits, level)])
    return out


def _narrow(planes: int) -> type:
    return np.uint16 if planes <= 16 else np.uint32


def pack_shard(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, planes: int) -> bytes:
    """The file of one shard."""
    pressed = zstandard.ZstdCompressor(level=1)
    zeros, directory, frames = [], [], []
    for bits, none in build(ids, planes):
        zeros.append(none)
        packed = np.packbits(bits, bitorder="little")
        ones, step = 0, BLOCK_BITS // 8
        for at in range(0, max(len(packed), 1), step):
            frames.append(pressed.compress(packed[at : at + step].tobytes()))
            directory.append((len(frames[-1]), ones))
            ones += int(np.count_nonzero(bits[at * 8 : at * 8 + BLOCK_BITS]))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    front = pressed.compress(
        known.tobytes() + numbers.tobytes() + sizes.astype(np.int64).tobytes()
        + np.array(zeros, np.int64).tobytes() + np.array(directory, np.int64).tobytes()
    )
    header = struct.pack(HEADER, MAGIC, planes, len(doc_ids), len(ids), BLOCK_BITS, len(front))
    return b"".join([header, front, *frames])


class Shard:
    """Reads one shard's file."""

    def __init__(self, content: bytes):
        magic, self.planes, docs, self.tokens, self.block_bits, front = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.content, self.cache = content, {}
        self.frame = zstandard.ZstdDecompressor()
        at = struct.calcsize(HEADER)
        raw = self.frame.decompress(content[at : at + front])
        known = np.frombuffer(raw, np.uint8, docs)
        numbers = np.frombuffer(raw, np.int64, docs, docs)
        self.sizes = np.frombuffer(raw, np.int64, docs, 9 * docs)
        self.doc_ids = [int(n) if k else None for k, n in zip(known, numbers)]
        self.zeros = np.frombuffer(raw, np.int64, self.planes, 17 * docs)
        directory = np.frombuffer(raw, np.int64, offset=17 * docs + 8 * self.planes).reshape(self.planes, -1, 2)
        ends = np.cumsum(directory[:, :, 0].ravel()).reshape(self.planes, -1) + at + front
        self.places = ends - directory[:, :, 0]
        self.ends, self.before = ends, directory[:, :, 1]

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of one block and, for each place in it, the ones before."""
        if (plane, block) not in self.cache:
            raw = self.frame.decompress(self.content[self.places[plane, block] : self.ends[plane, block]])
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
            bits = bits[: min(self.block_bits, self.tokens - block * self.block_bits)]
            self.cache[plane, block] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self.cache[plane, block]

    def _ones(self, plane: int, place: int) -> int:
        """Ones before a place of a plane."""
        if place >= self.tokens:
            return self.tokens - int(self.zeros[plane])
        block, inside = divmod(place, self.block_bits)
        return int(self.before[plane, block] + self._block(plane, block)[1][inside])

    def access(self, place: int) -> int:
        """The token at a place."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        token = 0
        for plane in range(self.planes):
            block, inside = divmod(place, self.block_bits)
            bit = int(self._block(plane, block)[0][inside])
            ones = self._ones(plane, place)
            token, place = token << 1 | bit, int(self.zeros[plane]) + ones if bit else place - ones
        return token

    def _path(self, token: int, place: int) -> tuple[int, int]:
        """Where the token's run begins after the last plane, and where the given place leads."""
        low = 0
        for plane in range(self.planes):
            if token >> (self.planes - 1 - plane) & 1:
                low = int(self.zeros[plane]) + self._ones(plane, low)
                place = int(self.zeros[plane]) + self._ones(plane, place)
            else:
                low, place = low - self._ones(plane, low), place - self._ones(plane, place)
        return low, place

    def rank(self, token: int, place: int) -> int:
        """How often the token occurs before a place."""
        if token >> self.planes or token < 0:
            return 0
        low, high = self._path(token, min(place, self.tokens))
        return high - low

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often the token occurs in a range."""
        return self.rank(token, self.tokens if stop is None else stop) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """The place of the token's occurrence number ``k``, counted from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._path(token, 0)[0] + k
        for plane in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - plane) & 1
            place = self._find(plane, bit, place - int(self.zeros[plane]) if bit else place)
        return place

    def _find(self, plane: int, bit: int, k: int) -> int:
        """The place of the bit's occurrence number ``k`` in a plane."""
        ones = self.before[plane]
        seen = ones if bit else np.arange(len(ones)) * self.block_bits - ones
        block = int(np.searchsorted(seen, k, side="right")) - 1
        bits = self._block(plane, block)[0]
        return block * self.block_bits + int(np.flatnonzero(bits == bit)[k - int(seen[block])])

    def occurrences(self, token: int) -> list[int]:
        """All places of a token."""
        return [self.select(token, k) for k in range(self.count(token))]

    def all_ids(self) -> np.ndarray:
        """The whole sequence, put together from the lowest plane upwards."""
        level = np.zeros(self.tokens, _narrow(self.planes))
        for plane in range(self.planes - 1, -1, -1):
            raw = [self.frame.decompress(self.content[a:b]) for a, b in zip(self.places[plane], self.ends[plane])]
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), bitorder="little", count=self.tokens).view(bool)
            above, none = np.empty_like(level), int(self.zeros[plane])
            above[np.flatnonzero(~bits)] = level[:none]
            above[np.flatnonzero(bits)] = level[none:] | level.dtype.type(1 << (self.planes - 1 - plane))
            level = above
        return level.astype(np.uint32)


def write_shards(
    df: DataFrame, path: str, planes: int, doc_id: str = "doc_id", ids: str = "ids", shard_tokens: int = SHARD_TOKENS,
    width: int = 2, partitions: int | None = None,
) -> None:
    """Write documents with their ids (little-endian numbers of ``width`` bytes) as shards, ascending by document id.

    The order is a range partition by id; no task holds more than one open shard, and a shard ends with the document
    that fills it. A row says which part and place a shard has in the order.
    """
    schema = "part int, place int, documents bigint, tokens bigint, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held, place, part = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(p) // width for p in parts], np.int64)
            content = pack_shard(names, sizes, np.frombuffer(b"".join(parts), f"<u{width}"), planes)
            row = [[part], [place], [len(names)], [held], [content]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(v, k) for v, k in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(made, ["part", "place", "documents", "tokens", "content"])

        for batch in batches:
            for name, raw, part in zip(*(batch.column(i).to_pylist() for i in range(3))):  # noqa: B007
                names.append(name)
                parts.append(raw or b"")
                held += len(parts[-1]) // width
                if held >= shard_tokens:
                    yield closed()
                    names, parts, held, place = [], [], 0, place + 1
        if names:
            yield closed()

    spread = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids"))
    spread = spread.repartitionByRange(partitions, "doc_id") if partitions else spread.repartitionByRange("doc_id")
    spread.sortWithinPartitions("doc_id", "ids").withColumn("part", F.spark_partition_id()).mapInArrow(run, schema).write.option(
        "compression", "none"
    ).parquet(path)


def read_shards(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of all shards as ``doc_id, start, n_tokens, ids``; ``start`` counts the tokens before it.

    With ``digest`` the ids, as little-endian 32-bit numbers, give place to their check sum ``ids_crc32``.

    Each shard is read by itself. The tokens before a shard come from the small table of shards, bucket by bucket.
    """
    from glosswork.llm.common import running_start

    schema = "part int, place int, doc_id bigint, at bigint, n_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, place, content in zip(*(batch.column(i) for i in range(3))):
                shard = Shard(content.as_py())
                raw, ends = shard.all_ids().tobytes(), np.cumsum(shard.sizes)
                for low in range(0, len(ends), 2000):
                    e, n = ends[low : low + 2000], shard.sizes[low : low + 2000]
                    values = [
                        pa.array([part.as_py()] * len(e), pa.int32()),
                        pa.array([place.as_py()] * len(e), pa.int32()),
                        pa.array(shard.doc_ids[low : low + 2000], pa.int64()),
                        pa.array(e - n),
                        pa.array(n),
                        pa.array([raw[4 * (b - k) : 4 * b] for b, k in zip(e.tolist(), n.tolist())], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(values, ["part", "place", "doc_id", "at", "n_tokens", "ids"])

    rows = spark.read.parquet(path)
    shards = running_start(rows.select("part", "place", "tokens"), [], "part", ["place"], "tokens", "before")
    starts = shards.select("part", "place", "before")
    documents = rows.select("part", "place", "content").mapInArrow(run, schema)
    if digest:
        documents = documents.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return documents.join(starts, ["part", "place"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", documents.columns[-1]
    )
