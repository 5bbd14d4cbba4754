import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from glosswork.llm.catalog import QUERIES
from glosswork.llm.encoding import PieceEncoder
from glosswork.llm.wavelet import Shard, pack_shard, read_shards, write_shards
from glosswork.plans import scratch_folder

PIECES = [*" \n\t  ab1'sé́.!<|endoftext|>\x1c\x85 漢😀ẞΣİ", "<|endoftext|>", "'ll", "\r\n", "word", " The", "  ", "K", "ﬁ", "क़."]


@pytest.mark.parametrize("file, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_change_no_id(file, kind):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(0, 20))) for _ in range(5000)] + [None, ""]
    check(file, kind, texts)
    check(file, kind, [" a\x00 b", "\x00", None, "plain text."])


def check(file, kind, texts):
    encoder = PieceEncoder(public_tokenizers.path(file), kind)
    ids, sizes = encoder.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    wanted = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for text, end, size, e in zip(texts, ends, sizes, wanted):
        assert ids[end - size : end].tolist() == e.ids, text


def test_query_equals_plain_encoding(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in QUERIES["op6_wavelet_ids"](spark, folder).collect()}
    assert len(rows) == len(texts)
    start = 0
    for d in sorted(texts):
        ids = np.array(tokenizer.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n, planes", [(0, 16), (1, 16), (300, 5), (70_000, 16), (140_000, 17)])
def test_rank_select_access(n, planes):
    ids = np.minimum(np.random.default_rng(2).zipf(1.3, n), (1 << planes) - 1).astype(np.uint32)
    shard = Shard(pack_shard([None, 4], np.array([n, 0]), ids, planes))
    assert (shard.all_ids() == ids).all() and shard.doc_ids == [None, 4] and shard.sizes.tolist() == [n, 0]
    for i in range(0, n, max(1, n // 40)):
        token = int(ids[i])
        seen = int((ids[:i] == token).sum())
        assert shard.access(i) == token and shard.rank(token, i) == seen and shard.select(token, seen) == i
    assert shard.occurrences(3) == np.flatnonzero(ids == 3).tolist()
    assert shard.count(1, n // 4, n // 2) == int((ids[n // 4 : n // 2] == 1).sum())
    assert shard.rank(1 << planes, n) == 0
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(1, shard.count(1))


def test_shards_in_order_with_odd_rows(spark):
    rows = [(5, [1, 2]), (None, [9]), (5, [1]), (2, []), (3, None), (4, list(range(500)))]
    data = [(d, None if x is None else np.array(x, "<u2").tobytes(), "x") for d, x in rows]
    path = scratch_folder(spark, "shards")
    write_shards(spark.createDataFrame(data, "doc_id bigint, ids binary, part string"), path, 16, shard_tokens=100, partitions=3)
    back = sorted(read_shards(spark, path).collect(), key=lambda r: (r.start, r.n_tokens))
    texts = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in back]
    assert sum(len(x) for _, x in texts) == 504
    assert [(d, x) for d, x in texts if x] == [(None, [9]), (4, list(range(500))), (5, [1]), (5, [1, 2])]
    assert sorted(d for d, x in texts if not x) == [2, 3]
    empty = scratch_folder(spark, "shards")
    write_shards(spark.createDataFrame([], "doc_id bigint, ids binary"), empty, 16)
    assert read_shards(spark, empty).count() == 0
