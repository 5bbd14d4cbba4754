import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glosswork.llm.catalog import QUERIES
from glosswork.llm.packing import PACKET, WINDOW, assemble, pack, plan_pieces
from glosswork.plans import written


def binary(ids):
    return np.array(ids, "<u2").tobytes()


def tokens(spark, rows):
    return written(spark.createDataFrame(rows, "doc_id bigint, source string, ids binary"), "test")


def test_query_places_every_id_once(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in texts.items()}
    pieces = QUERIES["op2_packing"](spark, folder).collect()
    at, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.doc_tokens == len(wanted[p.doc_id])
        assert zlib.crc32(wanted[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
        at[p.doc_id].append((p.start, p.length))
        used[p.sequence_id].append((p.offset, p.length))
    assert set(at) == set(wanted)
    for d, spans in at.items():
        assert gapless(spans) == len(wanted[d])
    sizes = [gapless(used[s]) for s in sorted(used)]
    assert sorted(used) == list(range(len(used)))
    assert all(n == WINDOW for n in sizes[:-1])


def gapless(spans):
    end = 0
    for start, length in sorted(spans):
        assert start == end and length > 0
        end += length
    return end


def test_every_window_meets_the_shares(spark):
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 7}", binary([5] * (1 + i * 37 % 3000))) for i in range(400)]
    total, own, seen = 0, defaultdict(int), defaultdict(lambda: defaultdict(int))
    for _, s, x in rows:
        own[s] += len(x) // 2
        total += len(x) // 2
    for p in pack(tokens(spark, rows)).collect():
        seen[p.sequence_id][p.source] += p.length
    carried = defaultdict(float)
    for w in sorted(seen)[:-1]:
        for s in own:
            carried[s] += WINDOW * own[s] / total - seen[w][s]
            assert abs(carried[s]) <= len(own) * PACKET


def test_given_shares_hold_until_a_queue_is_dry(spark):
    rows = [(i, "a" if i % 2 else "b", binary([1] * 500)) for i in range(200)]
    first = defaultdict(int)
    for p in pack(tokens(spark, rows), shares={"a": 3.0, "b": 1.0}).collect():
        if p.sequence_id < 10:
            first[p.source] += p.length
    assert abs(first["a"] / (first["a"] + first["b"]) - 0.75) < 0.01


def test_odd_rows(spark):
    rows = [(None, None, binary([7])), (1, None, None), (1, "s", binary(range(9000))), (1, "s", binary(range(9000))), (2, "", b"")]
    df = tokens(spark, rows).withColumns({"row": F.lit(1), "bucket": F.lit("x"), "pieces": F.lit(2)})
    pieces = pack(df).collect()
    assert sum(p.length for p in pieces) == 18001
    assert {p.doc_id for p in pieces} == {None, 1}
    empty = pack(tokens(spark, []))
    assert empty.count() == 0


def test_assembled_windows(spark):
    rows = [(i, "s", binary(range(1, 2001))) for i in range(5)]
    windows = assemble(pack(tokens(spark, rows)), pad_id=0).orderBy("sequence_id").collect()
    assert [(w.used, w.padded, len(w.input_ids)) for w in windows] == [(4096, 4096, 4096), (4096, 4096, 4096), (1808, 2048, 2048)]
    assert sorted(i for w in windows for i in w.input_ids if i) == sorted(list(range(1, 2001)) * 5)


def test_closed_form_equals_a_sequential_round_robin(spark):
    """Queues that take turns, each sending packets while its carried credit is above nothing."""
    window, packet = 256, 16
    rows = [(i, "abc"[i % 3] if i % 5 else "d", i * 7919 % 1000 * (1 << 40) + i, 1 + i * 37 % 90) for i in range(300)]
    sizes = spark.createDataFrame(rows, "row bigint, source string, order bigint, size bigint")
    openings = {r.source: r.o for r in sizes.select("source", F.pmod(F.xxhash64("source"), F.lit(packet)).alias("o")).distinct().collect()}
    own = defaultdict(int)
    for _, s, _, n in rows:
        own[s] += n
    total = sum(own.values())
    queues = {s: [(r, k) for _, _, r, n in sorted(((o >> 16) % 256, o, r, n) for r, q, o, n in rows if q == s) for k in range(n)] for s in own}
    credit, sent, order = {s: -float(openings[s]) for s in own}, {s: 0 for s in own}, []
    while any(sent[s] < len(queues[s]) for s in own):
        for s in sorted(own):
            credit[s] += window * own[s] / total
            while credit[s] > 0:
                order += queues[s][sent[s] : sent[s] + packet]
                sent[s] += packet
                credit[s] -= packet
    placed = {}
    for p in plan_pieces(sizes, window=window, packet=packet).collect():
        for k in range(p.length):
            placed[p.sequence_id * window + p.offset + k] = (p.row, p.start + k)
    assert [placed[i] for i in range(total)] == order


def test_rows_keep_their_names_when_scans_are_split_otherwise(spark):
    """The scans of one plan may be cut differently, as when executors come and go between its stages."""
    rows = [(i, "ab"[i % 2], binary([i] * (20 + i))) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id bigint, source string, ids binary").repartition(5)
    pieces = pack(written(documents, "test"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = pieces.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(p.length for p in found) == sum(20 + i for i in range(400))
    assert all(set(np.frombuffer(p.ids, "<u4")) == {p.doc_id} for p in found)
