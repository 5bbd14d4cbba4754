"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork import sources as io
from glosswork import streaming as live
from glosswork.catalog import views as v
from glosswork.functions import letter_index, snippet, tokens, whole_div
from glosswork.functions.arrays import flattened
from glosswork.operators.tokens import FIRST_WORD_ID
from glosswork.plans import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BLOCK = 512
BUDGET = 8192
SEED = 42


def query(run: Query) -> Query:
    QUERIES[run.__name__.removeprefix("run_")] = run
    return run


def _text_ids(spark: SparkSession, folder: str, specials: bool = True) -> DataFrame:
    lists = v.token_lists(spark, folder)
    return op.encode_ids(lists, op.build_vocab(lists), specials=specials).drop("toks")


def _padded_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Whole lists with up to three places of padding."""
    masked = op.truncate_pad(_text_ids(spark, folder), None)
    room = lambda value: F.array_repeat(F.lit(value), (F.col("id") % 4).cast("int"))
    return masked.withColumns(
        {"input_ids": F.concat("input_ids", room(1)), "attention_mask": F.concat("attention_mask", room(0))}
    )


# Sources and sinks


@query
def read_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "knowledge")
    io.write_knowledge(v.knowledge(spark, folder), path)
    return io.read_knowledge(spark, path).select("id", "prompt", F.array_join("targets", "|").alias("targets"))


@query
def read_knowledge_split(spark: SparkSession, folder: str) -> DataFrame:
    """All prompts in few large arrays, each read by as many tasks as it has splits."""
    path = scratch_folder(spark, "knowledge")
    io.write_knowledge(v.knowledge(spark, folder), path, file_rows=100_000)
    return io.read_knowledge(spark, path, split=True).select("id", "prompt", F.array_join("targets", "|").alias("targets"))


@query
def read_task_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "task")
    io.write_task_jsonl(v.task(spark, folder), path)
    return io.read_task_jsonl(spark, path)


@query
def read_custom(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "custom")
    orders = v.table(spark, folder, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    held_out = F.col("o_orderkey") % 10 == 0
    orders.where(~held_out).write.option("header", True).csv(f"{path}/train.csv")
    orders.where(held_out).write.option("header", True).csv(f"{path}/validation.csv")
    splits = io.read_custom(spark, f"{path}/train.csv", f"{path}/validation.csv")
    both = None
    for name, rows in splits.items():
        part = rows.select(
            F.lit(name).alias("split"),
            F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
            F.col("o_custkey").cast("bigint").alias("o_custkey"),
            "o_orderstatus",
            F.col("o_totalprice").cast("double").alias("o_totalprice"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
            "o_orderpriority",
        )
        both = part if both is None else both.unionByName(part)
    return both


@query
def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return io.read_corpus(spark, f"{folder}/documents.parquet", "text", order="doc_id")


@query
def read_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as a corpus that came in three parts, each numbered when it was there."""
    root = scratch_folder(spark, "arriving")
    documents = v.table(spark, folder, "documents").select("doc_id", "text")
    bounds = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    third = (bounds[1] - bounds[0]) // 3 + 1
    for part in range(3):
        low = bounds[0] + part * third
        arrived = documents.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + third))
        arrived.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select("text").write.parquet(f"{root}/corpus/{part}")
        io.number_new_files(spark, f"{root}/corpus/*", f"{root}/ledger")
    return io.read_numbered(spark, f"{root}/corpus/*", f"{root}/ledger")


@query
def embedding_store(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "embeddings")
    io.write_embeddings(v.vectors(spark, folder, "raw_id").withColumn("part", F.col("raw_id") % 4), path, "part")
    return io.read_embeddings(spark, path).select("raw_id", v.listed_micro(F.col("embedding")).alias("embedding"))


@query
def load_named_task(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_folder(spark, "tasks")
    rows = v.pairs(spark, folder)
    held_out = F.col("id") % 4 == 0
    rows.where(~held_out).write.parquet(f"{root}/mrpc/train.parquet")
    rows.where(held_out).write.parquet(f"{root}/mrpc/validation.parquet")
    splits = io.load_named_task(spark, "mrpc", root)
    named = [rows.withColumn("split", F.lit(name)) for name, rows in splits.items()]
    return named[0].unionByName(named[1])


@query
def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark, "metrics")
    rows = v.points(spark, folder)
    io.write_metrics(rows.where(F.col("step") % 2 == 0), path)
    io.write_metrics(rows.where(F.col("step") % 2 == 1), path)
    return io.read_metrics(spark, path).select("run", "epoch", "step", "metric", "value")


# Text and arrays


@query
def resolve_text_columns(spark: SparkSession, folder: str) -> DataFrame:
    documents = v.texts(spark, folder)
    shapes = {
        "named": (v.pairs(spark, folder).select("id", "sentence1", "sentence2", "label"), "mrpc"),
        "pair": (v.pairs(spark, folder), None),
        "first two": (documents.select("id", "text", "source", F.col("lang").alias("label")), None),
        "single": (documents.select("id", "text", F.col("lang").alias("label")), None),
    }
    found = None
    for shape, (rows, task) in shapes.items():
        first, second = op.resolve_text_columns(rows.drop("id"), task)
        part = rows.select(
            F.lit(shape).alias("shape"),
            "id",
            F.col(first).alias("text1"),
            (F.col(second) if second else F.lit(None).cast("string")).alias("text2"),
        )
        found = part if found is None else found.unionByName(part)
    return found


@query
def project_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.pairs(spark, folder)
    labels = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), (F.lit(10) + F.max("label")).alias("label_id")
    )
    return op.project_pairs(rows, "mrpc", labels, keep=("id",))


@query
def prompt_fill(spark: SparkSession, folder: str) -> DataFrame:
    return op.prompt_fill(v.knowledge(spark, folder)).select("id", "text")


@query
def prompt_fill_or_raw(spark: SparkSession, folder: str) -> DataFrame:
    filled = op.prompt_fill(v.knowledge_mixed(spark, folder), trim=False, raw_if_empty=True)
    return filled.select("id", "text")


@query
def run_snippet(spark: SparkSession, folder: str) -> DataFrame:
    return v.texts(spark, folder).select("id", snippet(F.col("text")).alias("snippet"))


@query
def tokenize_offsets(spark: SparkSession, folder: str) -> DataFrame:
    found = op.tokenize(v.texts(spark, folder))
    return found.select(
        "id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens.tok", " ").alias("toks"),
        v.listed(F.col("tokens.b")).alias("begins"),
        v.listed(F.col("tokens.e")).alias("ends"),
    )


@query
def encode_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _text_ids(spark, folder).select("id", v.listed(F.col("input_ids")).alias("input_ids"))


@query
def build_vocab(spark: SparkSession, folder: str) -> DataFrame:
    found = op.build_vocab(v.token_lists(spark, folder))
    return found.select("token", "rows", F.col("token_id").cast("bigint").alias("token_id"))


@query
def truncate_pad(spark: SparkSession, folder: str) -> DataFrame:
    padded = op.truncate_pad(_text_ids(spark, folder), BLOCK, pad_to_max=True)
    return padded.select(
        "id", v.listed(F.col("input_ids")).alias("input_ids"), v.listed(F.col("attention_mask")).alias("attention_mask")
    )


@query
def position_ids(spark: SparkSession, folder: str) -> DataFrame:
    padded = _padded_ids(spark, folder)
    counted = op.position_ids(padded, "range").withColumnRenamed("position_ids", "plain")
    both = op.position_ids(counted, "padding")
    return both.select(
        "id", v.listed(F.col("plain")).alias("plain"), v.listed(F.col("position_ids")).alias("after_padding")
    )


@query
def choice_expand(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.choice_expand(v.choices(spark, folder))
    return rows.withColumn("choice", F.col("choice").cast("bigint"))


@query
def choice_regroup(spark: SparkSession, folder: str) -> DataFrame:
    best = op.choice_regroup(v.choice_scores(spark, folder))
    scores = v.listed(F.col("scores").cast("array<bigint>")).alias("scores")
    return best.select("id", scores, F.col("winner").cast("bigint").alias("winner"))


@query
def run_letter_index(spark: SparkSession, folder: str) -> DataFrame:
    return v.choices(spark, folder).select("id", letter_index(F.col("answerKey")).cast("bigint").alias("label"))


@query
def flatten_masked(spark: SparkSession, folder: str) -> DataFrame:
    padded = _padded_ids(spark, folder)
    return op.flatten_masked(padded).select(
        "id", F.col("pos").cast("bigint").alias("pos"), F.col("token_id").cast("bigint").alias("token_id")
    )


@query
def experiment_manifest(spark: SparkSession, folder: str) -> DataFrame:
    parsed = op.parse_manifest(v.runs(spark, folder), "-domain", shots="shots")
    return parsed.select(
        "run_name",
        "dataset",
        "type",
        F.col("batch_size").cast("bigint").alias("batch_size"),
        "lr",
        "seed",
        F.col("domain_adapter").cast("bigint").alias("domain_adapter"),
        "adapter_type",
        "runner",
        "few_shot",
    )


@query
def encode_pair(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.pairs(spark, folder).select(
        "id", tokens(F.col("sentence1")).alias("t1"), tokens(F.col("sentence2")).alias("t2")
    )
    vocab = op.build_vocab(v.token_lists(spark, folder))
    one = op.encode_ids(rows, vocab, tokens="t1", name="ids1")
    both = op.encode_ids(one, vocab, tokens="t2", name="ids2")
    return op.encode_pair(both, "ids1", "ids2", 64).select("id", v.listed(F.col("input_ids")).alias("input_ids"))


# Ids, samples and labels


@query
def dense_row_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.texts(spark, folder).select("id", "lang", "source")
    return op.dense_row_id(rows, ["lang", "source", "id"])


@query
def head_slice(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.dense_row_id(v.texts(spark, folder).select("id"), ["id"])
    return op.head_slice(rows, 100).withColumn("size", F.lit(100)).unionByName(
        op.head_slice(rows, -1).withColumn("size", F.lit(-1))
    ).select(F.col("size").cast("bigint").alias("size"), "id", "row_id")


@query
def seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    return op.seeded_shuffle(v.texts(spark, folder).select("id"), SEED)


@query
def corpus_shard(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.dense_row_id(v.texts(spark, folder).select("id", "text"), ["id"])
    found = None
    for shard in range(3):
        part = op.corpus_shard(rows, 3, shard, rebase=True).withColumn("shard", F.lit(shard).cast("bigint"))
        found = part if found is None else found.unionByName(part)
    return found


@query
def kshot(spark: SparkSession, folder: str) -> DataFrame:
    return op.kshot(v.languages(spark, folder), 16, SEED)


@query
def kshot_early_stop(spark: SparkSession, folder: str) -> DataFrame:
    return op.kshot_early_stop(v.sources_by_language(spark, folder), 2, SEED, patience=100)


@query
def label_index_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.sources_by_language(spark, folder)
    train, later = rows.where(F.col("id") % 3 != 0), rows.where(F.col("id") % 3 == 0)
    index = op.label_index_first_seen([train, later])
    return op.apply_label_index(rows, index).select("id", "label", "label_id")


@query
def label_index_sorted(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.sources_by_language(spark, folder)
    return op.apply_label_index(rows, op.label_index_sorted(rows), unseen="error").select("id", "label", "label_id")


@query
def label_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    documents = v.texts(spark, folder)
    data = op.label_index_sorted(documents, "lang").select(F.col("lang").alias("name"), F.col("label_id").alias("idx"))
    same = data.select(F.upper("name").alias("name"), (F.lit(100) - F.col("idx")).alias("idx"))
    other = op.label_index_sorted(documents, "source").select(
        F.col("source").alias("name"), F.col("label_id").alias("idx")
    )
    found = op.label_reconcile(same, data).withColumn("side", F.lit("same")).unionByName(
        op.label_reconcile(other, data).withColumn("side", F.lit("other"))
    )
    return found.withColumn("from_model", F.col("from_model").cast("bigint"))


@query
def sample_n(spark: SparkSession, folder: str) -> DataFrame:
    return op.sample_n(v.texts(spark, folder).select("id", "text"), 3, SEED)


@query
def minibatch(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.dense_row_id(v.texts(spark, folder), ["id"])
    batches = op.minibatch(rows, 16, ["text", "lang"], drop_last=True)
    return batches.select(
        "batch_id",
        F.col("rows").cast("bigint").alias("rows"),
        F.array_join("text", "\n").alias("texts"),
        F.array_join("lang", " ").alias("langs"),
    )


@query
def gather_trim(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.predict(v.logits(spark, folder)).select("id", "label", F.col("pred").cast("bigint").alias("pred"))
    padding = 8 - rows.count() % 8
    padded = rows.unionByName(rows.where(F.col("id") < padding)).withColumn("label", F.col("label").cast("bigint"))
    return op.gather_trim(padded)


@query
def zip_shortest(spark: SparkSession, folder: str) -> DataFrame:
    left = v.texts(spark, folder).select("id", "text")
    right = v.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("other"))
    return op.zip_shortest(left, right, ["id"], ["item_id"])


# Joins and retrieval


@query
def retrieve_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = op.retrieve_topk(v.vectors(spark, folder, "id"), v.vectors(spark, folder, "raw_id"), 5)
    return hits.withColumn("score", F.round("score", 6))


@query
def retrieve_topk_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector asks: the same hits as a full scan, from the lists of an index that can hold one."""
    index = op.build_index(v.vectors(spark, folder, "raw_id"), scratch_folder(spark, "index"))
    return op.search_index(v.vectors(spark, folder, "id"), index, 5).withColumn("score", F.round("score", 6))


@query
def project_queries(spark: SparkSession, folder: str) -> DataFrame:
    weight, bias = v.hash_weights(64, v.OUT_DIMS)
    moved = op.project_queries(v.vectors(spark, folder, "id"), weight, bias)
    return moved.select("id", v.listed_micro(F.col("embedding")).alias("embedding"))


@query
def fetch_docs(spark: SparkSession, folder: str) -> DataFrame:
    hits = op.retrieve_topk(v.vectors(spark, folder, "id"), v.document_vectors(spark, folder, "raw_id"), 3)
    return op.fetch_docs(hits, v.corpus(spark, folder)).select("query_id", "rank", "raw_id", "text")


@query
def retrieval_augment(spark: SparkSession, folder: str) -> DataFrame:
    corpus = v.corpus(spark, folder)
    hits = op.retrieve_topk(v.document_vectors(spark, folder, "id"), v.document_vectors(spark, folder, "raw_id"), 2)
    texts = corpus.select(F.col("raw_id").alias("id"), "text")
    return op.retrieval_augment(texts, hits, corpus).select("id", "augmented")


@query
def retrieval_replay(spark: SparkSession, folder: str) -> DataFrame:
    domain = v.document_vectors(spark, folder, "id").withColumn("bk", whole_div(F.col("id"), v.BATCH_ROWS))
    record = v.document_vectors(spark, folder, "raw_id")
    corpus = v.corpus(spark, folder).select("raw_id", tokens(F.col("text")).alias("input_ids"))
    found = op.retrieval_replay(domain, record, corpus, 2, BUDGET)
    return found.withColumn("n_items", F.col("n_items").cast("bigint"))


@query
def retrieval_replay_index(spark: SparkSession, folder: str) -> DataFrame:
    domain = v.document_vectors(spark, folder, "id").withColumn("bk", whole_div(F.col("id"), v.BATCH_ROWS))
    index = op.build_index(v.document_vectors(spark, folder, "raw_id"), scratch_folder(spark, "index"))
    corpus = v.corpus(spark, folder).select("raw_id", tokens(F.col("text")).alias("input_ids"))
    found = op.retrieval_replay(domain, index, corpus, 2, BUDGET, search=op.search_index)
    return found.withColumn("n_items", F.col("n_items").cast("bigint"))


@query
def span_match(spark: SparkSession, folder: str) -> DataFrame:
    found = op.span_match(op.with_spans(v.knowledge(spark, folder)))
    return found.select(
        "id", F.col("token_no").cast("bigint").alias("token_no"), F.col("span_no").cast("bigint").alias("span_no"), "tok"
    )


@query
def span_join(spark: SparkSession, folder: str) -> DataFrame:
    """``span_match`` from a table of tokens and a table of spans."""
    rows = op.with_spans(v.knowledge(spark, folder))
    tokens = flattened(rows, ["id"], F.col("tokens"), "t", "token_no").select("id", "token_no", "t.b", "t.e", "t.tok")
    spans = flattened(rows, ["id"], F.col("spans"), "s", "span_no").select("id", "span_no", "s.b", "s.e")
    found = op.span_join(tokens, spans, width=16)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("token_no", "span_no")})


@query
def embed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    found = op.embed_corpus(v.texts(spark, folder).withColumnRenamed("id", "raw_id"))
    return found.select("raw_id", v.listed_micro(F.col("embedding")).alias("embedding"))


@query
def refresh_record(spark: SparkSession, folder: str) -> DataFrame:
    """A record built from an older state of all documents, then brought up to them."""
    now = v.texts(spark, folder).withColumnRenamed("id", "raw_id").select("raw_id", "text")
    older = F.when(F.col("raw_id") % 7 == 0, F.concat("text", F.lit(" older"))).otherwise(F.col("text"))
    was = now.where("raw_id % 11 <> 0").withColumn("text", older)
    gone = now.select((-1 - F.col("raw_id")).alias("raw_id"), "text").where("raw_id % 5 = 0")
    path = scratch_folder(spark, "record")
    op.refresh_record(was.unionByName(gone), path)
    op.refresh_record(now, path)
    return op.read_record(spark, path).select("raw_id", v.listed_micro(F.col("embedding")).alias("embedding"))


# Masking and packing


@query
def span_mask(spark: SparkSession, folder: str) -> DataFrame:
    masked = op.span_mask(v.knowledge(spark, folder))
    return masked.select(
        "id",
        F.array_join("masked", " ").alias("masked"),
        F.array_join("labels", " ").alias("labels"),
        F.size(F.filter("mask_flags", lambda f: f)).cast("bigint").alias("n_masked"),
    )


@query
def pack_blocks(spark: SparkSession, folder: str) -> DataFrame:
    packed = op.pack_blocks(_text_ids(spark, folder), BLOCK, "bk")
    return packed.select(
        "batch",
        "block",
        F.size("input_ids").cast("bigint").alias("n_items"),
        v.listed(F.col("input_ids")).alias("input_ids"),
    )


@query
def mlm_mask(spark: SparkSession, folder: str) -> DataFrame:
    lists = v.token_lists(spark, folder)
    vocab = op.build_vocab(lists)
    packed = op.pack_blocks(op.encode_ids(lists, vocab, specials=True).drop("toks"), BLOCK, "bk")
    masked = op.mlm_mask(packed, SEED, FIRST_WORD_ID + vocab.count())
    return masked.select(
        "batch",
        "block",
        v.listed(F.col("masked_ids")).alias("masked_ids"),
        v.listed(F.col("labels")).alias("labels"),
    )


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return v.token_lists(spark, folder).withColumnRenamed("toks", "input_ids")


@query
def length_batches(spark: SparkSession, folder: str) -> DataFrame:
    found = op.length_batches(_lengths(spark, folder), BUDGET)
    return found.select("id", "bk", F.col("n_items").cast("bigint").alias("n_items"), "batch_no")


@query
def length_batch_first(spark: SparkSession, folder: str) -> DataFrame:
    found = op.length_batch_first(_lengths(spark, folder), BUDGET)
    return found.select("id", "bk", F.col("n_items").cast("bigint").alias("n_items"))


@query
def pad_batch(spark: SparkSession, folder: str) -> DataFrame:
    ids = op.truncate_pad(_text_ids(spark, folder), None).withColumn("bk", whole_div(F.col("id"), 4))
    padded = op.pad_batch(ids, ["bk"], ["input_ids", "attention_mask"])
    return padded.select(
        "id",
        F.col("width").cast("bigint").alias("width"),
        v.listed(F.col("input_ids")).alias("input_ids"),
        v.listed(F.col("attention_mask")).alias("attention_mask"),
    )


# Scores, losses and metrics


@query
def predict(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.predict(v.logits(spark, folder))
    single = op.predict(rows, "regression", name="value")
    return single.select("id", F.col("pred").cast("bigint").alias("pred"), F.round("value", 6).alias("value"))


@query
def softmax(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.softmax(op.softmax(v.logits(spark, folder)), name="logs", log=True)
    return rows.select("id", v.listed_micro(F.col("probs")).alias("probs"), v.listed_micro(F.col("logs")).alias("logs"))


@query
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    found = op.accuracy(op.predict(v.logits(spark, folder)), ["split", "epoch"])
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = op.predict(v.logits(spark, folder))
    found = op.macro_f1(rows, v.CLASSES, group=["split"]).join(
        op.macro_f1(rows, v.CLASSES, "zero", ["split"]).withColumnRenamed("macro_f1", "with_absent"), "split"
    )
    return found.select("split", F.round("macro_f1", 6).alias("macro_f1"), F.round("with_absent", 6).alias("with_absent"))


@query
def glue_metric(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.table(spark, folder, "lineitem").select(
        (F.col("l_tax") > 0.04).cast("int").alias("label"),
        (F.col("l_tax") + F.col("l_discount") > 0.09).cast("int").alias("pred"),
        "l_quantity",
        "l_extendedprice",
    )
    found = None
    for task in ("cola", "mrpc", "sst2"):
        part = op.glue_metric(rows, task).withColumn("task", F.lit(task))
        found = part if found is None else found.unionByName(part)
    graded = op.glue_metric(rows, "stsb", "l_quantity", "l_extendedprice").withColumn("task", F.lit("stsb"))
    return found.unionByName(graded).withColumn("value", F.round("value", 6))


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return v.table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity")


@query
def pearson(spark: SparkSession, folder: str) -> DataFrame:
    found = op.pearson(_graded(spark, folder), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return found.withColumn("pearson", F.round("pearson", 6))


@query
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    found = op.spearman(_graded(spark, folder), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return found.withColumn("spearman", F.round("spearman", 6))


@query
def cloze_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    return op.cloze_exact_match(v.cloze(spark, folder))


@query
def cloze_match_score(spark: SparkSession, folder: str) -> DataFrame:
    return op.cloze_match_score(v.cloze(spark, folder))


@query
def cloze_loss(spark: SparkSession, folder: str) -> DataFrame:
    return op.cloze_loss(v.cloze(spark, folder)).withColumn("loss", F.round("loss", 9))


@query
def loss_from_logits(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.logits(spark, folder)
    marks = F.transform("logits", lambda x, i: (i == F.col("label")).cast("double"))
    ignored = F.when(F.col("id") % 10 == 0, -100).otherwise(F.col("label"))
    rows = rows.withColumn("marks", marks).withColumn("kept", ignored)
    rows = op.loss_from_logits(rows, "single", label="kept", name="cross_entropy")
    rows = op.loss_from_logits(rows, "multi", label="marks", name="binary")
    rows = op.loss_from_logits(rows, "regression", name="squared")
    return rows.select("id", *[F.round(c, 6).alias(c) for c in ("cross_entropy", "binary", "squared")])


@query
def layer_mse(spark: SparkSession, folder: str) -> DataFrame:
    return op.layer_mse(v.layer_pairs(spark, folder)).withColumn("mse", F.round("mse", 6))


@query
def example_reweight(spark: SparkSession, folder: str) -> DataFrame:
    return op.example_reweight(v.weights(spark, folder)).withColumn("loss", F.round("loss", 9))


@query
def dense_layer(spark: SparkSession, folder: str) -> DataFrame:
    weight, bias = v.hash_weights(64, v.OUT_DIMS)
    rows = v.vectors(spark, folder, "id")
    for name in ("tanh", "relu"):
        rows = op.dense_layer(rows, weight, bias, name, name=name)
    return rows.select("id", v.listed_micro(F.col("tanh")).alias("tanh"), v.listed_micro(F.col("relu")).alias("relu"))


@query
def dense_gelu(spark: SparkSession, folder: str) -> DataFrame:
    weight, bias = v.hash_weights(64, v.OUT_DIMS)
    rows = op.dense_layer(v.vectors(spark, folder, "id"), weight, bias, "gelu", name="gelu")
    return rows.select("id", v.listed_micro(F.col("gelu")).alias("gelu"))


@query
def gated_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = op.gated_mixture(v.experts(spark, folder), v.gate_logits(spark, folder))
    return mixed.select("id", v.listed_micro(F.col("mixed")).alias("mixed"))


@query
def gate_stats(spark: SparkSession, folder: str) -> DataFrame:
    found = op.gate_stats(v.gates(spark, folder))
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query
def epoch_mean(spark: SparkSession, folder: str) -> DataFrame:
    return op.epoch_mean(v.points(spark, folder)).withColumn("value", F.round("value", 6))


@query
def best_so_far(spark: SparkSession, folder: str) -> DataFrame:
    found = op.best_so_far(op.epoch_mean(v.points(spark, folder)))
    return found.select("run", "metric", "epoch", F.round("best", 6).alias("best"))


@query
def metric_at_best(spark: SparkSession, folder: str) -> DataFrame:
    found = op.metric_at_best(op.epoch_mean(v.points(spark, folder)), "view", "purchase")
    return found.withColumn("valid", F.round("valid", 6)).withColumn("test", F.round("test", 6))


@query
def stream_best(spark: SparkSession, folder: str) -> DataFrame:
    """The validation peak of every run, followed as its points come in."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    events = live.read_text_stream(spark, folder, schema, "events.parquet")
    points = events.select(
        F.col("user_id").alias("run"), F.dayofmonth("ts").cast("bigint").alias("epoch"), F.col("event_type").alias("metric"), "value"
    )
    found = live.stream_best(points, "view", "purchase")
    return found.select("run", "epoch", *[F.round(c, 6).alias(c) for c in ("valid", "test", "best")])


@query
def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """``retrieval_replay`` of domain rows and hits that come in as streams; a last row on both sides closes all windows."""
    at = lambda i: F.timestamp_seconds(1_700_000_000 + whole_div(i, v.BATCH_ROWS) * 3600)
    domain = v.document_vectors(spark, folder, "id").withColumn("bk", whole_div(F.col("id"), v.BATCH_ROWS))
    hits = op.retrieve_topk(domain, v.document_vectors(spark, folder, "raw_id"), 2)
    end = F.lit("2100-01-01 00:00:00").cast("timestamp")
    last = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("bk"), end.alias("ts"))
    root = scratch_folder(spark, "streams")
    domain.select("id", "bk", at(F.col("id")).alias("ts")).write.parquet(f"{root}/domain")
    last.write.mode("append").parquet(f"{root}/domain")
    hits.select("query_id", "rank", "raw_id", at(F.col("query_id")).alias("ts")).write.parquet(f"{root}/hits")
    late = last.select(F.lit(-2).cast("bigint").alias("query_id"), F.lit(1).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("raw_id"), "ts")
    late.write.mode("append").parquet(f"{root}/hits")
    corpus = v.corpus(spark, folder).select("raw_id", tokens(F.col("text")).alias("input_ids"))
    found = live.stream_replay(
        live.read_text_stream(spark, f"{root}/domain", "id bigint, bk bigint, ts timestamp", "*.parquet"),
        live.read_text_stream(spark, f"{root}/hits", "query_id bigint, rank bigint, raw_id bigint, ts timestamp", "*.parquet"),
        corpus,
        2,
        BUDGET,
    )
    return found.select("bk", "item", "raw_id", F.col("n_items").cast("bigint").alias("n_items"), "batch_no")


@query
def total_loss(spark: SparkSession, folder: str) -> DataFrame:
    examples = op.cloze_loss(v.cloze(spark, folder)).select("batch", F.col("loss").alias("knowledge_loss"))
    gaps = op.example_reweight(v.weights(spark, folder)).select("batch", F.col("loss").alias("sample_loss"))
    found = op.total_loss(examples.join(gaps, "batch"))
    return found.select("batch", F.round("total_loss", 9).alias("total_loss"))


# Streams


@query
def stream_metric_rollup(spark: SparkSession, folder: str) -> DataFrame:
    schema = "ts timestamp_ntz, event_type string, value double"
    stream = live.read_text_stream(spark, folder, schema, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value"
    )
    found = live.stream_metric_rollup(stream, "1 day")
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "metric",
        F.round("value", 6).alias("value"),
        "points",
    )


@query
def stream_prepare(spark: SparkSession, folder: str) -> DataFrame:
    documents = v.table(spark, folder, "documents")
    index = op.label_index_sorted(documents, "lang").select("lang", "rows", "label_id")
    stream = live.read_text_stream(spark, folder, "doc_id bigint, text string, lang string", "documents.parquet")
    found = live.stream_prepare(
        stream,
        [
            lambda df: op.tokenize_plain(df, "text", "input_ids"),
            lambda df: op.truncate_pad(df, None),
            lambda df: op.apply_label_index(df, index, "lang", "doc_id"),
            lambda df: df.withColumn("snippet", snippet(F.col("text"))),
        ],
    )
    return found.select(
        F.col("doc_id").alias("id"),
        "snippet",
        "label_id",
        F.array_join("input_ids", " ").alias("toks"),
        F.size("attention_mask").cast("bigint").alias("n_items"),
    )
