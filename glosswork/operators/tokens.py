"""Tokens with offsets, vocabularies, ids, truncation, padding and positions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions.arrays import flattened, let, pad_to, running_total
from glosswork.functions.draws import digest_below, draw_slice
from glosswork.functions.text import token_pieces
from glosswork.functions.text import tokens as token_list
from glosswork.operators.ids import dense_row_id
from glosswork.plans.spread import bounded, hot_lookup, written

# Ids of the special tokens, the mask mark, and the label that losses ignore.
BOS, PAD, EOS, UNK = 0, 1, 2, 3
BOS_TEXT, EOS_TEXT, MASK_TEXT = "<s>", "</s>", "<mask>"
IGNORED = -100

FIRST_WORD_ID = UNK + 1
LOCAL_VOCABULARY = 500_000
LOCAL_LETTERS = 32  # letters of a token that is looked up by the tasks themselves, when the vocabulary is larger
OTHER = -1
TOKEN_TYPE = "array<struct<b:int,e:int,tok:string>>"


def tokenize(
    df: DataFrame,
    text: str = "text",
    name: str = "tokens",
    tokenizer: Callable[[pd.Series], pd.Series] | None = None,
) -> DataFrame:
    """Add tokens with their character offsets: ``array<struct<b, e, tok>>``, 0-based, end exclusive.

    The text is cut into tokens and the blanks between them, so that the running
    total of the piece lengths gives every end. Another ``tokenizer`` maps a
    Series of texts to a Series of lists of such structs.
    """
    if tokenizer is not None:
        return df.withColumn(name, F.pandas_udf(tokenizer, TOKEN_TYPE)(F.col(text)))
    cut = df.withColumn("_pieces", token_pieces(F.col(text)))
    summed = cut.withColumn("_ends", running_total(F.transform("_pieces", F.length)))
    placed = F.zip_with(
        "_pieces",
        "_ends",
        lambda p, e: F.struct((e - F.length(p)).alias("b"), e.alias("e"), p.alias("tok")),
    )
    blank = lambda t: F.substring(t["tok"], 1, 1).isin(" ", "\t", "\r", "\n")
    return summed.withColumn(name, F.filter(placed, lambda t: ~blank(t))).drop("_pieces", "_ends")


def tokenize_plain(df: DataFrame, text: str = "text", name: str = "toks") -> DataFrame:
    """Add the tokens alone, where nobody needs offsets."""
    return df.withColumn(name, token_list(F.col(text)))


def build_vocab(df: DataFrame, max_size: int | None = None, tokens: str = "toks") -> DataFrame:
    """All tokens, the most frequent first and ties in token order: ``token, rows, token_id``.

    ``max_size`` keeps only so many, the four special ids counted. Counting
    combines on the map side, so a token that makes up a third of the corpus
    costs one row per task. The table is written: it is read many times, and the
    corpus is not tokenized again for each.
    """
    counts = flattened(df, [], tokens, "token").groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    counted = written(counts.select((-F.col("rows")).alias("_less"), "token"), "token-counts")
    ranked = dense_row_id(counted, ["_less", "token"], "_place").withColumn("rows", -F.col("_less"))
    if max_size is not None:
        ranked = ranked.where(F.col("_place") < max_size - FIRST_WORD_ID)
    return written(ranked.select("token", "rows", (F.col("_place") + FIRST_WORD_ID).cast("int").alias("token_id")), "vocabulary")


def encode_ids(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "id",
    tokens: str = "toks",
    name: str = "input_ids",
    specials: bool = False,
    max_local: int = LOCAL_VOCABULARY,
) -> DataFrame:
    """Add token ids; ``specials`` wraps them in the begin and end ids.

    A vocabulary proved to have at most ``max_local`` entries is sent to the
    tasks, which look up a whole Arrow batch of tokens at once. Of a larger one
    the most frequent entries are, and only the other tokens are joined.
    """
    local = bounded(vocab.select("token", "token_id"), max_local)
    if local is not None:
        encoded = df.withColumn(name, _lookup(local)(F.col(tokens)))
    else:
        encoded = _encode_by_join(df, vocab, key, tokens, name, max_local)
    if specials:
        ids = F.concat(F.array(F.lit(BOS)), F.col(name), F.array(F.lit(EOS)))
        encoded = encoded.withColumn(name, ids)
    return encoded


def _lookup(vocab: DataFrame, missing: int = UNK) -> Callable[[Column], Column]:
    table = vocab.toArrow()
    shared = vocab.sparkSession.sparkContext.broadcast(
        (table["token"].combine_chunks(), table["token_id"].combine_chunks())
    )

    @F.arrow_udf("array<int>")
    def lookup(lists: pa.Array) -> pa.Array:
        known, ids = shared.value
        places = pc.index_in(lists.flatten().cast(known.type), value_set=known)
        found = pc.fill_null(pc.take(ids, places), missing).cast(pa.int32())
        sizes = pc.fill_null(lists.value_lengths(), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, found)

    return lookup


def _frequent(vocab: DataFrame, most: int) -> Column:
    """Whether an entry is among the at most ``most`` most frequent ones, of tokens that are not very long."""
    fits = F.length("token") <= LOCAL_LETTERS
    # One row for each number of rows: no more than the root of twice the tokens of the corpus.
    sizes = vocab.where(fits).groupBy("rows").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    least = None
    for size in sorted(sizes, key=lambda r: -r["rows"]):
        most -= size["n"]
        if most < 0:
            break
        least = size["rows"]
    return F.lit(False) if least is None else fits & (F.col("rows") >= least)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _patched(lists: pa.Array, others: pa.Array) -> pa.Array:
    """Every ``OTHER`` of a list replaced by the next one of the other list's ids."""
    ids = lists.flatten().to_numpy(zero_copy_only=False).copy()
    ids[ids == OTHER] = others.flatten().to_numpy(zero_copy_only=False)
    ends = pc.cumulative_sum(lists.value_lengths()).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pa.array(ids, pa.int32()))


def _encode_by_join(df: DataFrame, vocab: DataFrame, key: str, tokens: str, name: str, max_local: int) -> DataFrame:
    """Ids of frequent tokens by lookup; the others are rows that meet the vocabulary and go back to their lists in order.

    A list is found again by its key and a hash of its tokens, so that equal keys don't mix.
    """
    frequent = _frequent(vocab, max_local)
    local = bounded(vocab.where(frequent).select("token", "token_id"), max_local)
    if local is None:  # too many bytes
        frequent, local = F.lit(False), bounded(vocab.limit(0).select("token", "token_id"))
    coded = df.withColumn(name, _lookup(local, OTHER)(F.col(tokens))).withColumn("_list", F.xxhash64(tokens))
    pairs = F.zip_with(tokens, name, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    others = F.transform(F.filter(pairs, lambda x: x["i"] == OTHER), lambda x: x["t"])
    flat = flattened(coded, [F.col(key).alias("_key"), "_list"], others, "token", "_at")
    found = hot_lookup(flat, vocab.where(~frequent).select("token", "rows", "token_id"), ["token"], ["_key", "_list", "_at"], how="left")
    # Rows that are the same twice give the same places twice.
    places = F.collect_set(F.struct("_at", F.coalesce("token_id", F.lit(UNK)).cast("int").alias("i")))
    lists = found.groupBy("_key", F.col("_list").alias("_hash")).agg(F.array_sort(places)["i"].alias("_ids"))
    joined = coded.join(lists, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_list") == F.col("_hash")), "left")
    filled = _patched(F.col(name), F.coalesce("_ids", F.array().cast("array<int>")))
    return joined.withColumn(name, filled).drop("_ids", "_key", "_list", "_hash")


def truncate_pad(
    df: DataFrame, max_length: int | None, pad_to_max: bool = False, ids: str = "input_ids", pad: int = PAD
) -> DataFrame:
    """Cut to ``max_length`` (None: no cut), pad up to it when asked, and add the attention mask."""
    if max_length is None:
        return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(ids)))
    cut = df.withColumn(ids, F.slice(ids, 1, max_length))
    kept = F.array_repeat(F.lit(1), F.size(ids))
    if not pad_to_max:
        return cut.withColumn("attention_mask", kept)
    width = F.lit(max_length)
    return cut.withColumn("attention_mask", pad_to(kept, width, F.lit(0))).withColumn(
        ids, pad_to(F.col(ids), width, F.lit(pad))
    )


def position_ids(df: DataFrame, scheme: str = "range", ids: str = "input_ids", pad: int = PAD) -> DataFrame:
    """Add ``position_ids``.

    ``range`` counts 0, 1, 2 ...; ``padding`` numbers the tokens that are not
    padding from ``pad + 1`` on and gives padding the number ``pad``.
    """
    if scheme == "range":
        numbers = F.when(
            F.size(ids) > 0, F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)))
        ).otherwise(F.array().cast("array<int>"))
        return df.withColumn("position_ids", numbers)
    if scheme != "padding":
        raise ValueError("scheme is 'range' or 'padding'")
    real = F.transform(ids, lambda t: (t != pad).cast("int"))
    seen = df.withColumn("_seen", running_total(real))
    numbers = F.zip_with(ids, "_seen", lambda t, n: F.when(t == pad, F.lit(pad)).otherwise(n + pad))
    return seen.withColumn("position_ids", numbers).drop("_seen")


def flatten_masked(
    df: DataFrame, key: str = "id", ids: str = "input_ids", mask: str = "attention_mask"
) -> DataFrame:
    """One row ``key, pos, token_id`` for every attended position."""
    marked = F.zip_with(ids, mask, lambda t, m: F.struct(t.alias("t"), m.alias("m")))
    placed = F.transform(marked, lambda x, i: F.struct(i.alias("pos"), x["t"].alias("token_id"), x["m"].alias("m")))
    attended = F.filter(placed, lambda x: x["m"] == 1)
    return flattened(df, [key], attended, "x").select(key, "x.pos", "x.token_id")


def encode_pair(
    df: DataFrame, first: str, second: str, max_length: int, name: str = "input_ids"
) -> DataFrame:
    """Two id lists as ``<s> a </s></s> b </s>``, the longer side cut first.

    When both sides must be cut, the room is halved and an odd place goes to the
    side that was longer, or to the second when they were equal.
    """
    room = max_length - 4
    a, b = F.size(first), F.size(second)
    low, high = F.least(a, b), F.greatest(a, b)
    wide = F.greatest(low, room - low)
    both = low + wide > room
    long_side = F.when(a + b <= room, high).when(both, F.lit(room // 2 + room % 2)).otherwise(wide)
    short_side = F.when(a + b <= room, low).when(both, F.lit(room // 2)).otherwise(low)
    first_longer = a > b
    bos, eos = F.array(F.lit(BOS)), F.array(F.lit(EOS))
    return df.withColumn(
        name,
        F.concat(
            bos,
            F.slice(F.col(first), F.lit(1), F.when(first_longer, long_side).otherwise(short_side)),
            eos,
            eos,
            F.slice(F.col(second), F.lit(1), F.when(first_longer, short_side).otherwise(long_side)),
            eos,
        ),
    )


def mlm_mask(
    df: DataFrame,
    seed: int,
    vocab_size: int,
    keys: tuple[str, ...] = ("batch", "block"),
    ids: str = "input_ids",
    probability: float = 0.15,
    mask_id: int | None = None,
) -> DataFrame:
    """Choose positions to predict: adds ``masked_ids`` and ``labels`` (-100 where nothing is predicted).

    Special tokens are never chosen. Of the chosen positions 80 % become the
    mask, 10 % a random id below ``vocab_size`` and 10 % stay. One hash for every
    four positions chooses, and each chosen one has a hash for its fate, so a
    retried task chooses the same ones.
    """
    shown_mask = F.lit(vocab_size if mask_id is None else mask_id).cast("int")
    prefix = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(""))

    def fate(token: Column, digest: Column) -> Column:
        shown = (
            F.when(digest_below(digest, 0.8), shown_mask)
            .when(digest_below(digest, 0.9), (draw_slice(digest, 1) % vocab_size).cast("int"))
            .otherwise(token)
        )
        return F.struct(shown.alias("shown"), token.alias("label"))

    def decide(token: Column, place: Column, start: Column, digests: Column) -> Column:
        digits = F.substring(F.get(digests, F.shiftright(place, 2)), (place % 4) * 8 + 1, F.lit(8))
        chosen = digest_below(digits, probability) & ~token.isin(BOS, PAD, EOS)
        own = F.md5(F.concat(start, place.cast("string"), F.lit(":m")))
        kept = F.struct(token.alias("shown"), F.lit(IGNORED).alias("label"))
        return F.when(chosen, let(own, lambda d: fate(token, d))).otherwise(kept)

    fours = F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(ids) - 1, F.lit(0)), 2))
    decided = let(
        prefix,
        lambda p: let(
            F.transform(fours, lambda g: F.md5(F.concat(p, g.cast("string")))),
            lambda digests: F.transform(ids, lambda t, i: decide(t, i, p, digests)),
        ),
    )
    return df.withColumn("_d", decided).select(
        *df.columns, F.col("_d.shown").alias("masked_ids"), F.col("_d.label").alias("labels")
    )
