"""Prompts, tokens and pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glosswork import operators as op
from glosswork.functions import fill_slots, letter_index, snippet, strip

PIECE = re.compile("[A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9 \\t\\r\\n]")


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def prompts(spark, data):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(data)], "id int, prompt string, targets array<string>")


@pytest.mark.parametrize(
    "prompt, targets",
    [
        ("a {} b {}.", ["x", "y"]),
        ("{}{}", ["x", "y", "spare"]),
        ("no slots", []),
        ("{{}} {} }}{{", ["x"]),
        ("{}}} {{{}", ["x", "y"]),
        ("{{{}}}", ["{}"]),
        ("", []),
        ("é😀 {} ñ", ["😀"]),
    ],
)
def test_fill_like_format(spark, prompt, targets):
    assert prompts(spark, [(prompt, targets)]).select(fill_slots(F.col("prompt"), F.col("targets"))).first()[0] == prompt.format(*targets)


@pytest.mark.parametrize("prompt, targets", [("{} {}", ["x"]), ("{0}", ["x"]), ("{name}", ["x"]), ("{", []), ("}", [])])
def test_fill_rejects(spark, prompt, targets):
    with pytest.raises(Exception, match="prompt has"):
        op.prompt_fill(prompts(spark, [(prompt, targets)])).collect()


def test_fill_or_raw(spark):
    df = prompts(spark, [("  {} {x} ", []), (" {} ", ["y"])])
    got = op.prompt_fill(df, trim=False, raw_if_empty=True).orderBy("id").collect()
    assert [r.text for r in got] == ["  {} {x} ", " y "]


@pytest.mark.parametrize("text", [" \t a b\n ", "\x1c　x\xa0", "", "   "])
def test_strip_like_python(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).first()[0] == text.strip()


@pytest.mark.parametrize("text", ["a. b. c. d.", "a", "", "a.", "...", "a.b", "one. two. three"])
def test_snippet(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(snippet(F.col("t"))).first()[0] == " ".join(text.split(".")[:3])


def test_letters(spark):
    df = spark.createDataFrame([(c,) for c in "ABCDE"], "c string")
    assert [r[0] for r in df.select(letter_index(F.col("c"))).collect()] == [0, 1, 2, 3, 4]


def random_texts(n=40, seed=0):
    rng = random.Random(seed)
    alphabet = ["ab", "é", "😀", " ", "  ", "\n", ".", ",", "Zz9", "\t", "—", "x"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "   ", "a" * 5000]


def test_offsets_loop(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    for r in op.tokenize(df).collect():
        want = [(m.start(), m.end(), m.group()) for m in PIECE.finditer(texts[r.id])]
        assert [tuple(t) for t in r.tokens] == want


def test_offsets_of_null(spark):
    df = spark.createDataFrame([(0, None), (1, "a b")], "id int, text string")
    got = {r.id: r.tokens for r in op.tokenize(df).collect()}
    assert not got[0] and len(got[1]) == 2


def test_other_tokenizer(spark):
    def letters(texts):
        return texts.map(lambda t: [{"b": i, "e": i + 1, "tok": c} for i, c in enumerate(t)])

    df = spark.createDataFrame([(0, "ab")], "id int, text string")
    assert [tuple(t) for t in op.tokenize(df, tokenizer=letters).first().tokens] == [(0, 1, "a"), (1, 2, "b")]


def span_loop(text, targets, missing):
    tokens = [(m.start(), m.end(), m.group()) for m in PIECE.finditer(text)]
    shown = [t[2] for t in tokens]
    for target in targets:
        begin = text.find(target)
        if begin < 0 and missing == "skip":
            continue
        end = begin + len(target)
        for i, (b, e, _) in enumerate(tokens):
            if b == e or e < begin:
                continue
            if b > end:
                break
            shown[i] = "<mask>"
    return shown


@pytest.mark.parametrize("missing", ["skip", "python"])
def test_span_mask_loop(spark, missing):
    data = [
        ("the {} sat on the {}, cat.", ["cat", "mat"]),
        ("concat {} cat", ["cat"]),
        ("😀😀 {} é", ["😀x"]),
        ("no slots here", ["absent"]),
        ("no slots here", ["slots", "slots", "ab sent"]),
        ("{}", [""]),
        ("a,{}.b", ["t"]),
    ]
    df = prompts(spark, data)
    for r in op.span_mask(df, missing).collect():
        prompt, targets = data[r.id]
        text = prompt.format(*targets).strip()
        assert r.masked == span_loop(text, targets, missing)
        assert [m if m != "<mask>" else t for m, t in zip(r.masked, r.labels)] == r.labels
        assert [f for f in r.mask_flags] == [m == "<mask>" for m in r.masked]


def test_vocabulary_and_ids_both_ways(spark):
    df = spark.createDataFrame([(0, "b a a c a".split()), (1, ["z"]), (2, []), (3, "a b".split())], "id int, toks array<string>")
    vocab = op.build_vocab(df, 6)
    assert [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", 4), ("b", 5)]
    want = {0: [0, 5, 4, 4, 3, 4, 2], 1: [0, 3, 2], 2: [0, 2], 3: [0, 4, 5, 2]}
    for limit in (500_000, 1):
        got = op.encode_ids(df, vocab, specials=True, max_local=limit)
        assert {r.id: r.input_ids for r in got.collect()} == want


def test_truncate_pad_and_positions(spark):
    df = spark.createDataFrame([(0, [0, 7, 8, 2]), (1, [0, 2]), (2, [])], "id int, input_ids array<int>")
    padded = op.truncate_pad(df, 3, True)
    got = {r.id: (r.input_ids, r.attention_mask) for r in padded.collect()}
    assert got == {0: ([0, 7, 8], [1, 1, 1]), 1: ([0, 2, 1], [1, 1, 0]), 2: ([1, 1, 1], [0, 0, 0])}
    after = {r.id: r.position_ids for r in op.position_ids(padded, "padding").collect()}
    assert after == {0: [2, 3, 4], 1: [2, 3, 1], 2: [1, 1, 1]}
    plain = {r.id: r.position_ids for r in op.position_ids(df).collect()}
    assert plain == {0: [0, 1, 2, 3], 1: [0, 1], 2: []}
    flat = op.flatten_masked(padded).collect()
    assert sorted(map(tuple, flat)) == [(0, 0, 0), (0, 1, 7), (0, 2, 8), (1, 0, 0), (1, 1, 2)]


def test_pairs_like_the_public_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    known = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, **{f"w{i}": i + 4 for i in range(40)}}
    tool = Tokenizer(models.WordLevel(known, "<unk>"))
    tool.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tool.post_processor = processors.RobertaProcessing(("</s>", 2), ("<s>", 0), add_prefix_space=False)
    sizes = [(a, b) for a in range(0, 12) for b in range(0, 12)]
    for length in (8, 11, 14):
        tool.enable_truncation(length, strategy="longest_first")
        data = [(i, list(range(4, 4 + a)), list(range(20, 20 + b))) for i, (a, b) in enumerate(sizes)]
        df = spark.createDataFrame(data, "id int, a array<int>, b array<int>")
        got = {r.id: r.input_ids for r in op.encode_pair(df, "a", "b", length).collect()}
        for i, a, b in data:
            words = [" ".join(f"w{t - 4}" for t in side) for side in (a, b)]
            assert got[i] == tool.encode(*words).ids, (length, len(a), len(b))


def test_mlm_mask_properties(spark):
    ids = [0] + [10 + i % 50 for i in range(998)] + [2]
    df = spark.createDataFrame([(b, 0, ids) for b in range(20)], "batch int, block int, input_ids array<int>")
    got = op.mlm_mask(df, 1, 100).collect()
    again = {r.batch: r.masked_ids for r in op.mlm_mask(df.repartition(7), 1, 100).collect()}
    chosen = masked = kept = 0
    for r in got:
        assert again[r.batch] == r.masked_ids
        assert r.labels[0] == -100 and r.labels[-1] == -100
        for t, m, y in zip(ids, r.masked_ids, r.labels):
            assert y in (-100, t) and (y != -100 or m == t)
            chosen += y != -100
            masked += y != -100 and m == 100
            kept += y != -100 and m == t
    assert abs(chosen / 20_000 - 0.15) < 0.01
    assert abs(masked / chosen - 0.8) < 0.03 and abs(kept / chosen - 0.1) < 0.03


def test_columns_of_tasks(spark):
    pair = spark.createDataFrame([("l", "a", "b")], "label string, sentence1 string, sentence2 string")
    assert op.resolve_text_columns(pair, "sst2") == ("sentence", None)
    assert op.resolve_text_columns(pair) == ("sentence1", "sentence2")
    assert op.resolve_text_columns(pair.select("label", "sentence2")) == ("sentence2", None)
    assert op.resolve_text_columns(pair.selectExpr("label", "sentence1 z", "sentence2 y", "1 w")) == ("z", "y")
    assert op.project_pairs(pair, "mrpc").first().asDict() == {"text1": "a", "text2": "b", "labels": "l"}
    assert op.project_pairs(pair.drop("label", "sentence2")).columns == ["text1"]


def test_choices(spark):
    df = spark.createDataFrame([(0, "q", (["a", "b"],), "B")], "id int, question string, choices struct<text array<string>>, answerKey string")
    assert [(r.choice, r.choice_text) for r in op.choice_expand(df, 2).collect()] == [(0, "a"), (1, "b")]
    with pytest.raises(Exception, match="wrong number of choices"):
        op.choice_expand(df, 5).collect()
    scores = spark.createDataFrame([(0, 1, 2.0), (0, 0, 2.0), (1, 0, 1.0), (1, 1, 3.0)], "id int, choice int, score double")
    got = {r.id: (r.scores, r.winner) for r in op.choice_regroup(scores, 2).collect()}
    assert got == {0: ([2.0, 2.0], 0), 1: ([1.0, 3.0], 1)}


def test_manifest(spark):
    names = ["cola_houlsby-domain_16_2e-5_seed7", "my-data_finetune_8_1e-4_seed1", "csqa_a-b-domain_4_0.001_seed2"]
    got = op.parse_manifest(spark.createDataFrame([(n,) for n in names], "run_name string"), "-domain").collect()
    assert [(r.dataset, r.adapter_type, r.domain_adapter, r.runner, r.batch_size, r.lr, r.seed) for r in got] == [
        ("cola", "houlsby", True, "glue", 16, 2e-5, 7),
        ("my-data", None, False, "others", 8, 1e-4, 1),
        ("csqa", "a-b", True, "csqa", 4, 0.001, 2),
    ]
