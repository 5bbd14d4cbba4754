import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from glosswork.llm import encoding

# A worker's process, without Spark: `encoded` hands its task function to a frame that gives it back.
WORKER = """
import random, re
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import types as T

from glosswork.llm import encoding


def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


class Frame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


encoding.F.col = str
draw = random.Random(7)
words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range({words})]
texts = [" ".join(draw.choices(words, k=300)) for _ in range(6000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
run = encoding.encoded(Frame(), public_tokenizers.path("{file}"), "{kind}", 2)
for _ in run(iter([batch.slice(0, 100)])):
    pass
start, most, rows = held(), 0, 0
for _ in range(3):
    for part in run(iter([batch])):
        most, rows = max(most, held() - start), rows + part.num_rows
assert rows == 3 * len(texts)
print(most)
"""


def kept_mb(file, kind, words=20000):
    code = WORKER.replace("{file}", file).replace("{kind}", kind).replace("{words}", str(words))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return float(done.stdout)


def test_a_worker_gives_back_what_it_has_freed():
    """Two workers of an executor outlive the stage that encodes; the joins after it need the memory (op2_packing)."""
    assert kept_mb("word_bpe_49k.json", "word") < 75
    assert kept_mb("byte_bpe_50k.json", "byte") < 75


def test_a_worker_remembers_rare_pieces_in_little_memory():
    """Hundreds of thousands of different words were strings and bytes of their own, in both workers (pipeline)."""
    assert kept_mb("word_bpe_49k.json", "word", 400_000) < 90


KINDS = [("word", "word_bpe_49k.json"), ("byte", "byte_bpe_50k.json")]


class Counted:
    """A tokenizer that counts the pieces it is asked for."""

    def __init__(self, real):
        self.real, self.asked, self.whole = real, 0, 0
        self.model = SimpleNamespace(tokenize=self.tokenize)

    def tokenize(self, piece):
        self.asked += 1
        return self.real.model.tokenize(piece)

    def encode_batch_fast(self, pieces, **how):
        self.asked, self.whole = self.asked + len(pieces), self.whole + len(pieces)
        return self.real.encode_batch_fast(pieces, **how)


@pytest.mark.parametrize("kind,file", KINDS)
def test_pieces_met_before_are_not_encoded_again(kind, file):
    """Of 360,000 pieces in two runs the first run's are still known (op6_wavelet_ids)."""
    draw = random.Random(3)
    words = sorted({"q" + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(360_000)})
    runs = [pa.array([" ".join(words[at : at + 60_000])]) for at in range(0, len(words), 60_000)]
    encoder = encoding.PieceEncoder(public_tokenizers.path(file), kind)
    first = [encoder.encode(r)[0] for r in runs]
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    again = [encoder.encode(r)[0] for r in runs]
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
    assert counted.asked < 10


@pytest.mark.parametrize("kind,file", KINDS)
def test_a_word_before_signs_is_a_piece(kind, file):
    words = [a + b + c for a in "bcdfg" for b in "aeiou" for c in "klmnp"]
    encoder = encoding.PieceEncoder(public_tokenizers.path(file), kind)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    encoder.encode(pa.array([f"x {w}{sign} y" for w in words for sign in ("***", "$$$", "!", ")", '"', ";", "&&")]))
    assert counted.whole < 20


@pytest.mark.parametrize("kind,file", KINDS)
@pytest.mark.parametrize("kept", [500_000, 40])
def test_signs_and_marks_give_the_ids_of_the_whole_text(kind, file, kept, monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_PIECES", kept)
    draw = random.Random(5)
    signs = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    some = [*"abSTdv", "é", "Ø", "İ", "Σ", "ß", "\u0338", "\u0301", "e\u0301", "7", "½", "'s", "'LL", "<|endoftext|>", "\u200d", "漢", " ", " ", " ", "\n", "\t", "\x00", ""]
    texts = ["".join(draw.choice(signs if draw.random() < 0.4 else some) for _ in range(draw.randint(0, 30))) for _ in range(6000)]
    encoder = encoding.PieceEncoder(public_tokenizers.path(file), kind)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        ids, sizes = encoder.encode(pa.array(part))
        wanted = [e.ids for e in encoder.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in wanted]
        assert ids.tolist() == [i for w in wanted for i in w]
    assert encoder.encode(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def test_texts_beside_one_with_a_zero_character_are_encoded_at_once(monkeypatch):
    """Each such neighbour looked up its pieces by itself (op6_wavelet_ids)."""
    encoder, asked = encoding.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte"), []
    pieces = encoder._pieces
    monkeypatch.setattr(encoder, "_pieces", lambda texts: asked.append(len(texts)) or pieces(texts))
    texts = ["some words", "a\x00b c", "", "more words", "\x00"] * 20
    ids, sizes = encoder.encode(pa.array(texts))
    wanted = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [i for w in wanted for i in w] and sizes.tolist() == [len(w) for w in wanted]
    assert len(asked) == 1
