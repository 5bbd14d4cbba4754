"""Token ids of many texts by a public tokenizer, each distinct piece of text being encoded once.

A byte-pair tokenizer never lets a token reach over the places where its own rule cuts a text. Cutting a text at
some of those places therefore changes no id, and prose repeats most pieces. What is cut:

``word``: tokenizers that drop white space and letter case. Every blank and line break is such a place.
``byte``: tokenizers whose tokens may begin with one blank. A place between a character that is no white space and
a blank is such a place, and both sides of a lone line break are. A text with other white space is cut into runs
of white space with the word that follows; one with control characters that engines class differently is not cut.

Both cut between a common letter and a sign of ASCII, such as a full stop or comma. A piece of plain letters needs no cutting rule any more and
goes straight to the tokenizer's model; all others go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import give_back, slices

RUN_BYTES = 4 << 20  # text encoded at a time: a longer run meets fewer pieces twice, but takes more memory
KEPT_PIECES = 500_000  # pieces a worker remembers, in some 15 MB; the rest are encoded again
WIDE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"  # white space by any rule, for Arrow's expressions
ODD = rf"^{WIDE}|{WIDE}{WIDE}|{WIDE}$|[\x09\x0b-\x0d\x1c-\x1f\x{{85}}]|[^\P{{Z}} ]"
# Letters that no normal form or change of case turns into more than a letter, before a sign of ASCII.
STOP = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-/:-@\[-`{-~])"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next free code point."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _strings(pieces: pa.Array) -> list[str]:
    """The array as Python strings, by way of one long string, which is faster than one by one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    found = pc.binary_join(whole, pa.scalar("\x00", pieces.type))[0].as_py().split("\x00")
    return found if len(found) == len(pieces) else pieces.to_pylist()


class PieceEncoder:
    """Encodes Arrow arrays of texts; remembers the ids of the pieces that this worker has met."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        if kind not in ("word", "byte"):
            raise ValueError("kind is 'word' or 'byte'")
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = kind
        self.letters = byte_letters()
        # Functions travel with the job and are new in each task; the module stays, so a worker's tasks share its pieces.
        self.memory = tokenizers.__dict__.setdefault("_pieces_met", {}).setdefault((path, kind), [])
        if not self.memory:
            self.memory[:] = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of all texts, and how many each text has."""
        if self.kind == "word":
            cut = pc.replace_substring_regex(texts, STOP, r"\1 \2")
            lists = pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")
            return lists.flatten(), lists.value_lengths().to_numpy()
        odd = pc.match_substring_regex(texts, ODD)
        cut = pc.replace_substring(texts, " ", "\x00 ")
        cut = pc.replace_substring(cut, "\n", "\x00\n\x00")
        cut = pc.replace_substring_regex(cut, STOP, "\\1\x00\\2")
        if pc.any(odd).as_py():
            cut = pc.replace_with_mask(cut, odd, pa.array(map(self._cut, pc.filter(texts, odd).to_pylist()), cut.type))
        lists = pc.split_pattern(cut, "\x00")
        return lists.flatten(), lists.value_lengths().to_numpy()

    @staticmethod
    def _cut(text: str) -> str:
        if re.search(r"[\x1c-\x1f]", text):
            return text
        return "\x00".join(re.findall(r"\s*\S+|\s+$", text))

    def _plain(self, piece: str) -> str | None:
        """The piece in the letters of the vocabulary when it is one run of common letters, else None."""
        blank = self.kind == "byte" and piece[:1] == " "
        word = piece[1:] if blank else piece
        if not word.isalpha():
            return None
        if self.kind == "word":
            word = word.lower()
        if not word.isascii():
            if max(word) >= "\u0250":  # a change of case or normal form may do more to these
                return None
            word = "".join(map(self.letters.get, word.encode()))
        return self.letters[32] + word if blank else word

    def _new_ids(self, pieces: list[str]) -> pa.Array:
        """The ids of pieces that this worker doesn't remember, as one binary value for each."""
        model, found, whole = self.tokenizer.model, [b""] * len(pieces), []
        for i, piece in enumerate(pieces):
            if plain := self._plain(piece):
                found[i] = array("I", [t.id for t in model.tokenize(plain)]).tobytes()
            else:
                whole.append(i)
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False)):
                found[i] = array("I", e.ids).tobytes()
        return pa.array(found, pa.large_binary())

    def _ids(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as one binary value for each; the pieces met last are remembered."""
        known, ids, met = self.memory
        places = pc.index_in(pieces, value_set=known)
        missing = pc.is_null(places)
        new = pieces.filter(missing)
        known, ids = pa.concat_arrays([known, new]), pa.concat_arrays([ids, self._new_ids(_strings(new))])
        places = places.fill_null(0).to_numpy().copy()
        places[missing.to_numpy(zero_copy_only=False)] = np.arange(len(met), len(known))
        found = ids.take(pa.array(places))
        # How many runs ago each piece was met last.
        met = np.concatenate([met + 1, np.zeros(len(new), np.int64)])
        met[places] = 0
        if len(known) > KEPT_PIECES:
            kept = np.sort(np.argsort(met, kind="stable")[:KEPT_PIECES])
            known, ids, met = known.take(pa.array(kept)), ids.take(pa.array(kept)), met[kept]
        self.memory[:] = known, ids, met
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has. No text counts as an empty one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.match_substring(texts, "\x00") if self.kind == "byte" else pa.array([False])
        if pc.any(marked).as_py():  # pieces are parted by this character, so such texts are encoded whole
            ids, sizes = self.encode(pc.if_else(marked, "", texts))
            rows = np.split(ids, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
                rows[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        pieces, counts = self._pieces(texts)
        if len(pieces) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pieces.dictionary_encode()
        del texts, pieces
        found = self._ids(coded.dictionary).take(coded.indices)
        _, places, data = found.buffers()
        places = np.frombuffer(places, np.int64)[: len(found) + 1] // 4
        ends = np.cumsum(counts)
        ids = np.frombuffer(data, np.uint32)[: places[-1]] if data else np.zeros(0, np.uint32)
        return ids, places[ends] - places[ends - counts]


def encoded(
    df: DataFrame, path: str, kind: str, end_id: int, text: str = "text", name: str = "ids", width: int = 2
) -> DataFrame:
    """Replace the text column by its ids and the end id: little-endian numbers of ``width`` bytes in one binary value.

    A null text is an empty one and has the end id alone. Other columns pass through, but for one called ``name``. An
    id that needs more than ``width`` bytes is an error.
    """
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name not in (text, name)]
    schema = T.StructType([*kept, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path, kind)
        kind_of_id = np.dtype(f"<u{width}")
        if encoder.tokenizer.get_vocab_size() > 1 << 8 * width:
            raise ValueError(f"ids need more than {width} bytes")
        tail = np.array([end_id], kind_of_id).tobytes()
        for batch in batches:
            texts = batch.column(text)
            for start, stop in slices(texts, RUN_BYTES):
                ids, sizes = encoder.encode(texts.slice(start, stop - start))
                raw = ids.astype(kind_of_id).tobytes()
                ends = np.cumsum(sizes)
                values = [raw[width * (e - n) : width * e] + tail for e, n in zip(ends.tolist(), sizes.tolist())]
                part = batch.slice(start, stop - start)
                del ids, raw
                give_back()
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in kept], pa.array(values, pa.binary())], [*[f.name for f in kept], name]
                )
        batch = texts = part = values = None  # the worker idles after this, beside the joins
        give_back()

    return df.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(run, schema)
