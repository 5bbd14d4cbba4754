"""Multilingual mixtures: expectation-maximisation over character trigrams, the language set by penalised likelihood.

Every labelled document adds the hashed trigrams of its text to its language's counts: ``BUCKETS`` sums for each
language, which combine in the tasks before the shuffle. The model is those sums as smoothed probabilities. Its size is
that of the set of languages, of which there may be ``MAX_LANGUAGES``, not of the corpus.

A document is a mixture of languages. Expectation-maximisation finds the proportions under which its trigrams are
likeliest. Languages are then taken in one by one, the one with the largest proportion first, as long as the likelihood
rises by more than a language costs: ``PENALTY`` times half the logarithm of the number of independent trigrams, of which
there is one in three. The prediction is the largest proportion and its language.

Defined results: no text, or one without a letter, is ``und`` with score 0 and no proportions; so is every text when
nothing was labelled. Rows without a language or text teach nothing. Ties go to the language whose name comes first.
Repeated rows count as often as they come. Columns beside the named ones pass through ``predict``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.common import slices
from glosswork.llm.shingles import mixed, raw_texts

BUCKETS = 1 << 14
MAX_LANGUAGES = 512
SMOOTHING = 0.5
PENALTY = 2.0
ROUNDS = 30
UNKNOWN = "und"
BLOCK_BYTES = 1 << 20

# Letters keep their byte, capitals being read as small ones; every other byte of one is a blank.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's trigrams and how often each comes; three blanks are none."""
    total = np.zeros(BUCKETS, np.int64)
    if len(raw) > 1 << 16:  # long texts in blocks that overlap by two bytes
        for at in range(0, len(raw) - 2, BLOCK_BYTES):
            total += np.bincount(_grams(raw[at : at + BLOCK_BYTES + 2]), minlength=BUCKETS)
        found = np.flatnonzero(total)
        return found, total[found]
    return np.unique(_grams(raw), return_counts=True)


def _grams(raw: np.ndarray) -> np.ndarray:
    b = _LETTERS[raw].astype(np.uint64)
    code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    code = code[(b[:-2] != 32) | (b[1:-1] != 32)]
    return (mixed(code) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """Languages by name and, for each, the probabilities of the buckets."""

    languages: list[str]
    probabilities: np.ndarray


def learn(documents: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Sum trigrams by language over all given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                found, times = trigrams(raw)
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))[found] += times
        for name, counts in sums.items():
            found = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(counts[found])], ["lang", "bucket", "n"]
            )

    labelled = documents.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = labelled.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    most = MAX_LANGUAGES * BUCKETS
    found = sums.limit(most + 1).toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    if found.num_rows > most or len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((len(names), BUCKETS), SMOOTHING)
    place = {name: i for i, name in enumerate(names)}
    counts[[place[x] for x in found["lang"].to_pylist()], found["bucket"].to_numpy()] += found["n"].to_numpy()
    return Model(names, counts / counts.sum(axis=1, keepdims=True))


def _fit(likely: np.ndarray, times: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that make the trigrams likeliest, and the likelihood's logarithm."""
    share, total = start, times.sum()
    for _ in range(ROUNDS):
        joint = share @ likely
        new = share * (likely @ (times / joint)) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(times @ np.log(share @ likely))


def mixture(model: Model, found: np.ndarray, times: np.ndarray) -> dict[int, float]:
    """The chosen languages of one document and their proportions."""
    times = times.astype(np.float64)
    likely = model.probabilities[:, found]
    share, _ = _fit(likely, times, np.full(len(model.languages), 1 / len(model.languages)))
    order = np.argsort(-share, kind="stable")
    alone = np.log(likely) @ times
    chosen = [int(np.argmax(alone))]
    weights, best = np.ones(1), float(alone[chosen[0]])
    cost = PENALTY * 0.5 * np.log(max(times.sum() / 3, 2.0))
    for one in order:
        if int(one) in chosen:
            continue
        wider = [*chosen, int(one)]
        start = np.append(weights * 0.9, 0.1)
        tried, value = _fit(likely[wider], times, start)
        if (value - best) / 3 <= cost:
            break
        chosen, weights, best = wider, tried, value
    return dict(zip(chosen, weights.tolist()))


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``mixture`` (languages and proportions, the largest first)."""
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "mixture": T.MapType(T.StringType(), T.DoubleType())}
    kept = [f for f in documents.schema.fields if f.name.lower() not in added]
    schema = T.StructType([*kept, *[T.StructField(n, k) for n, k in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(text)):
                part = batch.slice(start, stop - start)
                texts = part.column(text)
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
                best, scores, mixtures = [], [], []
                for raw, usable in zip(raw_texts(texts), lettered):
                    found, times = trigrams(raw) if usable and model.languages else (np.zeros(0, int), np.zeros(0, int))
                    if not usable or not model.languages:
                        shares = {}
                    elif len(found) == 0:  # a letter or two
                        shares = {0: 1 / len(model.languages)}
                    else:
                        shares = mixture(model, found, times)
                    ranked = sorted(shares.items(), key=lambda s: (-s[1], s[0]))
                    best.append(model.languages[ranked[0][0]] if ranked else UNKNOWN)
                    scores.append(min(1.0, ranked[0][1]) if ranked else 0.0)
                    mixtures.append([(model.languages[i], w) for i, w in ranked])
                columns = [part.column(f.name) for f in kept]
                columns += [pa.array(best), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in kept], *added])

    return documents.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
