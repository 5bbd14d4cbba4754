"""Periodic runs in the words of a text: multi-scale minimizers give seeds, direct lag scans take the short periods.

A run is a stretch of words with smallest period ``q`` and at least ``max(LEAST, 2 q)`` words that no neighbour extends.

Periods under ``DIRECT`` are scanned lag by lag. A stretch of ``d`` places that agree with the places ``q`` further on
holds a multiple of ``d``, so only every ``d``-th place is compared and the hits are grown.

Longer periods are sought scale by scale, ``Q <= q < 2 Q``. The hashes of ``g = Q / 4`` words come from those of half as
many; a gram is chosen when it is the smallest of some window of ``g`` grams. Inside a run equal windows lie ``q`` apart
and choose equal grams, so chosen grams that are equal and ``q`` apart are seeds. Grams that have themselves a period of
at most ``g / 2`` are never chosen: they lie in runs of earlier scales, and without them equal grams are more than
``g / 2`` apart, so a gram has at most 16 equal ones in reach of ``2 Q`` words and no pairs pile up. If every gram of a
run's first period is such a one, the run's two halves lie in two runs of one short period that touch; their common
phase gives the lags that are possible, and those become seeds as well. Seeds are extended on the words themselves.

Words are numbered by where the batch has them first in their text, not hashed. Texts share no number, so a task lays the texts of a
batch end to end, longest first, and every pass is over one array.

Defined results: no text, or one without words, has no runs and collapses to the empty string. Repeated rows give
repeated results. Every other column passes through; one named like a result is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.llm.common import free_name, put, slices
from glosswork.llm.shingles import mixed

LEAST = 12  # words of the shortest run
DIRECT = 64  # periods below are scanned lag by lag
REACH = 16  # equal grams within two scales: their distance is more than an eighth of the scale
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEFT = np.uint64(0x9E3779B97F4A7C15)


def _same_ahead(x: np.ndarray, i: int, j: int) -> int:
    """For how many places from ``i`` and from ``j > i`` on the words agree."""
    done, step = 0, 64
    while j + done < len(x):
        b = x[j + done : j + done + step]
        differ = np.flatnonzero(x[i + done : i + done + len(b)] != b)
        if len(differ):
            return done + int(differ[0])
        done, step = done + len(b), min(2 * step, 1 << 16)
    return done


def _same_behind(x: np.ndarray, i: int, j: int) -> int:
    """For how many places before ``i`` and before ``j > i`` the words agree."""
    done, step = 0, 64
    while done < i:
        n = min(step, i - done)
        differ = np.flatnonzero(x[i - done - n : i - done] != x[j - done - n : j - done])
        if len(differ):
            return done + n - 1 - int(differ[-1])
        done, step = done + n, min(2 * step, 1 << 16)
    return done


def _has_divisor_period(x: np.ndarray, start: int, q: int) -> bool:
    """Whether a proper divisor of ``q`` is a period of a stretch of period ``q``."""
    left, f = q, 2
    while left > 1:
        if f * f > left:
            f = left
        if left % f == 0:
            d = q // f
            if np.array_equal(x[start : start + q], x[start + d : start + q + d]):
                return True
            while left % f == 0:
                left //= f
        f += 1
    return False


def _extended(x: np.ndarray, seeds: np.ndarray, lags: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs ``start, stop, period`` through places that agree with the place their lag further on."""
    runs, lag, covered = [], 0, 0
    order = np.lexsort((seeds, lags))
    for p, q in zip(seeds[order].tolist(), lags[order].tolist()):
        if q == lag and p < covered:
            continue
        start = p - _same_behind(x, p, p + q)
        covered, lag = p + _same_ahead(x, p, p + q), q
        if covered > p and covered - start >= max(q, LEAST - q) and not _has_divisor_period(x, start, q):
            runs.append((start, covered + q, q))
    return runs


def _lag_seeds(x: np.ndarray, q: int) -> np.ndarray:
    """Places inside stretches of at least ``max(q, LEAST - q)`` that agree with the place ``q`` further on."""
    need = max(q, LEAST - q)
    at = np.flatnonzero(x[: len(x) - q : need] == x[q::need]) * need
    grown = np.zeros(len(at), np.int64)
    for side in (-1, 1):
        live = np.arange(len(at))
        for step in range(1, need):
            to = at[live] + side * step
            inside = (to >= 0) & (to + q < len(x))
            live, to = live[inside], to[inside]
            live = live[x[to] == x[to + q]]
            if not len(live):
                break
            grown[live] += 1
    return at[grown >= need - 1]


def _sliding(values: np.ndarray, width: int, smaller: bool) -> np.ndarray:
    """Extremes of all windows of ``width``, a power of two."""
    best, step = (np.minimum if smaller else np.maximum), 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _minimizer_seeds(grams: np.ndarray, g: int, scale: int, periodic: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal chosen grams whose distance is at least the scale and less than twice as much: places and lags."""
    marks = np.zeros(len(grams) + 1, np.int32)
    for start, stop, _ in periodic:
        marks[start] += 1
        marks[min(stop - g + 1, len(grams))] -= 1
    values = np.where(np.cumsum(marks[:-1]) > 0, _NONE, np.minimum(grams, _NONE - np.uint64(1)))
    if len(values) < g:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _sliding(values, g, smaller=True)
    least[least == _NONE] = 0
    edge = np.zeros(g - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), g, smaller=False) == values)
    order = np.argsort(values[chosen], kind="stable")
    at, value = chosen[order], values[chosen][order]
    places, lags = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(1, REACH + 1):
        same = value[k:] == value[:-k]
        if not same.any():
            break
        lag = at[k:] - at[:-k]
        hit = np.flatnonzero(same & (lag >= scale) & (lag < 2 * scale))
        places.append(at[hit])
        lags.append(lag[hit])
    return np.concatenate(places), np.concatenate(lags)


def _touching_seeds(x: np.ndarray, scale: int, periodic: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Places and lags of the scale at which one run of a short period repeats in the next that it touches."""
    places, lags = [], []
    by_period = sorted((d, s, e) for s, e, d in periodic)
    for (d, s1, e1), (d2, s2, e2) in zip(by_period, by_period[1:]):
        high = min(2 * scale - 1, e1 - s1, e2 - s2)
        if d != d2 or s2 > e1 or high < scale:
            continue
        root = x[e1 - d : e1]
        for r in np.flatnonzero(x[s2 : s2 + d] == root[0]).tolist():
            if np.array_equal(x[s2 + r : s2 + r + d], root):
                first = scale + (s2 + r + d - e1 - scale) % d
                for q in range(first, high + 1, d):
                    at = max(s1, s2 - q)
                    if at < min(e1, e2 - q):
                        places.append(at)
                        lags.append(q)
                break
    return places, lags


def word_runs(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows ``start, stop, period`` of all runs in texts that lie end to end, longest first, and share no number."""
    ends = np.cumsum(lengths)
    reach = lambda least: int(ends[k - 1]) if (k := int(np.searchsorted(-lengths, -least, side="right"))) else 0
    runs: list[tuple[int, int, int]] = []
    for q in range(1, DIRECT):
        part = x[: reach(max(LEAST, 2 * q))]
        if not len(part):
            break
        seeds = _lag_seeds(part, q)
        runs += _extended(part, seeds, np.full(len(seeds), q))
    scale, g = DIRECT, 1
    grams = mixed(x[: reach(2 * scale)].astype(np.uint64))
    while size := reach(2 * scale):
        part = x[:size]
        grams = grams[: size - g + 1]
        while g < scale // 4:
            grams = mixed(grams[:-g] * _LEFT + grams[g:])
            g *= 2
        periodic = [r for r in runs if r[2] <= g // 2 and r[1] - r[0] >= g and r[1] <= size]
        places, lags = _minimizer_seeds(grams, g, scale, periodic)
        more, wide = _touching_seeds(part, scale, periodic)
        runs += _extended(part, np.append(places, more).astype(np.int64), np.append(lags, wide).astype(np.int64))
        scale *= 2
    return np.array(sorted(runs), np.int64).reshape(-1, 3)


def _of_texts(texts: pa.Array) -> tuple[list[int], list[list[dict]], list[bytes]]:
    words, numbers, used = [], [], 0
    for raw in texts.cast(pa.binary()).to_pylist():
        found = (raw or b"").split()  # splits bytes at \x20 and \x09-\x0D, and nowhere else
        first: dict[bytes, int] = {}
        words.append(found)
        numbers.append(np.fromiter(map(first.setdefault, found, range(used, used + len(found))), np.int64, len(found)))
        used += len(found)
    lengths = np.array([len(n) for n in numbers], np.int64)
    order = np.argsort(-lengths, kind="stable")
    x = np.concatenate([numbers[i] for i in order.tolist()]) if len(order) else np.zeros(0, np.int64)
    x = x.astype(np.int32) if used < 1 << 31 else x
    runs = word_runs(x, lengths[order])
    starts = np.cumsum(lengths[order]) - lengths[order]
    owner = np.searchsorted(starts + lengths[order], runs[:, 0], side="right")
    lists: list[list[dict]] = [[] for _ in words]
    for (start, stop, period), o in zip(runs.tolist(), owner.tolist()):
        lists[order[o]].append({"start": start - int(starts[o]), "length": stop - start, "period": period})
    for own in lists:
        own.sort(key=lambda r: (r["start"], r["period"]))
    collapsed = []
    for found, own in zip(words, lists):
        if own:
            drop = np.zeros(len(found) + 1, np.int32)
            for r in own:
                drop[r["start"] + r["period"]] += 1
                drop[r["start"] + r["length"]] -= 1
            found = [found[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(found))
    return lengths.tolist(), lists, collapsed


@F.arrow_udf(RESULT)
def _found(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    parts = []
    for start, stop in slices(texts):
        lengths, lists, collapsed = _of_texts(texts.slice(start, stop - start))
        columns = [pa.array(lengths, pa.int64()), pa.array(lists, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
        parts.append(pa.StructArray.from_arrays(columns, ["n_words", "runs", "collapsed"]))
    empty = pa.array([], pa.struct([("n_words", pa.int64()), ("runs", kind), ("collapsed", pa.string())]))
    return pa.concat_arrays(parts) if parts else empty


def find_runs(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, runs, collapsed``: the runs by start and period, and the text without what runs repeat.

    A word is left out of ``collapsed`` when a run holds it after its first period; the others are joined by one space.
    """
    name = free_name(documents, "found")
    found = put(documents, {name: _found(F.col(f"`{text}`"))})
    return put(found, {n: F.col(f"{name}.{n}") for n in ("n_words", "runs", "collapsed")}).drop(name)
