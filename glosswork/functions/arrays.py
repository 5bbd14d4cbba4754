"""Array expressions that stay inside a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMED_ROWS = 64  # lists that are summed at a time


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    An expression named twice, or named inside a lambda, may be computed again
    each time; wrapping it as a one-element array binds it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def running_total(lists: pa.Array) -> pa.Array:
    """Running sum inside every list, last element included.

    Many rows of an Arrow batch are summed at once and each list's start is taken
    off, so no Python loop runs over rows; a few at a time, so that the sums of a
    batch of long lists take little memory. The same thing as a fold that appends
    to an array copies the array at every step.
    """
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    within = np.empty(offsets[-1], np.int32)
    for at in range(0, len(lists), SUMMED_ROWS):
        some = sizes[at : at + SUMMED_ROWS]
        values = lists.slice(at, len(some)).flatten().to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        starts = offsets[at : at + len(some)] - offsets[at]
        within[offsets[at] : offsets[at + len(some)]] = sums[1:] - np.repeat(sums[starts], some)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(within))


def whole_div(value: Column, by: int) -> Column:
    """Whole-number division, exact for ids that a double cannot hold."""
    return F.call_function("div", value, F.lit(by))


def flattened(df: DataFrame, keys: Sequence[str], items: Column | str, name: str, place: str | None = None) -> DataFrame:
    """One row per array element: ``keys, [place,] name``.

    A plain ``explode`` makes Spark filter out empty arrays first, which
    computes a costly array expression again for the filter. The outer form
    does not, and its row for an empty array is dropped afterwards.
    """
    present = F.col(name).isNotNull() if place is None else F.col(place).isNotNull()
    exploded = F.explode_outer(items).alias(name) if place is None else F.posexplode_outer(items).alias(place, name)
    return df.select(*keys, exploded).where(present)


def argmax(scores: Column) -> Column:
    """0-based place of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(
        scores,
        lambda s: let(
            F.array_max(s),
            lambda top: let(
                F.transform(s, lambda x: F.exp(x - top)),
                lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z)),
            ),
        ),
    )


def log_softmax(scores: Column) -> Column:
    return let(
        scores,
        lambda s: let(
            F.array_max(s),
            lambda top: let(
                top + F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))),
                lambda z: F.transform(s, lambda x: x - z),
            ),
        ),
    )


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def sum_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)


def pad_to(values: Column, width: Column, pad: Column) -> Column:
    """Append ``pad`` until the array has ``width`` elements; never cuts."""
    return F.concat(values, F.array_repeat(pad, F.greatest(width - F.size(values), F.lit(0))))


def one_based(values: Column, zero_based: Column) -> Column:
    """Element at a 0-based place, NULL when the place is outside."""
    return F.try_element_at(values, (zero_based + 1).cast("int"))
