"""Reproducible random draws.

``rand(seed)`` depends on how rows are spread over partitions, so a lost
executor or another partition count changes its answer. Every random choice
here hashes the seed with the row's own key instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_SPAN = 1 << 32  # eight hex digits


def draw_slice(digest: Column, part: int = 0) -> Column:
    """One of the four independent 32-bit numbers inside an md5 hex digest."""
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("bigint")


def digest_below(digest: Column, probability: float, part: int = 0) -> Column:
    """Whether that number is below the probability's share of the range.

    Hex digits of equal width sort as the numbers do, so nothing is converted.
    """
    digits = F.substring(digest, 8 * part + 1, 8) if part else digest
    return digits < F.lit(f"{threshold(probability):08x}")


def draw(seed: int, *keys: Column) -> Column:
    """A whole number in [0, 2^32) fixed by the seed and the keys."""
    parts = [F.lit(str(seed)), *(k.cast("string") for k in keys)]
    return draw_slice(F.md5(F.concat_ws(":", *parts)))


def threshold(probability: float) -> int:
    """Draws below this number happen with the given probability."""
    return int(probability * HEX_SPAN)
