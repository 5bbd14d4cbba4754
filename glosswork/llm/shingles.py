"""Hashes of words and word shingles, computed on whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10  # text hashed at a time, cut between words
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """Hashes of the words of texts, A to Z being read as a to z."""

    def __init__(self):
        self.powers = _powers(BLOCK_BYTES + (1 << 16))

    def words(self, raw: np.ndarray) -> np.ndarray:
        """The words of one run of bytes, in order."""
        if len(raw) <= BLOCK_BYTES:
            return self._block(raw)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        cuts, at = [0], BLOCK_BYTES
        while at < len(raw):
            ahead = np.flatnonzero(blank[at : at + BLOCK_BYTES])
            if len(ahead):
                cuts.append(at + int(ahead[0]))
                at = cuts[-1] + BLOCK_BYTES
            else:
                at += BLOCK_BYTES
        return np.concatenate([self._block(raw[a:b]) for a, b in zip(cuts, [*cuts[1:], len(raw)])])

    def _block(self, raw: np.ndarray) -> np.ndarray:
        letter = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = np.diff(letter.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return np.zeros(0, np.uint64)
        if len(raw) > len(self.powers[0]):
            self.powers = _powers(len(raw))
        up, down = self.powers
        small = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((small.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, raw: np.ndarray, width: int) -> np.ndarray:
        """The distinct shingles of a text, ascending; fewer words than ``width`` make one shingle of them all."""
        words = self.words(raw)
        if len(words) == 0:
            return words
        n = min(width, len(words))
        total = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            total += words[i : len(words) - n + 1 + i] * _STEPS[i]
        return np.unique(mixed(total + np.uint64(n)))


def raw_texts(texts: pa.Array) -> list[np.ndarray]:
    """The bytes of every text without a copy; none for no text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    known = texts.is_valid().to_numpy(zero_copy_only=False)
    return [whole[a:b] if k else whole[:0] for a, b, k in zip(offsets[:-1], offsets[1:], known)]
