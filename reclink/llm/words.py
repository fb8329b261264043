"""Words of many texts at once: numpy over UTF-8 bytes.

A word is a run of bytes other than space and the control characters 9 to 13 (``[^\\x20\\x09-\\x0D]+``).  Hashes are
polynomial over random byte values and then mixed; equal sequences of words have equal hashes, so a hash may serve to
find candidates, and whoever needs certainty compares the words themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = (out[0], out[1])
        if size <= 1 << 21:
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    power, inverse = _power_table(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of the texts data[offsets[i]:offsets[i + 1]], and the index of each text's first word (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    h = mixed(_span_hash(_VALUE[data], starts, ends, _BASES[0]) + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (as many as fit; those that cross a text's end too)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mixed(_span_hash(words, at, at + size, _BASES[1]))


def blocks_of(sizes: np.ndarray, most: int):
    """Ranges of consecutive texts of at most ``most`` bytes together, or one longer text."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += int(size)
    if len(sizes) > start:
        yield start, len(sizes)


def exact(names: list[str]) -> list[Column]:
    """Columns of these names, whatever characters they have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that nothing else uses, and the new name of each column, so that no result hides an input column."""
    names = {c: f"in__{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[c.alias(n) for c, n in zip(exact(docs.columns), names.values())]), names


def restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``numbered`` rows, under their own names."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])
