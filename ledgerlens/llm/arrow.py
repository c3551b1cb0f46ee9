"""What the operators that run in Python share: bounded Arrow batches and numpy views of words.

A batch's texts are handled as one array of bytes. Words are runs of bytes other than U+0020 and U+0009 to U+000D,
with A-Z lower-cased; each has a 64-bit hash. All steps are array operations over blocks of about ``BLOCK`` bytes;
a longer text is a block of its own, so that memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ledgerlens.session import ship

BLOCK = 1 << 20
BATCH_BYTES = "16m"
BATCH_ROWS = "2000"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than letters and digits; bytes of other letters stay in words.
SIGNS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers are limited in bytes and rows, however long the texts are; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """Words of a block of texts. ``first`` has the index of each text's first word, and the number of words last."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    rows: range

    @property
    def lengths(self) -> np.ndarray:
        return self.ends - self.starts

    @property
    def hashes(self) -> np.ndarray:
        """A hash for each word; equal words, equal hashes."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.lengths
        at = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        letters = self.data[np.repeat(self.starts - at, size) + np.arange(len(place))]
        powers = powers_to(int(size.max()))
        return mix(np.add.reduceat(_CODES[letters] * powers[place], at) + size.astype(np.uint64) * _STEP)

    def prefixes(self, n: int) -> np.ndarray:
        """A hash of each word's first n bytes; 0 for shorter words."""
        long = self.lengths >= n
        found = np.zeros(len(long), np.uint64)
        if long.any():
            at = self.starts[long]
            total = np.full(len(at), n, np.uint64) * np.uint64(0x9FB21C651E98DF25)
            for k in range(n):
                total += _CODES[self.data[at + k]] * _POWERS[k]
            found[long] = mix(total) | np.uint64(1)
        return found

    @property
    def owner(self) -> np.ndarray:
        """The text, counted in the block, of each word."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(255, _STEP)], dtype=np.uint64)


def powers_to(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _STEP)], dtype=np.uint64)


def views(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each, without copying them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, range]]:
    """The bytes of consecutive rows, where each row begins and the last ends, and the rows."""
    if not len(texts):
        return
    data, off = views(texts)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(off, off[row] + block, "right")) - 1)
        yield data[off[row] : off[last]], off[row : last + 1] - off[row], range(row, last)
        row = last


def cut(data: np.ndarray, at: np.ndarray, rows: range, apart: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> Words:
    """The words of a block: runs of bytes that ``apart`` doesn't name, folded by ``fold``; none crosses a row."""
    inside = ~apart[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begin[first] = inside[first]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    final = at[1:][at[1:] > 0] - 1
    stop[final] = inside[final]
    starts = np.flatnonzero(begin)
    return Words(fold[data], starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, at), rows)


def words(texts: pa.Array, block: int = BLOCK, apart: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of all texts, in blocks of rows."""
    for data, at, rows in blocks(texts, block):
        yield cut(data, at, rows, apart)
