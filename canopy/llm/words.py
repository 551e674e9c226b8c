"""Words as 64-bit numbers, in slices of bounded size, and routing of packed rows between tasks.

A word is a maximal run of bytes other than space and the bytes 9 to 13, so ``bytes.split()`` is exact.  Python-side
operators work on slices of a few megabytes of text at a time whatever an Arrow batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
_MEMO_ENTRIES = 1 << 17
#: Odd multipliers, so that they have inverses modulo 2**64.
_BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordMemo(dict):
    """Hash of each word seen lately; emptied when it has ``_MEMO_ENTRIES`` words, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


#: Bytes of an Arrow batch that a worker gets at once, whatever the session's default.
BATCH_BYTES = 8 << 20


def bounded_batches(spark) -> None:
    """Let Python workers get texts in batches of a few megabytes: long texts then don't swell a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that this process has freed to the system; where the C library can't, nothing happens."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for workers that Spark uses again: what a task has freed goes back after each ``BATCH_BYTES`` and at its end.

    Else a worker keeps the most that any task before has held, all through a job of many stages.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            size += batch.nbytes
            yield batch
            del batch
            if size >= BATCH_BYTES:
                size = 0
                give_back()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(read(batches))
        finally:
            give_back()

    return wrapped


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null texts are empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have ``limit`` bytes or a single row."""
    low = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield low, i
            low, size = i, 0
        size += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


def hashed(words: list[list[bytes]], memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and where each document starts (one entry more than documents)."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in words], out=starts[1:])
    return np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(starts[-1])), starts


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Rolling:
    """Hash of any run of consecutive words in constant time, from prefix sums modulo 2**64."""

    def __init__(self, base: np.uint64 = _BASE) -> None:
        self._base, self._inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self._up = self._down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            m = max(n, 2 * len(self._up))
            for name, by in (("_up", self._base), ("_down", self._inverse)):
                x = np.full(m, by, np.uint64)
                x[:1] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self._powers(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self._up[: len(h)], dtype=np.uint64, out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the runs of ``length`` words that start at the positions ``at``."""
        return mixed((prefix[at + length] - prefix[at]) * self._down[at])


def _spark_hash(x: int) -> int:
    """Spark's hash of an INT, by which hash partitioning deals rows out."""

    def turn(v: int, by: int) -> int:
        return ((v << by) | (v >> (32 - by))) & 0xFFFFFFFF

    k = turn(x * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (turn(42 ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def route_keys(parts: int) -> list[int]:
    """For each of ``parts`` destinations an INT that ``repartition(parts, key)`` deals to a partition of its own."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < parts:
        found.setdefault(_spark_hash(x) % parts, x)
        x += 1
    return [found[i] for i in range(parts)]


def batches_of(rows: dict[str, list], schema: pa.Schema, at_most: int = 512) -> Iterable[pa.RecordBatch]:
    """Record batches of at most ``at_most`` rows from columns."""
    n = len(next(iter(rows.values())))
    for low in range(0, n, at_most):
        yield pa.RecordBatch.from_arrays([pa.array(rows[f.name][low : low + at_most], f.type) for f in schema], schema=schema)
