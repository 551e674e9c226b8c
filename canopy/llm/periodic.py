"""Runs of words that repeat with a short period, by divide and conquer (Main and Lorentz).

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that no neighbouring
word extends.  A text is halved again and again; of the runs that cross a midpoint, each has a period to the right or to the
left of it, and Z-functions of the halves tell for every period how far the repetition reaches to both sides.  A repetition
that reaches the end of its segment and goes on beyond it crosses a midpoint higher up, where it is found whole.  Intervals
found with several periods keep the smallest.

Halving is only needed where runs can lie: every window of ``least // 3`` words inside a run occurs twice in its text, so
a run lies within a stretch of window positions that all have a twin.  Windows are compared by hashes (a false twin costs
work only), runs by interned word ids, so results are exact.  Time is n log n in the length of such stretches.

Nothing moves between tasks: a text is a row.  Memory is a slice of some megabytes of text, or the longest text.

Defined results: a null or empty text has no words and no runs; repeated rows get equal results; a null id plants nothing;
an empty table gives an empty result; columns to be kept pass through under their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.words import Rolling, bounded_batches, mixed, slices, utf8

LEAST, TIMES = 24, 3
Run = tuple[int, int, int]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def z_function(x: list[int]) -> list[int]:
    """For each position the length of the longest common prefix of ``x`` and what begins there (0 at the start)."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(w: list[int], low: int, mid: int, high: int, least: int, times: int) -> np.ndarray:
    """Rows ``start, end, period`` of the repetitions in ``w[low:high]`` that meet the midpoint and are long enough."""
    u, v, both = w[low:mid], w[mid:high], w[low:high]
    a, b = len(u), len(v)
    found = []
    for n, own, other in ((b, v, [*u[::-1], -1, *both[::-1]]), (a, u[::-1], [*v, -1, *both])):
        q = np.arange(1, n + 1)
        along = np.array([*z_function(own)[1:], 0])  # how far what lies q words on equals the half itself
        across = np.array(z_function(other)[a + b - n + 1 :][: n][::-1])  # how far the words q on equal those across the midpoint
        if own is v:
            start, end = mid - across, mid + q + along
        else:
            start, end = mid - q - along, mid + across
        long = end - start >= np.maximum(least, times * q)
        found.append(np.stack([start[long], end[long], q[long]], axis=1))
    return np.concatenate(found)


def find_runs(w: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """``(start, length, period)`` of every run of ``w``, by start, then period."""
    n = len(w)
    period_of: dict[tuple[int, int], int] = {}
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        mid = (low + high) // 2
        todo += [(low, mid), (mid, high)]
        rows = _crossing(w, low, mid, high, least, times)
        if not len(rows):
            continue
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        for start, end, q in rows[first].tolist():
            if (start == 0 or w[start - 1] != w[start - 1 + q]) and (end == n or w[end] != w[end - q]):
                period_of[start, end] = min(q, period_of.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in period_of.items())


def _stretches(ids: np.ndarray, starts: np.ndarray, rolling: Rolling, least: int) -> Iterator[tuple[int, int, int]]:
    """``(text, low, high)`` for stretches of words outside which no run of any text can lie."""
    window = max(1, least // 3)
    lengths = np.diff(starts)
    ends = np.repeat(starts[1:], lengths)
    at = np.flatnonzero(ends - np.arange(len(ids)) >= window)
    if not len(at):
        return
    text = np.repeat(np.arange(len(lengths)), lengths)[at].astype(np.uint64)
    key = mixed(rolling.windows(rolling.prefix(mixed(ids.astype(np.uint64) + np.uint64(1))), at, window) + mixed(text + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    twin = key[1:] == key[:-1]
    dirty = np.zeros(len(ids) + 1, np.int8)
    dirty[at[order[1:][twin]]] = 1
    dirty[at[order[:-1][twin]]] = 1
    edges = np.flatnonzero(np.diff(dirty, prepend=np.int8(0)))
    low, high = edges[::2], edges[1::2] + window - 1
    wide = high - low >= least
    for x, y in zip(low[wide].tolist(), high[wide].tolist(), strict=True):
        yield int(np.searchsorted(starts, x, "right")) - 1, x, y


def runs_of_texts(words: list[list[bytes]], rolling: Rolling, least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each of several texts, given as words."""
    interned: dict[bytes, int] = {}
    flat = np.fromiter((interned.setdefault(x, len(interned)) for x in chain.from_iterable(words)), np.int64)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in words], out=starts[1:])
    out: list[list[Run]] = [[] for _ in words]
    for text, low, high in _stretches(flat, starts, rolling, least):
        shift = low - int(starts[text])
        out[text] += [(start + shift, length, q) for start, length, q in find_runs(flat[low:high].tolist(), least, times)]
    return [sorted(x) for x in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [x for x, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """``words``, of which a tenth of all numbers ``h`` turn the rest from some place on into a repetition."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def periodic_runs(documents: DataFrame, text: str = "text", keep: Sequence[str] = (), plant: Column | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``keep``, ``runs array<struct<start, length, period>>`` and ``collapsed``, the text without the repetitions.

    ``plant`` is a number for each row that :func:`planted` turns into a repetition before the search, for tests of recall.
    """
    if times < 3 or least < 3:
        raise ValueError("runs have at least three periods and three words")
    bounded_batches(documents.sparkSession)
    names = [f"__k_{i}" for i in range(len(keep))]
    rows = documents.select(F.col(text).alias("__text"), (F.lit(None) if plant is None else plant).cast("long").alias("__plant"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            texts, plants = utf8(batch.column(0)), batch.column(1).to_pylist()
            for low, high in slices(texts):
                words = [planted(t.split(), h) for t, h in zip(texts[low:high], plants[low:high], strict=True)]
                runs = runs_of_texts(words, rolling, least, times)
                left = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
                told = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUNS)
                yield pa.RecordBatch.from_arrays([*[c.slice(low, high - low) for c in batch.columns[2:]], told, pa.array(left, pa.binary()).cast(pa.string())], names=[*names, "runs", "collapsed"])

    schema = T.StructType([*rows.schema.fields[2:], *T._parse_datatype_string("runs array<struct<start:long,length:long,period:long>>, collapsed string").fields])
    return rows.mapInArrow(run, schema).select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "runs", "collapsed")


def document_runs(documents: DataFrame) -> DataFrame:
    """Runs of every document after planting: their number, the one of greatest exponent, and digests of all and of what is left."""
    found = periodic_runs(documents, keep=["doc_id"], plant=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    above = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, x: F.when(above(x, top), x).otherwise(top))
    line = lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])
    told = F.concat_ws("", F.transform("runs", lambda x: F.concat(line(x), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
