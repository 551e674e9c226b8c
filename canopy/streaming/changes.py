"""Change streams: settling, activity, saturation, newest-only, generations.

The functions on ``(module, ts, …)`` take batch and streaming DataFrames alike; on streams they carry a watermark, so state
is dropped once a session can't grow any more.  Sessions close in event time: the last one of a stream is emitted when the
watermark has passed it, not after a wall-clock silence.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.hashing import row_sum

SETTLE, WATERMARK = "400 milliseconds", "10 seconds"


def _watermarked(changes: DataFrame, delay: str) -> DataFrame:
    return changes.withWatermark("ts", delay) if changes.isStreaming else changes


def settled(changes: DataFrame, settle: str = SETTLE, watermark: str = WATERMARK) -> DataFrame:
    """``(module, started, settled, changes)``: bursts of a module's changes that ``settle`` of silence ended."""
    sessions = _watermarked(changes, watermark).groupBy("module", F.session_window("ts", settle).alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("changes"), F.max("ts").alias("last")).select("module", F.col("w.start").alias("started"), F.col("w.end").alias("settled"), "changes")


def newest_only(items: DataFrame, quiet: str, watermark: str = WATERMARK) -> DataFrame:
    """``(module, started, item)``: the latest item of each burst."""
    sessions = _watermarked(items, watermark).groupBy("module", F.session_window("ts", quiet).alias("w"))
    return sessions.agg(F.max_by("item", F.struct("ts", "item")).alias("item")).select("module", F.col("w.start").alias("started"), "item")


def reverted(changes: DataFrame, settle: str) -> DataFrame:
    """Bursts whose last signature is not the first: edits that were taken back in the same burst don't count."""
    sessions = changes.groupBy("module", F.session_window("ts", settle).alias("w")).agg(F.min_by("signature", "ts").alias("first"), F.max_by("signature", "ts").alias("last"))
    return sessions.where("NOT (first <=> last)").select("module", F.col("w.start").alias("started"), "first", "last")


def saturated(completions: DataFrame, window: str, slide: str, most: int, watermark: str = WATERMARK) -> DataFrame:
    """``(started, completions)``: sliding windows with ``most`` completions or more."""
    counts = _watermarked(completions, watermark).groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("completions"))
    return counts.where(F.col("completions") >= most).select(F.col("w.start").alias("started"), "completions")


def activity(changes: DataFrame, trailing_seconds: int, step_seconds: int = 1, cap_seconds: int = 10) -> DataFrame:
    """Changes with ``recent`` (those of the module in the trailing window) and the ``delay`` it asks for, batch only."""
    w = Window.partitionBy("module").orderBy(F.unix_micros("ts")).rangeBetween(-trailing_seconds * 1_000_000, 0)
    recent = F.count(F.lit(1)).over(w)
    return changes.withColumn("recent", recent).withColumn("delay", F.least((F.col("recent") - 1) * step_seconds, F.lit(cap_seconds)).cast("long"))


def output_signatures(files: DataFrame) -> DataFrame:
    """``(module, signature, files)`` of ``(module, path, size, mtime)``: the same in any order of files.

    The signature is the sum of 48 bits of each file's MD5, so equal rows don't cancel out.
    """
    return files.groupBy("module").agg(row_sum("path", "size", "mtime").alias("signature"), F.count(F.lit(1)).alias("files"))


def rescanned(previous: DataFrame, fresh: DataFrame, changed: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Facts with those of ``changed(module)`` replaced and those of undeclared modules dropped."""
    kept = previous.join(changed.select("module"), "module", "left_anti")
    if declared is not None:
        kept = kept.join(declared.select("module"), "module", "left_semi")
    return kept.unionByName(fresh)


def reload_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(module, status)`` of two tables ``(module, signature)``: added, removed, changed, kept."""
    both = before.withColumnRenamed("signature", "a").join(after.withColumnRenamed("signature", "b"), "module", "full_outer")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("kept")
    return both.select("module", status.alias("status"))


def breaker(completions: DataFrame, window_ms: int, most: int, cooldown_ms: int) -> DataFrame:
    """Stateful form for streams: ``(module, ts, tripped, until)`` for each completion; state is the window's times."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, until = state.get if state.exists else ([], 0)
        times = list(times)
        out = []
        for frame in frames:
            for ts in sorted(frame["ts"]):
                now = int(ts.value // 1_000_000)
                times = [t for t in times if t > now - window_ms] + [now]
                tripped = len(times) >= most
                until = max(until, now + cooldown_ms) if tripped else until
                out.append((key[0], ts, tripped, until))
        state.update((times, until))
        yield pd.DataFrame(out, columns=["module", "ts", "tripped", "until"])

    return completions.groupBy("module").applyInPandasWithState(step, "module long, ts timestamp, tripped boolean, until long", "times array<long>, until long", "append", "NoTimeout")


class Coalescer:
    """Pending module keys: united while one update runs, superseded by a reload."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._modules: set[str] = set()
        self._reload = False
        self.running = False

    def add(self, modules: set[str]) -> None:
        with self._lock:
            self._modules |= modules

    def reload(self) -> None:
        with self._lock:
            self._reload = True

    def take(self) -> tuple[str, set[str]] | None:
        """What to do next, ``("reload" | "rescan", modules)``; None while an update runs or nothing is pending."""
        with self._lock:
            if self.running or not (self._reload or self._modules):
                return None
            kind, modules = ("reload", set()) if self._reload else ("rescan", self._modules)
            self._modules, self._reload, self.running = set(), False, True
            return kind, modules

    def done(self) -> None:
        with self._lock:
            self.running = False


@dataclass
class Catalog:
    """Generations of a graph: one is live, a query keeps the one it began with, a failed build changes nothing."""

    generation: int = 0
    live: object | None = None
    status: str = "idle"
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def publish(self, build: Callable[[], object]) -> str:
        """PUBLISHED, DISCARDED (a later generation came first) or CANCELLED (the build failed)."""
        with self._lock:
            began = self.generation
        self.status = "reloading"
        try:
            made = build()
        except Exception:
            self.status = "idle"
            return "CANCELLED"
        with self._lock:
            self.status = "idle"
            if self.generation != began:
                return "DISCARDED"
            self.generation, self.live = began + 1, made
            return "PUBLISHED"

    def pinned(self) -> tuple[int, object]:
        with self._lock:
            return self.generation, self.live
