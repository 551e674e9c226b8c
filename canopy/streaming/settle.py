"""Changes that have settled by the wall clock: bursts kept in state, ended by processing-time timers.

A group's items (the modules of one watcher, the files of one build) are observed with a signature each.  A changed signature
opens a burst or prolongs it; when none of the group's items has changed for ``settle_ms``, the timer fires and every item
whose signature differs from the one last reported is emitted, once.  An edit taken back within the burst leaves no row.
The last burst of a stream is emitted after its silence, without a later event and without a watermark.

With one item a group this is a debounce for each item; with all items in one group it is a burst over all of them.
A null signature means that the item is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "group string, item string, signature long, previous long, changes long, started timestamp, settled timestamp"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_files(spark: SparkSession) -> None:
    """State with timers needs the state store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


class _Bursts(StatefulProcessor):
    """State of a group: signatures seen and reported by item, and the open burst with its timer."""

    def __init__(self, settle_ms: int) -> None:
        self.settle_ms = settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reported = handle.getMapState("reported", "item string", "signature long")
        self.open = handle.getMapState("open", "item string", "signature long, changes long")
        self.burst = handle.getValueState("burst", "started long, timer long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for item, signature in zip(initialState["item"], initialState["signature"], strict=True):
            self.reported.updateValue((item,), (_number(signature),))

    def _seen(self, item: str) -> tuple[int | None, int]:
        if self.open.containsKey((item,)):
            signature, changes = self.open.getValue((item,))
            return signature, changes
        return (self.reported.getValue((item,))[0] if self.reported.containsKey((item,)) else None), 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        changed = False
        for frame in rows:
            for item, signature in zip(frame["item"], frame["signature"], strict=True):
                signature = _number(signature)
                last, changes = self._seen(item)
                if signature != last:
                    self.open.updateValue((item,), (signature, changes + 1))
                    changed = True
        if changed:
            started = now
            if self.burst.exists():
                started, timer = self.burst.get()
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.settle_ms)
            self.burst.update((started, now + self.settle_ms))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, _ = self.burst.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        out = []
        for (item,), (signature, changes) in list(self.open.iterator()):
            previous = self.reported.getValue((item,))[0] if self.reported.containsKey((item,)) else None
            if signature != previous:
                out.append((key[0], item, signature, previous, changes, pd.Timestamp(started, unit="ms"), pd.Timestamp(now, unit="ms")))
                self.reported.updateValue((item,), (signature,))
        self.open.clear()
        self.burst.clear()
        frame = pd.DataFrame(out, columns=["group", "item", "signature", "previous", "changes", "started", "settled"])
        yield frame.astype({"signature": "Int64", "previous": "Int64", "changes": "int64", "started": "datetime64[us]", "settled": "datetime64[us]"})

    def close(self) -> None:
        pass


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def settled_bursts(observations: DataFrame, settle_ms: int, baseline: DataFrame | None = None) -> DataFrame:
    """Stream of settled changes from a stream ``(group, item, signature)``.

    ``baseline`` has the signatures known at the start; items without one were absent.  Rows of a group are handled where its
    state is; different groups are independent.
    """
    columns = [F.col("group").cast("string"), F.col("item").cast("string"), F.col("signature").cast("long")]
    grouped = observations.select(*columns).groupBy("group")
    initial = None if baseline is None else baseline.select(*columns).groupBy("group")
    return grouped.transformWithStateInPandas(statefulProcessor=_Bursts(settle_ms), outputStructType=OUTPUT, outputMode="append", timeMode="processingTime", initialState=initial)


def module_changes(observations: DataFrame, settle_ms: int = 400, baseline: DataFrame | None = None) -> DataFrame:
    """Debounce of ``(module, signature)`` for each module."""
    each = lambda rows: None if rows is None else rows.select(F.col("module").alias("group"), F.col("module").alias("item"), "signature")
    return settled_bursts(each(observations), settle_ms, each(baseline)).select(F.col("item").alias("module"), "signature", "previous", "changes", "started", "settled")


def build_file_changes(observations: DataFrame, settle_ms: int = 400, baseline: DataFrame | None = None) -> DataFrame:
    """Changes of ``(path, signature)`` that are reported together when no file has changed for a while."""
    every = lambda rows: None if rows is None else rows.select(F.lit("build files").alias("group"), F.col("path").alias("item"), "signature")
    return settled_bursts(every(observations), settle_ms, every(baseline)).select(F.col("item").alias("path"), "signature", "previous", "changes", "started", "settled")
