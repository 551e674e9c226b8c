"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two minimum aggregations and two joins, so a vertex with very many neighbours is pre-aggregated and its
join partition can be split; the edge table never grows.  Nothing but one row of counters reaches the driver.  An edge
table whose measured size is at most ``ONE_TASK`` edges is instead united in one task in a single pass, whose memory that
bound limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.plans.materialize import stage_table


#: Edges that one task may unite: some 100 MB.
ONE_TASK = 500_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := above.setdefault(top, top)) != top:
            top = y
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    ids = [x for x in above if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "component"])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(a, b)`` that has a smaller reachable vertex: its smallest one.

    Vertices that are smallest in their component don't appear; self loops, repeated and reversed edges and nulls are
    ignored; no edges give no rows.
    """
    current = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True)
    state = _state(current)
    if state[0] <= one_task:
        return current.coalesce(1).mapInArrow(_unite, "id long, component long")
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage_table(large)
        least = stage_table(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        following = stage_table(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        reached = _state(following)
        current = following
        if reached == state:
            break
        state = reached
    return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
