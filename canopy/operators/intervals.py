"""Subtrees as intervals: each node has the number at which its subtree opens and the one at which it closes.

A node lies in a subtree if its number lies between the two, so a question about a subtree is a range of a sorted column:
files and row groups outside the range are skipped, and no closure is needed, however deep the tree.  Numbers come from one
global order of opening and closing marks, two rows a node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators.aggregate import MOST_PAIRS
from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.numbering import numbered
from canopy.plans.materialize import stage_table

#: Sorts behind every key.
_CLOSE = "\U0010ffff"


def node_paths(graph: DependencyGraph) -> DataFrame:
    """``(id, path)``: names that sort as the tree is walked, from the root down."""
    if (paths := graph.extensions.get("paths")) is not None:
        return paths.select("id", "path")
    keyed = graph.tree.join(graph.nodes.select(F.col("id").alias("node_id"), "key"), "node_id")
    level = stage_table(keyed.where("parent_id IS NULL").select(F.col("node_id").alias("id"), F.array("key").alias("path")))
    out = level
    below = keyed.where("parent_id IS NOT NULL")
    while True:
        level = stage_table(level.withColumnRenamed("id", "parent_id").join(below, "parent_id").select(F.col("node_id").alias("id"), F.concat("path", F.array("key")).alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


@dataclass(frozen=True)
class IntervalTree:
    """``nodes(id, opens, closes, depth)`` sorted by ``opens``, and the graph's edges as ``between``; ``edges`` are these with
    ``from_opens`` and ``to_opens``, sorted by the former, written when they are first asked for."""

    nodes: DataFrame
    between: DataFrame
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def edges(self) -> DataFrame:
        if "edges" not in self._cache:
            ends = lambda side: self.nodes.select(F.col("id").alias(f"{side}_id"), F.col("opens").alias(f"{side}_opens"))
            placed = self.between.join(ends("from"), "from_id").join(ends("to"), "to_id")
            self._cache["edges"] = stage_table(placed.repartitionByRange("from_opens", "to_opens").sortWithinPartitions("from_opens", "to_opens"))
        return self._cache["edges"]

    def bounds(self, ids: Sequence[int]) -> dict[int, tuple[int, int]]:
        """Intervals of nodes that were asked for by id."""
        found = {r["id"]: (r["opens"], r["closes"]) for r in self.nodes.where(F.col("id").isin(*[int(i) for i in ids])).select("id", "opens", "closes").collect()}
        if missing := [i for i in ids if i not in found]:
            raise QueryError("NODE_NOT_FOUND", f"no nodes with the ids {missing[:10]}")
        return found

    def subtree(self, node_id: int) -> DataFrame:
        """Nodes strictly below one, in pre-order, with their depth below it."""
        ((low, high),) = self.bounds([node_id]).values()
        return self.nodes.where((F.col("opens") > low) & (F.col("opens") < high)).orderBy("opens")

    def accumulated(self, node_id: int, outgoing: bool = True) -> DataFrame:
        """Edges from (to) a subtree."""
        ((low, high),) = self.bounds([node_id]).values()
        side = "from_opens" if outgoing else "to_opens"
        return self.edges.where((F.col(side) >= low) & (F.col(side) < high))

    def within(self, ids: DataFrame, anchor: int) -> DataFrame:
        """Those of ``ids(id)`` in a subtree, itself included."""
        ((low, high),) = self.bounds([anchor]).values()
        return ids.join(self.nodes.where((F.col("opens") >= low) & (F.col("opens") < high)).select("id"), "id", "left_semi")

    def descendant_counts(self) -> DataFrame:
        """``(id, descendants)`` of every node: half of the marks inside its own."""
        return self.nodes.select("id", F.expr("(closes - opens - 1) div 2").alias("descendants"))

    def aggregated_pairs(self, sources: Sequence[int], targets: Sequence[int]) -> DataFrame:
        """``(source, target, weight, type_pairs, attrs)`` of all given pairs that depend; subtrees may nest.

        Nodes are placed by ranges, each in the given subtrees that it lies in, and edges meet them by id with only the columns
        that are summed: no table of edges is written.
        """
        sources, targets = list(dict.fromkeys(sources)), list(dict.fromkeys(targets))
        if len(sources) * len(targets) > MOST_PAIRS:
            raise QueryError("INPUT_TOO_LARGE", f"at most {MOST_PAIRS} pairs", "ask for fewer nodes")
        at = self.bounds([*sources, *targets])
        spark = self.nodes.sparkSession

        def inside(ids: list[int], side: str, name: str) -> DataFrame:
            boxes = F.broadcast(spark.createDataFrame([(i, *at[i]) for i in ids], f"{name} long, low long, high long"))  # bounded by MOST_PAIRS
            spanned = self.nodes.where((F.col("opens") >= min(at[i][0] for i in ids)) & (F.col("opens") < max(at[i][1] for i in ids)))
            return spanned.join(boxes, (F.col("opens") >= F.col("low")) & (F.col("opens") < F.col("high"))).select(F.col("id").alias(f"{side}_id"), name)

        rows = self.between.select("from_id", "to_id", "weight", "attrs").join(inside(targets, "to", "target"), "to_id").drop("to_id").join(inside(sources, "from", "source"), "from_id")
        return rows.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("type_pairs"), F.bit_or("attrs").alias("attrs"))


def interval_tree(graph: DependencyGraph) -> IntervalTree:
    """The tree of a graph as intervals, written sorted."""
    paths = node_paths(graph)
    marks = paths.select("id", F.size("path").alias("depth"), F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("path")), F.struct(F.lit(1).alias("end"), F.concat("path", F.array(F.lit(_CLOSE))).alias("path")))).alias("mark"))
    placed = numbered(marks.select("id", "depth", "mark.end", "mark.path"), ["path", "id"]).select("id", "depth", "end", "pos")
    of = lambda end: F.max(F.when(F.col("end") == end, F.col("pos")))
    nodes = stage_table(placed.groupBy("id").agg(of(0).alias("opens"), of(1).alias("closes"), F.max("depth").alias("depth")).repartitionByRange("opens").sortWithinPartitions("opens"))
    return IntervalTree(nodes, graph.edges)
