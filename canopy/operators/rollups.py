"""Sizes and couplings at every level of the fixed path module, package, type, in one grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.bits import bit_is_set
from canopy.operators.hierarchy import DependencyGraph
from canopy.schema import COUNTED_KINDS, EDGE_ATTRIBUTES, PACKAGE, SCOPE_TYPE_KINDS

LEVELS = ("graph", "module", "package", "type")
#: Where a node is in no package.
NO_PACKAGE = ""


def _column(prefix: str, name: str) -> str:
    return prefix + name.replace(".", "_")


def located(graph: DependencyGraph) -> DataFrame:
    """``(id, kind, module, package, type)`` of every type: the names on its path."""
    tops = graph.top_of().join(graph.nodes.select(F.col("id").alias("top"), F.col("qualified_name").alias("module")), "top")
    parents = graph.tree.select(F.col("node_id").alias("id"), F.col("parent_id")).join(graph.nodes.where(F.col("kind") == PACKAGE).select(F.col("id").alias("parent_id"), F.col("qualified_name").alias("package")), "parent_id", "left")
    types = graph.nodes.where(F.col("kind").isin(*SCOPE_TYPE_KINDS)).select("id", "kind", F.col("qualified_name").alias("type"))
    return types.join(tops.select("id", "module"), "id").join(parents.select("id", "package"), "id").select("id", "kind", "module", F.coalesce("package", F.lit(NO_PACKAGE)).alias("package"), "type")


def path_rollup(graph: DependencyGraph) -> DataFrame:
    """``(level, module, package, type)`` with ``nodes_by_kind``, ``edges``, ``weight``, ``edges_by_attribute`` and
    ``weight_by_kind`` of the edges that leave each node's types, and ``crossing``, those into other modules.

    Types and edges are rows of one table, which one ROLLUP sums at all levels: combined before the shuffle, a row for each
    type and task at most, instead of a join of every type with its ancestors.
    """
    types = located(graph)
    kinds = [k for k in SCOPE_TYPE_KINDS]
    nothing = F.lit(0).cast("long")
    path = ["module", "package", "type"]
    measures = [*[_column("n_", k) for k in kinds], "edges", "weight", "crossing", *[_column("a_", name) for _, name in EDGE_ATTRIBUTES], *[_column("k_", k) for k in COUNTED_KINDS]]

    def rows(frame: DataFrame, **known) -> DataFrame:
        return frame.select(*path, *[known.get(m, nothing).cast("long").alias(m) for m in measures])

    node_rows = rows(types, **{_column("n_", k): (F.col("kind") == k).cast("int") for k in kinds})
    ends = graph.edges.join(types.select(F.col("id").alias("from_id"), *path), "from_id").join(types.select(F.col("id").alias("to_id"), F.col("module").alias("other")), "to_id")
    counted = {f"a_{name}": bit_is_set(F.col("attrs"), at).cast("int") for at, name in EDGE_ATTRIBUTES} | {f"k_{k}": F.coalesce(F.try_element_at("kinds", F.lit(k)), F.lit(0)) for k in COUNTED_KINDS}
    edge_rows = rows(ends, edges=F.lit(1), weight=F.col("weight"), crossing=(F.col("module") != F.col("other")).cast("int"), **counted)
    summed = node_rows.unionByName(edge_rows).rollup(*path).agg(F.grouping_id().alias("gid"), *[F.sum(m).alias(m) for m in measures])
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS[::-1]]), F.bit_count("gid") + 1)
    positive = lambda prefix, names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(_column(prefix, n)))]), lambda _, v: v > 0)
    return summed.select(
        level.alias("level"), *path, positive("n_", kinds).alias("nodes_by_kind"), "edges", "weight", "crossing", positive("a_", [n for _, n in EDGE_ATTRIBUTES]).alias("edges_by_attribute"), positive("k_", COUNTED_KINDS).alias("weight_by_kind")
    )
