"""The structure map: dependencies between siblings of every container, their levels, tangles and feedback edges.

An edge between two types belongs to the deepest container above both and leads from one of its children to another, so
every container has a small graph of its own.  The graphs of all containers are worked on at once: children have one
parent each, so their graphs never meet.  Edges of nested nodes belong to no container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators import ordering
from canopy.operators.hierarchy import DependencyGraph
from canopy.plans.materialize import stage_table
from canopy.schema import PACKAGE


def sibling_edges(graph: DependencyGraph) -> DataFrame:
    """``(container, from_id, to_id, weight)``; edges between roots have a null container."""
    # A path has one entry for each level of the tree.
    paths = graph.closure().groupBy(F.col("descendant").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("path"))
    ends = graph.edges.where("from_id <> to_id").select("from_id", "to_id", "weight")
    ends = ends.join(paths.select(F.col("id").alias("from_id"), F.col("path").alias("a")), "from_id").join(paths.select(F.col("id").alias("to_id"), F.col("path").alias("b")), "to_id")
    shorter = F.least(F.size("a"), F.size("b"))
    shared = F.size(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"] == x["b"]))
    parted = ends.withColumns({"shared": shared, "shorter": shorter}).where("shared < shorter")
    container = F.when(F.col("shared") > 0, F.expr("a[shared - 1]"))
    return parted.groupBy(container.alias("container"), F.expr("a[shared]").alias("from_id"), F.expr("b[shared]").alias("to_id")).agg(F.sum("weight").cast("long").alias("weight"))


def tangles(siblings: DataFrame) -> DataFrame:
    """``(id, tangle)`` of children in a cycle of their container; a tangle is named by its least id."""
    return ordering.strong_components(siblings.select("from_id", "to_id")).withColumnRenamed("component", "tangle")


def structure_levels(graph: DependencyGraph, siblings: DataFrame | None = None, tangled: DataFrame | None = None) -> DataFrame:
    """``(id, container, level, tangle)`` of every node: the longest path below it among its siblings.

    A tangle has one level and is null where a node is in none.  Level 0 depends on no sibling.  Each round settles what
    only depends on settled nodes, so there are as many rounds as levels.
    """
    siblings = stage_table(sibling_edges(graph)) if siblings is None else siblings
    tangled = stage_table(tangles(siblings)) if tangled is None else tangled
    core = lambda name: tangled.select(F.col("id").alias(name), F.col("tangle").alias(f"{name}_tangle"))
    between = siblings.join(core("from_id"), "from_id", "left").join(core("to_id"), "to_id", "left")
    between = between.select(F.coalesce("from_id_tangle", "from_id").alias("a"), F.coalesce("to_id_tangle", "to_id").alias("b")).where("a <> b").distinct()
    left = stage_table(between)
    above, level = None, 0
    while not left.isEmpty():
        level += 1
        # What something is left below of is at least this high.
        waiting = stage_table(left.select("a").distinct())
        here = waiting.select(F.col("a").alias("core"), F.lit(level).alias("level"))
        above = here if above is None else above.unionByName(here)
        if level % 8 == 0:
            above = stage_table(above)
        left = stage_table(left.join(waiting.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))
    nodes = graph.tree.select(F.col("node_id").alias("id"), F.col("parent_id").alias("container")).join(tangled, "id", "left")
    if above is None:
        return nodes.select("id", "container", F.lit(0).alias("level"), "tangle")
    highest = above.groupBy("core").agg(F.max("level").alias("level"))
    return nodes.withColumn("core", F.coalesce("tangle", "id")).join(highest, "core", "left").select("id", "container", F.coalesce("level", F.lit(0)).alias("level"), "tangle")


def feedback_edges(siblings: DataFrame, tangled: DataFrame) -> DataFrame:
    """``(container, tangle, from_id, to_id, weight)``: edges of a tangle that lead up in its order of little upward weight.

    A tangle is ordered in one task; one of more than ``ordering.MOST_NODES`` members is refused.
    """
    large = tangled.groupBy("tangle").count().where(F.col("count") > ordering.MOST_NODES)
    if not large.isEmpty():
        raise QueryError("INPUT_TOO_LARGE", f"a tangle has more than {ordering.MOST_NODES} members", "change the selection")
    inside = siblings.join(tangled.select(F.col("id").alias("from_id"), "tangle"), "from_id").join(tangled.select(F.col("id").alias("to_id"), F.col("tangle").alias("other")), "to_id").where("tangle = other")

    def upward(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["from_id", "to_id"]].to_numpy())
        a, b = np.searchsorted(ids, rows["from_id"]), np.searchsorted(ids, rows["to_id"])
        matrix = np.zeros((len(ids), len(ids)), np.int64)
        matrix[a, b] = rows["weight"]
        place = np.empty(len(ids), np.int64)
        place[ordering.cycle_order(matrix)[0]] = np.arange(len(ids))
        return rows[place[a] > place[b]]

    rows = inside.select("container", "tangle", "from_id", "to_id", "weight")
    return rows.groupBy("tangle").applyInPandas(upward, "container long, tangle long, from_id long, to_id long, weight long")


def folded(graph: DependencyGraph) -> DependencyGraph:
    """The graph where a package whose only child is a package with children is one node with it, named by both."""
    kinds = graph.nodes.select("id", "kind")
    kids = graph.tree.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    packages = kinds.where(F.col("kind") == PACKAGE).select("id")
    single = kids.where("n = 1").join(packages.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("parent_id")
    lower = graph.tree.join(single, "parent_id", "left_semi").select(F.col("node_id").alias("id")).join(packages, "id", "left_semi").join(kids.select(F.col("parent_id").alias("id")), "id", "left_semi")
    absorbed = stage_table(lower)
    # The nearest node at or above that stays.
    staying = graph.closure().join(absorbed.select(F.col("id").alias("ancestor")), "ancestor", "left_anti")
    top = stage_table(staying.groupBy(F.col("descendant").alias("id")).agg(F.min_by("ancestor", "depth").alias("top"), F.min("depth").alias("below")))
    name = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("below", "name"))), lambda x: x["name"]), ".")
    names = top.join(graph.nodes.select("id", "name"), "id").groupBy(F.col("top").alias("id")).agg(name.alias("name"))
    nodes = graph.nodes.drop("name").join(names, "id").select(graph.nodes.columns)
    stays = graph.tree.join(absorbed.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    tree = stays.join(top.select(F.col("id").alias("parent_id"), "top"), "parent_id", "left").select(*[F.col("top").alias(c) if c == "parent_id" else F.col(c) for c in graph.tree.columns])
    return graph.fork(tree=tree, nodes=nodes)
