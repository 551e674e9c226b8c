"""The containment tree over a graph, and what is asked of it.

``closure(ancestor, descendant, depth)`` holds every node with itself (depth 0) and its ancestors.  Containment is a few
levels deep, so it has a few rows for each node, and a question about subtrees is an equi-join with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.plans.materialize import stage_table
from canopy.schema import PACKAGE, SCOPE_TYPE_KINDS, TYPE_KINDS



def child_order(prefix: str = "") -> list[Column]:
    name = F.col(f"{prefix}qualified_name")
    return [F.lower(name), name, F.col(f"{prefix}id")]


def build_closure(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Ancestor closure of ``tree(node_id, parent_id)``; with ``max_depth`` one lazy plan, else levels until none is left."""
    step = tree.where("parent_id IS NOT NULL").select(F.col("node_id").alias("child"), "parent_id")
    level = tree.select(F.col("node_id").alias("ancestor"), F.col("node_id").alias("descendant"), F.lit(0).alias("depth"))
    out = level
    depth = 0
    while max_depth is None or depth < max_depth:
        level = level.join(step, level["ancestor"] == step["child"]).select(F.col("parent_id").alias("ancestor"), "descendant", (F.col("depth") + 1).alias("depth"))
        depth += 1
        if max_depth is None:
            level = stage_table(level)
            if level.isEmpty():
                break
        out = out.unionByName(level)
    return out


@dataclass(frozen=True)
class DependencyGraph:
    """``nodes(id, key, kind, name, qualified_name, modifiers)``, ``tree(node_id, parent_id)``, ``edges(from_id, to_id,
    weight, attrs, kinds)`` and the references behind the edges.  Immutable: a changed hierarchy is a new value that shares
    the rest."""

    nodes: DataFrame
    tree: DataFrame
    edges: DataFrame
    references: DataFrame | None = None
    max_depth: int | None = None
    extensions: dict = field(default_factory=dict)
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    # --- construction and change

    def closure(self) -> DataFrame:
        if "closure" not in self._cache:
            self._cache["closure"] = build_closure(self.tree, self.max_depth)
        return self._cache["closure"]

    def fork(self, tree: DataFrame | None = None, nodes: DataFrame | None = None, max_depth: int | None = None) -> DependencyGraph:
        """The same edges under another tree (and other nodes)."""
        extensions = {k: v for k, v in self.extensions.items() if k != "paths"}
        return replace(self, tree=self.tree if tree is None else tree, nodes=self.nodes if nodes is None else nodes, max_depth=max_depth if max_depth is not None else self.max_depth, extensions=extensions, _cache={})

    def staged(self, edges: bool = True) -> DependencyGraph:
        """The graph with nodes, tree, edges and closure written once: one generation.  Without ``edges`` these are left to be
        computed where they are asked for."""
        from canopy.operators import ingest

        edges = stage_table(self.edges) if edges else self.edges
        if (paths := self.extensions.get("paths")) is not None:
            # Nodes with their paths are computed once; tree and closure are projections of what was written.
            paths = stage_table(paths)
            return replace(self, nodes=paths.drop("path"), tree=ingest.tree_of(paths), edges=edges, references=None, extensions={**self.extensions, "paths": paths}, _cache={"closure": stage_table(ingest.closure_of(paths))})
        closure = stage_table(self.closure())
        return replace(self, nodes=stage_table(self.nodes), tree=stage_table(self.tree), edges=edges, references=None, extensions=dict(self.extensions), _cache={"closure": closure})

    def moved(self, node_ids: Sequence[int], to: int) -> DependencyGraph:
        """Nodes under another parent; refused if the parent lies inside one of them."""
        inside = self.closure().where(F.col("ancestor").isin(*node_ids) & (F.col("descendant") == to))
        if not inside.isEmpty():
            raise QueryError("INVALID_PARAMETER", "a node cannot be moved into its own subtree")
        parent = F.when(F.col("node_id").isin(*node_ids), F.lit(to)).otherwise(F.col("parent_id"))
        return self.fork(tree=self.tree.withColumn("parent_id", parent))

    def with_local_node(self, node_id: int, key: str, kind: str, name: str, parent: int) -> DependencyGraph:
        """One more node; refused if its id is taken."""
        spark = self.nodes.sparkSession
        if not self.nodes.where(F.col("id") == node_id).isEmpty():
            raise QueryError("INVALID_PARAMETER", f"id {node_id} is taken")
        row = spark.createDataFrame([(node_id, key, kind, name, name, 0)], self.nodes.select("id", "key", "kind", "name", "qualified_name", "modifiers").schema)
        place = spark.createDataFrame([(node_id, parent)], self.tree.select("node_id", "parent_id").schema)
        return self.fork(tree=self.tree.unionByName(place), nodes=self.nodes.unionByName(row))

    def without_leaf(self, node_id: int) -> DependencyGraph:
        """The graph without a leaf and its dependencies."""
        if not self.tree.where(F.col("parent_id") == node_id).isEmpty():
            raise QueryError("INVALID_PARAMETER", "only a leaf can be removed")
        out = self.fork(tree=self.tree.where(F.col("node_id") != node_id), nodes=self.nodes.where(F.col("id") != node_id))
        return replace(out, edges=self.edges.where((F.col("from_id") != node_id) & (F.col("to_id") != node_id)), _cache={})

    # --- navigation

    def parent_of(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.tree, ids["id"] == self.tree["node_id"]).select("id", "parent_id")

    def children_of(self, node_id: int) -> DataFrame:
        kids = self.tree.where(F.col("parent_id") == node_id).select(F.col("node_id").alias("id"))
        return self.nodes.join(kids, "id", "left_semi").orderBy(*child_order())

    def ancestors_of(self, node_id: int) -> DataFrame:
        """Strict ancestors, nearest first, with ``depth``."""
        up = self.closure().where((F.col("descendant") == node_id) & (F.col("depth") > 0)).select(F.col("ancestor").alias("id"), "depth")
        return self.nodes.join(up, "id").orderBy("depth")

    def descendants_of(self, seeds: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
        """Strict descendants of ``seeds(id)``, each once; a kind filters but does not prune."""
        down = self.closure().where("depth > 0").join(seeds.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
        out = self.nodes.join(down, "id", "left_semi")
        return out.where(F.col("kind").isin(*kinds)) if kinds else out

    def pre_order(self, node_id: int) -> DataFrame:
        """Strict descendants in pre-order with ``depth`` and the ``path`` that orders them."""
        down = self.closure().where((F.col("ancestor") == node_id) & (F.col("depth") > 0)).select("descendant", F.col("depth").alias("level"))
        inner = self.closure().join(down, "descendant").where("depth < level")
        step = F.struct((F.col("level") - F.col("depth")).alias("at"), F.lower("qualified_name").alias("x"), F.col("qualified_name").alias("y"), F.col("id").alias("z"))
        paths = inner.join(self.nodes.select("id", "qualified_name"), F.col("ancestor") == F.col("id")).groupBy("descendant").agg(F.max("level").alias("depth"), F.sort_array(F.collect_list(step)).alias("path"))
        return self.nodes.join(paths, self.nodes["id"] == paths["descendant"]).drop("descendant").orderBy("path")

    def traverse(self, node_id: int, keep: Column) -> DataFrame:
        """Descendants reached only through nodes for which ``keep`` holds: a failing node prunes its subtree."""
        blocked = self.nodes.where(~keep).select("id")
        down = self.closure().where((F.col("ancestor") == node_id) & (F.col("depth") > 0)).select(F.col("descendant").alias("id"), F.col("depth").alias("level"))
        cut = self.closure().join(blocked.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").join(down.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
        return self.nodes.join(down.join(cut, "id", "left_anti"), "id")

    def top_of(self, kind: str | None = None) -> DataFrame:
        """``(id, top)``: the child of the root above (or at) each node."""
        roots = self.tree.where("parent_id IS NULL").select(F.col("node_id").alias("root"))
        tops = self.tree.join(roots, F.col("parent_id") == F.col("root"), "left_semi").select(F.col("node_id").alias("ancestor"))
        return self.closure().join(tops, "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.col("ancestor").alias("top"))

    def within(self, ids: DataFrame, anchors: DataFrame) -> DataFrame:
        """Those of ``ids(id)`` that lie in the subtree of an anchor, itself included."""
        inside = self.closure().join(anchors.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
        return ids.join(inside, "id", "left_semi")

    def child_containing(self, parent: int, ids: DataFrame) -> DataFrame:
        """``(id, child)``: which child of ``parent`` holds each node."""
        kids = self.tree.where(F.col("parent_id") == parent).select(F.col("node_id").alias("ancestor"))
        held = self.closure().join(kids, "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.col("ancestor").alias("child"))
        return ids.join(held, "id")

    def expanded(self, ids: DataFrame, how: str = "SELF") -> DataFrame:
        """A set with its children or all its descendants: SELF, SELF_AND_CHILDREN, SELF_AND_SUCCESSORS."""
        most = {"SELF": 0, "SELF_AND_CHILDREN": 1, "SELF_AND_SUCCESSORS": None}[how]
        down = self.closure() if most is None else self.closure().where(F.col("depth") <= most)
        return down.join(ids.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()

    def with_ancestors(self, ids: DataFrame) -> DataFrame:
        """Each node and its ancestors, once, without the root's absent parent."""
        return self.closure().join(ids.select(F.col("id").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("id")).distinct()

    def lowest_common_ancestor(self, pairs: DataFrame) -> DataFrame:
        """``(a, b, ancestor)`` for pairs of nodes: the deepest node above both."""
        up_a = self.closure().select(F.col("descendant").alias("a"), "ancestor", F.col("depth").alias("da"))
        up_b = self.closure().select(F.col("descendant").alias("b"), "ancestor", F.col("depth").alias("db"))
        return pairs.join(up_a, "a").join(up_b, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", F.col("da") + F.col("db")).alias("ancestor"))

    # --- counts

    def descendant_counts(self) -> DataFrame:
        """``(id, descendants, types, methods, fields, packages)`` of every node."""
        kinds = self.nodes.select(F.col("id").alias("descendant"), "kind")
        of = lambda *k: F.count_if(F.col("kind").isin(*k))
        counts = self.closure().where("depth > 0").join(kinds, "descendant").groupBy(F.col("ancestor").alias("id")).agg(
            F.count(F.lit(1)).alias("descendants"), of(*SCOPE_TYPE_KINDS).alias("types"), of("java.method").alias("methods"), of("java.field").alias("fields"), of(PACKAGE).alias("packages")
        )
        return self.nodes.select("id").join(counts, "id", "left").na.fill(0)

    def scope_types(self, node_ids: Sequence[int]) -> DataFrame:
        """``(id, scope)``: types, external ones included, at or below each node."""
        types = self.nodes.where(F.col("kind").isin(*SCOPE_TYPE_KINDS)).select("id")
        down = self.closure().where(F.col("ancestor").isin(*node_ids)).select(F.col("descendant").alias("id"), F.col("ancestor").alias("scope"))
        return down.join(types, "id", "left_semi")

    # --- nested types

    def nested(self, direct: bool = False) -> DataFrame:
        """``(outer, inner)`` of types nested by ``$`` among siblings; ``direct`` leaves out deeper, anonymous, local ones.

        A type is paired with the siblings whose names are its own name's prefixes before each ``$``: an equi-join.
        """
        types = self.nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("id", "name").join(self.tree.select(F.col("node_id").alias("id"), "parent_id"), "id")
        parts = F.split("name", r"\$")
        outers = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "$"))
        inner = types.where("instr(name, '$') > 0").select(F.col("id").alias("inner"), "parent_id", F.col("name").alias("inner_name"), F.explode(outers).alias("name"))
        out = inner.join(types.withColumnRenamed("id", "outer"), ["parent_id", "name"])
        if direct:
            rest = F.expr("substring(inner_name, length(name) + 2)")
            out = out.where((rest != "") & (F.instr(rest, "$") == 0) & ~rest.rlike(r"^\d"))
        return out.select("outer", "inner")

    def enclosing(self) -> DataFrame:
        """``(inner, outer)``: the sibling named as a type up to its last ``$``."""
        types = self.nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("id", "name").join(self.tree.select(F.col("node_id").alias("id"), "parent_id"), "id")
        inner = types.where("instr(name, '$') > 0").select(F.col("id").alias("inner"), "parent_id", F.regexp_extract("name", r"^(.*)\$[^$]*$", 1).alias("name"))
        return inner.join(types.withColumnRenamed("id", "outer"), ["parent_id", "name"]).select("inner", "outer")


def dump_tree(graph: DependencyGraph, node_id: int) -> DataFrame:
    """Indented lines of a subtree in pre-order: ``(line)``."""
    return graph.pre_order(node_id).select(F.concat(F.expr("repeat('  ', depth - 1)"), F.col("name")).alias("line"))
