"""Dependencies between subtrees: matrices, pairs, summaries, listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators.hierarchy import DependencyGraph
from canopy.schema import EDGE_ATTRIBUTES, MEMBER_KINDS, PACKAGE, SCOPE_TYPE_KINDS

MOST_PAIRS = 2500


def accumulated(graph: DependencyGraph, node_id: int, outgoing: bool = True) -> DataFrame:
    """All edges from (or to) a node and its descendants, inner ones included, as often as they occur."""
    side = "from_id" if outgoing else "to_id"
    below = graph.closure().where(F.col("ancestor") == node_id).select(F.col("descendant").alias(side))
    return graph.edges.join(below, side, "left_semi")


def buckets(graph: DependencyGraph, node_ids: Sequence[int]) -> DataFrame:
    """``(id, bucket)``: the selected node above each node; where selected nodes nest, the later one in the list."""
    place = F.array_position(F.array(*[F.lit(int(i)) for i in node_ids]), F.col("ancestor"))
    return graph.closure().where(F.col("ancestor").isin(*[int(i) for i in node_ids])).groupBy(F.col("descendant").alias("id")).agg(F.max_by("ancestor", place).alias("bucket"))


def bucketed_edges(graph: DependencyGraph, from_buckets: DataFrame, to_buckets: DataFrame | None = None) -> DataFrame:
    """Edges with the buckets of their ends, ``i`` and ``j``."""
    to_buckets = from_buckets if to_buckets is None else to_buckets
    return graph.edges.join(from_buckets.select(F.col("id").alias("from_id"), F.col("bucket").alias("i")), "from_id").join(to_buckets.select(F.col("id").alias("to_id"), F.col("bucket").alias("j")), "to_id")


def adjacency(graph: DependencyGraph, node_ids: Sequence[int]) -> DataFrame:
    """``(i, j, weight)`` between selected subtrees, the diagonal included.

    A source counts for every selected node above it, a target for the last one of the list.
    """
    sources = graph.closure().where(F.col("ancestor").isin(*[int(i) for i in node_ids])).select(F.col("descendant").alias("id"), F.col("ancestor").alias("bucket"))
    return bucketed_edges(graph, sources, buckets(graph, node_ids)).groupBy("i", "j").agg(F.sum("weight").alias("weight"))


def adjacency_list(graph: DependencyGraph, node_ids: Sequence[int]) -> DataFrame:
    """``(at, targets)``: for each selected node, by its place in the list, the places it depends on, ascending."""
    place = lambda c: (F.array_position(F.array(*[F.lit(int(i)) for i in node_ids]), F.col(c)) - 1).cast("int")
    cells = adjacency(graph, node_ids).where("weight > 0").select(place("i").alias("at"), place("j").alias("to"))
    every = graph.edges.sparkSession.range(len(node_ids)).select(F.col("id").cast("int").alias("at"))
    listed = cells.groupBy("at").agg(F.sort_array(F.collect_list("to")).alias("targets"))  # at most one entry for each selected node
    return every.join(listed, "at", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<int>")))


def overview(graph: DependencyGraph) -> DataFrame:
    """One row for each top node: ``id, name, packages, types, inner_weight, outgoing_weight, incoming_weight, depends_on,
    used_by``, heaviest dependants first; a page is taken by :func:`canopy.operators.search.page`."""
    tops = graph.top_of()
    sizes = graph.nodes.where(F.col("kind") != "root").join(tops, "id").groupBy("top").agg(F.count_if(F.col("kind") == PACKAGE).alias("packages"), F.count_if(F.col("kind").isin(*SCOPE_TYPE_KINDS)).alias("types"))
    cells = bucketed_edges(graph, tops.withColumnRenamed("top", "bucket")).groupBy("i", "j").agg(F.sum("weight").alias("weight"))
    inner = cells.where("i = j").select(F.col("i").alias("top"), F.col("weight").alias("inner_weight"))
    side = lambda own, other, weight, many: cells.where("i <> j").groupBy(F.col(own).alias("top")).agg(F.sum("weight").alias(weight), F.count(other).alias(many))
    out = sizes.join(inner, "top", "left").join(side("i", "j", "outgoing_weight", "depends_on"), "top", "left").join(side("j", "i", "incoming_weight", "used_by"), "top", "left")
    named = graph.nodes.select(F.col("id").alias("top"), "name").join(out.na.fill(0), "top").withColumnRenamed("top", "id")
    return named.orderBy(F.col("incoming_weight").desc(), "name")


def pairwise(graph: DependencyGraph, node_ids: Sequence[int] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """``(i, j, weight, type_pairs, attrs)`` off the diagonal.  Selected by ids or by a table ``groups(id, bucket)``.

    Edges are one for each pair of types, so a count of edges is the count of type pairs and no distinct is needed.
    """
    groups = buckets(graph, node_ids) if groups is None else groups
    cells = bucketed_edges(graph, groups).where("i <> j")
    return cells.groupBy("i", "j").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("type_pairs"), F.bit_or("attrs").alias("attrs")).where("weight > 0")


def subtree_groups(graph: DependencyGraph, kind: str) -> DataFrame:
    """``(id, bucket)`` by the ancestor of a kind: modules or packages that do not nest."""
    tops = graph.nodes.where(F.col("kind") == kind).select(F.col("id").alias("ancestor"))
    return graph.closure().join(tops, "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.col("ancestor").alias("bucket"))


def aggregated_pairs(graph: DependencyGraph, sources: Sequence[int], targets: Sequence[int]) -> DataFrame:
    """``(source, target, weight, type_pairs, attrs)`` for all given pairs that depend; subtrees may nest."""
    sources, targets = list(dict.fromkeys(sources)), list(dict.fromkeys(targets))
    if len(sources) * len(targets) > MOST_PAIRS:
        raise QueryError("INPUT_TOO_LARGE", f"at most {MOST_PAIRS} pairs", "ask for fewer nodes")
    up = graph.closure().select(F.col("descendant").alias("id"), F.col("ancestor").alias("bucket"))
    cells = bucketed_edges(graph, up.where(F.col("bucket").isin(*sources)), up.where(F.col("bucket").isin(*targets)))
    return cells.groupBy(F.col("i").alias("source"), F.col("j").alias("target")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("type_pairs"), F.bit_or("attrs").alias("attrs"))


def kinds_of(edges: DataFrame, *by: str | Column) -> DataFrame:
    """Weight by dependency kind, by further columns if given."""
    return edges.select(*by, F.explode("kinds").alias("kind", "n")).groupBy(*[b if isinstance(b, str) else b for b in by], "kind").agg(F.sum("n").alias("weight"))


def attribute_counts(edges: DataFrame) -> DataFrame:
    """``(attribute, edges)`` for each edge attribute."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("attribute"), (F.shiftright("attrs", position).bitwiseAND(F.lit(1)) == 1).alias("on")) for position, name in EDGE_ATTRIBUTES])).alias("a")
    return edges.select(rows).groupBy("a.attribute").agg(F.count_if("a.on").alias("edges"))


def density(edges: DataFrame, n: int) -> DataFrame:
    """One row: edges between ``n`` nodes over possible ones, to two places half up."""
    possible = max(1, n * (n - 1))
    return edges.agg(F.round(F.count(F.lit(1)) / F.lit(float(possible)), 2).alias("density"))


def module_weights(graph: DependencyGraph) -> DataFrame:
    """``(from_module, to_module, weight)`` between different top-level modules."""
    top = graph.top_of()
    return bucketed_edges(graph, top.withColumnRenamed("top", "bucket")).where("i <> j").groupBy(F.col("i").alias("from_module"), F.col("j").alias("to_module")).agg(F.sum("weight").alias("weight"))


def boundary_counts(graph: DependencyGraph) -> DataFrame:
    """``(module, incoming, outgoing)``: edges that cross each top-level module's boundary."""
    crossing = bucketed_edges(graph, graph.top_of().withColumnRenamed("top", "bucket")).where("i <> j")
    ends = crossing.select(F.explode(F.array(F.struct(F.col("i").alias("module"), F.lit(1).alias("o")), F.struct(F.col("j").alias("module"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.module").agg(F.sum(1 - F.col("e.o")).alias("incoming"), F.sum("e.o").alias("outgoing"))


def split_packages(graph: DependencyGraph, types: DataFrame) -> DataFrame:
    """``(package, modules)``: package names with types in more than one module."""
    from canopy.functions.names import package_of

    return types.select(package_of(F.col("fqn")).alias("package"), "artifact").where("package <> ''").groupBy("package").agg(F.countDistinct("artifact").alias("modules")).where("modules > 1")


# --- listings at type level ---------------------------------------------------------------------------------------------


def dependencies_between(graph: DependencyGraph, from_id: int, to_id: int | None = None) -> DataFrame:
    """Edges from the types of one subtree (to those of another), with names, in the order of names."""
    named = graph.nodes.select("id", "qualified_name")
    edges = graph.edges.join(graph.scope_types([from_id]).select(F.col("id").alias("from_id")), "from_id", "left_semi")
    if to_id is not None:
        edges = edges.join(graph.scope_types([to_id]).select(F.col("id").alias("to_id")), "to_id", "left_semi")
    out = edges.join(named.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("from_name")), "from_id").join(named.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("to_name")), "to_id")
    return out.orderBy("from_name", "to_name", F.col("from_id").cast("string"), F.col("to_id").cast("string"))


def dependencies_into(graph: DependencyGraph, to_id: int, from_id: int | None = None) -> DataFrame:
    """Edges into the types of a subtree; they keep their direction."""
    if from_id is not None:
        return dependencies_between(graph, from_id, to_id)
    named = graph.nodes.select("id", "qualified_name")
    edges = graph.edges.join(graph.scope_types([to_id]).select(F.col("id").alias("to_id")), "to_id", "left_semi")
    out = edges.join(named.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("from_name")), "from_id").join(named.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("to_name")), "to_id")
    return out.orderBy("to_name", "from_name", F.col("to_id").cast("string"), F.col("from_id").cast("string"))


def top_by(edges: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """``(name, edges, weight)`` of the largest groups, heaviest first, ties by name."""
    return edges.groupBy(name).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")).orderBy(F.col("weight").desc(), name).limit(limit)


def referenced(graph: DependencyGraph, node_id: int, outgoing: bool = True) -> DataFrame:
    """``(id)``: distinct targets (sources) outside the node's own subtree."""
    other = "to_id" if outgoing else "from_id"
    own = graph.closure().where(F.col("ancestor") == node_id).select(F.col("descendant").alias("id"))
    return accumulated(graph, node_id, outgoing).select(F.col(other).alias("id")).distinct().join(own, "id", "left_anti")


def children_referencing(graph: DependencyGraph, parent: int, targets: Sequence[int], outgoing: bool = True) -> DataFrame:
    """``(id)``: children of ``parent`` with an edge to (from) one of the given subtrees."""
    near, far = ("from_id", "to_id") if outgoing else ("to_id", "from_id")
    inside = graph.closure().where(F.col("ancestor").isin(*targets)).select(F.col("descendant").alias(far)).distinct()
    ends = graph.edges.join(inside, far, "left_semi").select(F.col(near).alias("id")).distinct()
    return graph.child_containing(parent, ends).select(F.col("child").alias("id")).distinct()


def filtered_dependencies(graph: DependencyGraph, edges: DataFrame, sources: Sequence[int] | None = None, targets: Sequence[int] | None = None) -> DataFrame:
    """Edges whose ends lie in the selected subtrees; None selects all, an empty selection nothing."""
    for side, chosen in (("from_id", sources), ("to_id", targets)):
        if chosen is not None:
            inside = graph.closure().where(F.col("ancestor").isin(*chosen) if chosen else F.lit(False)).select(F.col("descendant").alias(side)).distinct()
            edges = edges.join(inside, side, "left_semi")
    return edges


def dependencies_by_id(graph: DependencyGraph, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Edges named ``from_to_type`` and the ids that name none."""
    spark = graph.edges.sparkSession
    if bad := [i for i in ids if len(i.split("_", 2)) < 3 or not all(p.lstrip("-").isdigit() for p in i.split("_", 2)[:2])]:
        raise QueryError("BAD_REQUEST", f"malformed dependency ids {bad}")
    asked = spark.createDataFrame([(i, int(i.split("_", 2)[0]), int(i.split("_", 2)[1])) for i in dict.fromkeys(ids)], "id string, from_id long, to_id long")
    found = asked.join(graph.edges, ["from_id", "to_id"])
    return found, asked.join(graph.edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").select("id")


def unknown_ids(graph: DependencyGraph, ids: Sequence[int]) -> DataFrame:
    asked = graph.nodes.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")
    return asked.join(graph.nodes.select("id"), "id", "left_anti")


def drill_down(graph: DependencyGraph, node_id: int, other_id: int | None = None, outgoing: bool = True) -> DataFrame:
    """Children ``(id, weight)`` of the first node at or below ``node_id`` that does not have exactly one container child;
    a type has no narrower scope.

    The chain of single containers is as long as the tree is deep at most; each step looks at one node's children.
    """
    at = node_id
    while True:
        kids = graph.children_of(at).where(~F.col("kind").isin(*MEMBER_KINDS)).select("id", "kind").limit(2).collect()
        if len(kids) != 1 or kids[0]["kind"] in SCOPE_TYPE_KINDS:
            break
        at = kids[0]["id"]
    edges = accumulated(graph, at, outgoing)
    if other_id is not None:
        edges = filtered_dependencies(graph, edges, targets=[other_id]) if outgoing else filtered_dependencies(graph, edges, sources=[other_id])
    near = "from_id" if outgoing else "to_id"
    held = graph.child_containing(at, edges.select(F.col(near).alias("id")).distinct())
    return edges.join(held, edges[near] == held["id"]).groupBy(F.col("child").alias("id")).agg(F.sum("weight").alias("weight")).where("weight > 0").orderBy(F.col("weight").desc(), "id")
