"""Queries on order, cycles and reachability."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import aggregate as agg
from canopy.operators import ordering, reach
from canopy.plans.oracle import TRADE, handle, sequence, with_, with_recursive
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.schema import MODULE, PACKAGE
from canopy.sources import testdata as td

def _ids(g, kind):
    return [r["id"] for r in g.nodes.where(F.col("kind") == kind).select("id").orderBy("id").collect()]


_PART_ID = lambda brand, fqn: handle(f"'type:' || length({brand}) || ':' || {brand} || ':' || {fqn}")
_WHOLE = sequence()
#: Rows of (node, distance): one for each level a node is met on; no shortest path of these graphs is as long as the bound.
_LEVELS = lambda here, there: "r AS (SELECT DISTINCT fqn AS node, 0 AS d FROM pt WHERE p_brand = 'Brand#1' UNION SELECT " + f"g.{there}, d + 1 FROM r JOIN g ON g.{here} = node WHERE d < 40)"


@register("dependency_paths", f"""{with_(_WHOLE)} SELECT a || ' > ' || b AS path, 1 AS length, CAST(weight AS BIGINT) AS weight FROM g WHERE a_brand = 'Brand#1' AND b_brand = 'Brand#2' ORDER BY weight DESC, {_PART_ID("a_brand", "a")}, {_PART_ID("b_brand", "b")} LIMIT 5""")
def dependency_paths(spark, sf_dir):
    """Best paths of any length between two brands, with names."""
    from canopy.functions.names import handle_of

    g = td.sequence_graph(spark, sf_dir)
    rows = reach.dependency_paths(g, handle_of("Brand#1"), handle_of("Brand#2"), 5)
    steps = rows.select(F.concat_ws(">", F.col("path").cast("array<string>")).alias("p"), "length", "weight", F.posexplode("path").alias("at", "id"))
    return steps.join(g.nodes.select("id", "qualified_name"), "id").groupBy("p", "length", "weight").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "qualified_name"))), lambda x: x["qualified_name"]), " > ").alias("path")).select("path", "length", "weight")


@register("strong_components", f"""{with_recursive(_WHOLE, "r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)")}, c AS (SELECT x.a, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1), s AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS components FROM s WHERE size > 1 GROUP BY 1""")
def strong_components(spark, sf_dir):
    """How many cycles of each size the sequence graph has."""
    g = td.sequence_graph(spark, sf_dir)
    sizes = ordering.strong_components(g.edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.where("size > 1").groupBy("size").agg(F.count(F.lit(1)).alias("components"))


@register("subtypes", f"{with_(TRADE)} SELECT DISTINCT c_fqn AS node, 1 AS distance FROM e WHERE s_region = 'ASIA' AND attrs & 3 > 0")
def subtypes(spark, sf_dir):
    """Types that extend or implement a type of one region."""
    from canopy.functions.names import handle_of

    g = td.trade_graph(spark, sf_dir)
    found = reach.supertypes(g, g.scope_types([handle_of("ASIA")]).where(F.lit(True)).select("id").join(g.nodes.where("kind = 'java.interface'").select("id"), "id", "left_semi"), down=True)
    return named(found, g.nodes, node="id").select("node", "distance")


def _order(kind):
    def query(spark, sf_dir):
        g = td.trade_graph(spark, sf_dir)
        return named(ordering.matrix_order(g, _ids(g, kind)), g.nodes, node="id").select("node", "position", "cycle")

    return query


register("matrix_order_regions")(_order(MODULE))
register("matrix_order_nations")(_order(PACKAGE))


@register("pairwise_in_order", None)
def pairwise_in_order(spark, sf_dir):
    """Region pairs with the positions of their ends in the matrix."""
    g = td.trade_graph(spark, sf_dir)
    rows = ordering.pairwise_dependencies(g, _ids(g, MODULE))
    return named(rows, g.nodes, from_node="i", to_node="j").select("from_node", "to_node", "at_i", "at_j", "weight", "type_pairs", "attrs")


@register("mutual_dependencies", f"{with_(TRADE)}, p AS (SELECT c_nation AS i, s_nation AS j, CAST(sum(weight) AS BIGINT) AS w FROM e WHERE c_nation <> s_nation GROUP BY 1, 2) SELECT x.i AS a, x.j AS b, x.w AS weight_ab, y.w AS weight_ba FROM p x JOIN p y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j")
def mutual_dependencies(spark, sf_dir):
    """Pairs of nations that depend on each other."""
    g = td.trade_graph(spark, sf_dir)
    cells = named(agg.pairwise(g, groups=agg.subtree_groups(g, PACKAGE)), g.nodes, a="i", b="j").select("a", "b", "weight")
    back = cells.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").alias("weight_ba"))
    return cells.withColumnRenamed("weight", "weight_ab").join(back, ["a", "b"]).where("a < b").select("a", "b", "weight_ab", "weight_ba")


@register("brand_levels", f"""{with_recursive(_WHOLE, "h AS (SELECT DISTINCT a_brand AS a, b_brand AS b FROM g)", "r AS (SELECT p_brand AS a, p_brand AS b FROM part UNION SELECT r.a, h.b FROM r JOIN h ON r.b = h.a)", "c AS (SELECT x.a AS node, min(x.b) AS core FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)", "d AS (SELECT DISTINCT x.core AS a, y.core AS b FROM h JOIN c x ON h.a = x.node JOIN c y ON h.b = y.node WHERE x.core <> y.core)", "l AS (SELECT core, 0 AS k FROM c UNION SELECT d.a, k + 1 FROM l JOIN d ON d.b = l.core)")} SELECT node, CAST(max(k) AS INTEGER) AS level FROM c JOIN l USING (core) GROUP BY 1""")
def brand_levels(spark, sf_dir):
    """Levels of brands in the sequence graph."""
    g = td.sequence_graph(spark, sf_dir)
    ids = _ids(g, MODULE)
    found = ordering.levels(ordering.matrix_of(g, ids))
    return named(spark.createDataFrame(list(zip(ids, found, strict=True)), "id long, level int"), g.nodes, node="id").select("node", "level")


@register("affected_by", f"{with_recursive(_WHOLE, _LEVELS('b', 'a'))} SELECT node, CAST(min(d) AS INTEGER) AS distance FROM r GROUP BY 1 HAVING min(d) > 0")
def affected_by(spark, sf_dir):
    """Everything that depends on a brand's parts, with its distance."""
    from canopy.functions.names import handle_of

    g = td.sequence_graph(spark, sf_dir)
    return named(reach.affected(g, handle_of("Brand#1")).select("id", "distance"), g.nodes, node="id").select("node", "distance")


@register("depends_on_by_distance", f"{with_recursive(_WHOLE, _LEVELS('a', 'b'))}, m AS (SELECT node, CAST(min(d) AS INTEGER) AS distance FROM r GROUP BY 1) SELECT distance, count(*) AS n FROM m WHERE distance > 0 GROUP BY 1")
def depends_on_by_distance(spark, sf_dir):
    from canopy.functions.names import handle_of

    g = td.sequence_graph(spark, sf_dir)
    return reach.distances(reach.affected(g, handle_of("Brand#1"), incoming=False))


@register("source_counts", f"""{with_recursive(_WHOLE, "o AS (SELECT fqn FROM pt WHERE p_brand = 'Brand#1')", "q AS (SELECT * FROM g WHERE a NOT IN (SELECT fqn FROM o))", "r AS (SELECT fqn AS source, fqn AS node, 0 AS d FROM o UNION SELECT source, q.a, d + 1 FROM r JOIN q ON q.b = node WHERE d < 3)")} SELECT node, count(DISTINCT source) AS sources FROM r WHERE d > 0 GROUP BY 1""")
def source_counts(spark, sf_dir):
    """How many of a brand's parts reach each dependent within three steps."""
    return _source_counts(spark, sf_dir, 3)


@register("source_counts_any_length", f"""{with_recursive(_WHOLE, "o AS (SELECT fqn FROM pt WHERE p_brand = 'Brand#1')", "q AS (SELECT * FROM g WHERE a NOT IN (SELECT fqn FROM o))", "r AS (SELECT fqn AS source, fqn AS node FROM o UNION SELECT source, q.a FROM r JOIN q ON q.b = node)")} SELECT node, count(*) AS sources FROM r WHERE node NOT IN (SELECT fqn FROM o) GROUP BY 1""")
def source_counts_any_length(spark, sf_dir):
    """How many of a brand's parts reach each dependent by paths of any length."""
    return _source_counts(spark, sf_dir, None)


def _source_counts(spark, sf_dir, max_depth):
    from canopy.functions.names import handle_of

    g = td.sequence_graph(spark, sf_dir)
    found = reach.source_counts(g, g.scope_types([handle_of("Brand#1")]).select("id"), max_depth=max_depth)
    return named(found, g.nodes, node="id").select("node", "sources")


@register("best_paths")
def best_paths(spark, sf_dir):
    """The best paths of any length from one brand to another, by length and weight."""
    from canopy.functions.names import handle_of

    g = td.sequence_graph(spark, sf_dir)
    return reach.dependency_paths(g, handle_of("Brand#1"), handle_of("Brand#2"), 20).groupBy("length", "weight").agg(F.count(F.lit(1)).alias("n"))
