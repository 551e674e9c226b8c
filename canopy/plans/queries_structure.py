"""Queries on the structure map."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.operators import structure
from canopy.plans.materialize import stage_table
from canopy.plans.oracle import NODES, TRADE, with_, with_recursive
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.sources import testdata as td

_SIDE = lambda x: f"CASE WHEN c_region <> s_region THEN {x}_region WHEN c_nation <> s_nation THEN {x}_nation ELSE {x}_fqn END"
_SIBLINGS = f"sib AS (SELECT CASE WHEN c_region <> s_region THEN '' WHEN c_nation <> s_nation THEN c_region ELSE c_nation END AS container, {_SIDE('c')} AS a, {_SIDE('s')} AS b, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY 1, 2, 3)"


@register("sibling_edges", f"{with_(TRADE, _SIBLINGS)} SELECT container, a AS from_node, b AS to_node, weight FROM sib")
def sibling_edges(spark, sf_dir):
    """Dependencies between the children of every container; the root has an empty name."""
    g = td.trade_graph(spark, sf_dir)
    rows = named(structure.sibling_edges(g), g.nodes, from_node="from_id", to_node="to_id")
    containers = g.nodes.select(F.col("id").alias("container"), F.col("qualified_name").alias("above"))
    return rows.join(containers, "container", "left").select(F.col("above").alias("container"), "from_node", "to_node", "weight")


@register("structure_levels", f"""{with_recursive(TRADE, NODES, _SIBLINGS, "r AS (SELECT qn AS a, qn AS b FROM nodes UNION SELECT r.a, sib.b FROM r JOIN sib ON r.b = sib.a)", "c AS (SELECT x.a AS node, min(x.b) AS core, count(*) AS tangle_size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1)", "d AS (SELECT DISTINCT x.core AS a, y.core AS b FROM sib JOIN c x ON sib.a = x.node JOIN c y ON sib.b = y.node WHERE x.core <> y.core)", "l AS (SELECT DISTINCT core, 0 AS k FROM c UNION SELECT d.a, k + 1 FROM l JOIN d ON d.b = l.core)")} SELECT node, CAST(max(k) AS INTEGER) AS level, CAST(any_value(tangle_size) AS BIGINT) AS tangle_size FROM c JOIN l USING (core) GROUP BY 1""")
def structure_levels(spark, sf_dir):
    """Level of every node below the root among its siblings, and how many nodes its tangle has."""
    g = td.trade_graph(spark, sf_dir)
    rows = stage_table(structure.structure_levels(g))
    sizes = rows.where("tangle IS NOT NULL").groupBy("tangle").agg(F.count(F.lit(1)).alias("size"))
    sized = rows.where("container IS NOT NULL").join(sizes, "tangle", "left").select("id", "level", F.coalesce("size", F.lit(1)).cast("long").alias("tangle_size"))
    return named(sized, g.nodes, node="id").select("node", "level", "tangle_size")


@register("structure_feedback")
def structure_feedback(spark, sf_dir):
    """Edges that lead up within the tangles of the sequence graph's brands and packages."""
    g = td.sequence_graph(spark, sf_dir)
    siblings = stage_table(structure.sibling_edges(g))
    rows = structure.feedback_edges(siblings, stage_table(structure.tangles(siblings)))
    return named(rows, g.nodes, from_node="from_id", to_node="to_id").select("from_node", "to_node", "weight")
