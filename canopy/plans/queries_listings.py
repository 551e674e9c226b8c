"""Queries on listings with summaries, pages and paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions.names import handle_of
from canopy.operators import listings
from canopy.plans.oracle import TRADE, sequence, with_, with_recursive
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.sources import testdata as td

_INTO = "SELECT c_fqn AS from_name, s_fqn AS to_name, weight, attrs FROM e WHERE s_region = 'ASIA'"


@register("incoming_pages", f"{with_(TRADE)} {_INTO} ORDER BY to_name, from_name LIMIT 60")
def incoming_pages(spark, sf_dir):
    """The first three pages of a listing, each behind the cursor of the one before."""
    listing = listings.dependency_listing(td.trade_graph(spark, sf_dir), to_id=handle_of("ASIA"), incoming=True)
    rows = cursor = None
    for _ in range(3):
        page = listing.page(20, cursor)
        rows, cursor = page.rows if rows is None else rows.unionByName(page.rows), page.next_cursor
    return rows.select("from_name", "to_name", "weight", "attrs")


@register("listing_summaries", f"""{with_(TRADE)}, l AS ({_INTO}), t AS (SELECT to_name AS name, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM l GROUP BY 1), s AS (SELECT from_name AS name, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM l GROUP BY 1)
(SELECT 'target' AS summary, name, n, weight, greatest((SELECT count(*) FROM t) - 10, 0) AS others FROM t ORDER BY n DESC, name LIMIT 10) UNION ALL (SELECT 'source', name, n, weight, greatest((SELECT count(*) FROM s) - 10, 0) FROM s ORDER BY n DESC, name LIMIT 10)
UNION ALL SELECT 'attribute', a, count(*) FILTER ((attrs >> p) & 1 = 1), NULL, NULL FROM l, (VALUES ('is_extends', 0), ('is_implements', 1), ('is_annotated_by', 2), ('is_depends_on_other', 3)) v(a, p) GROUP BY a
UNION ALL SELECT 'kind', kind, NULL, count(*), NULL FROM f WHERE s_region = 'ASIA' GROUP BY kind""")
def listing_summaries(spark, sf_dir):
    """Top sources and targets, attributes and kinds over all rows of a listing."""
    listing = listings.dependency_listing(td.trade_graph(spark, sf_dir), to_id=handle_of("ASIA"), incoming=True)
    none = F.lit(None).cast("long")
    of = lambda what, by: listing.top(by).select(F.lit(what).alias("summary"), F.col(by).alias("name"), "n", "weight", "others")
    out = of("target", "to_name").unionByName(of("source", "from_name"))
    out = out.unionByName(listing.by_attribute().select(F.lit("attribute").alias("summary"), F.col("attribute").alias("name"), F.col("edges").alias("n"), none.alias("weight"), none.alias("others")))
    return out.unionByName(listing.by_kind().select(F.lit("kind").alias("summary"), F.col("kind").alias("name"), none.alias("n"), F.col("weight").cast("long").alias("weight"), none.alias("others")))


_REACHED = f"""{with_recursive(sequence(), "b0 AS (SELECT min(a_package) AS p FROM g)", "r AS (SELECT DISTINCT fqn AS node, 0 AS d FROM pt, b0 WHERE package = p UNION SELECT g.a, r.d + 1 FROM r JOIN g ON g.b = r.node WHERE r.d < 2)")},
m AS (SELECT node, min(d) AS d FROM r GROUP BY 1)"""


@register("affected_page", f"{_REACHED} SELECT CAST(d AS INTEGER) AS distance, node, 1 + d AS path_length FROM m WHERE d > 0 ORDER BY 1, 2 LIMIT 100")
def affected_page(spark, sf_dir):
    """The nearest hundred parts that depend on the first package in at most two steps, and how long their paths are."""
    g = td.sequence_graph(spark, sf_dir)
    package = g.nodes.where("kind = 'java.package'").join(g.edges.join(g.tree, F.col("from_id") == F.col("node_id")).select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi").orderBy("qualified_name").first()
    listing, reached = listings.affected_listing(g, package["id"], max_depth=2, kinds=["types"])
    rows = listings.with_paths(listing.page(100).rows, reached)
    return named(rows.select("id", "distance", F.size("path").cast("long").alias("path_length")), g.nodes, node="id").select("distance", "node", "path_length")
