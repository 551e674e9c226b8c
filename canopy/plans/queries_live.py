"""Queries on graphs that are kept up to date, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.plans.oracle import TRADE, with_
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.sources import testdata as td
from canopy.streaming import maintenance


@register("maintained_edges", f"{with_(TRADE)} SELECT c_fqn AS from_type, s_fqn AS to_type, CAST(weight AS BIGINT) AS weight, attrs FROM e")
def maintained_edges(spark, sf_dir):
    """The edges after two modules changed, one after the other: first they had half their facts and fewer types."""
    types, facts = td.trade_types(spark, sf_dir), td.trade_dependencies(spark, sf_dir)
    early = F.col("artifact").isin("EUROPE", "ASIA")
    live = maintenance.start(types.where(~early | ~F.col("fqn").endswith("7")), facts.where(~early | (F.col("line") % 2 == 0)))
    for module in ("EUROPE", "ASIA"):
        own = F.col("artifact") == module
        live = maintenance.changed_modules(live, spark.createDataFrame([(module,)], "artifact string"), types.where(own), facts.where(own))
    rows = live.edges.select("from_id", "to_id", F.col("weight").cast("long").alias("weight"), "attrs")
    return named(rows, live.graph().nodes, from_type="from_id", to_type="to_id").select("from_type", "to_type", "weight", "attrs")
