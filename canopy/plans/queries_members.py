"""Queries on member-level dependencies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions.names import handle_of
from canopy.operators import member_engine as engine
from canopy.plans.oracle import LIBRARY, handle, with_recursive
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.sources import testdata as td


def _detail_sql(own: str, target: str, select: str) -> str:
    """SQL over ``ans``, the rows from the scope ``own`` (its supertypes outside ``target`` included) into ``target``."""
    return f"""{with_recursive(LIBRARY)},
own AS (SELECT k FROM pk WHERE {own}), tgt AS (SELECT k FROM pk WHERE {target}),
src AS (SELECT k, false AS inherited FROM own UNION ALL SELECT DISTINCT a, true FROM anc WHERE k IN (FROM own) AND a NOT IN (FROM own) AND {"true" if target == "true" else "a NOT IN (FROM tgt)"}),
s AS (SELECT st.*, d.declared_key FROM st LEFT JOIN decl d ON d.t = st.t AND d.j = st.j WHERE st.f IN (SELECT k FROM src) AND st.t IN (FROM tgt)),
d AS (SELECT * FROM dv WHERE f IN (SELECT k FROM src) AND t IN (FROM tgt) AND NOT EXISTS (SELECT 1 FROM s WHERE s.from_key = dv.from_key AND s.declared_key = dv.to_key AND s.rel = dv.rel AND s.line IS NOT DISTINCT FROM dv.line)),
ans AS (SELECT f, from_key, t, to_key, declared_key, rel, line, false AS derived FROM s UNION ALL SELECT f, from_key, t, to_key, NULL, rel, line, true FROM d)
{select}"""


_ROWS = """SELECT from_key, to_key, coalesce(declared_key, to_key) AS declared_key, CASE WHEN declared_key IS NOT NULL THEN p.fqn END AS receiver, rel AS relationship, line, src.inherited, derived
 FROM ans JOIN src ON src.k = ans.f JOIN pk p ON p.k = ans.t"""


_FIRST, _LAST = ("artifact = (SELECT {}(artifact) FROM pk)".format(f) for f in ("min", "max"))


@register("detail_dependencies", _detail_sql(_FIRST, _LAST, _ROWS))
def detail_dependencies(spark, sf_dir):
    """Stored, dispatched, inherited and overriding members from the first brand, and what it inherits, into the last."""
    store = td.library_store(spark, sf_dir)
    first, last = store.types.agg(F.min("artifact"), F.max("artifact")).first()
    rows = engine.detail_dependencies(store, handle_of(first), handle_of(last)).rows
    receivers = store.graph.nodes.select(F.col("id").alias("receiver"), F.col("qualified_name").alias("receiver_name"))
    return rows.join(receivers, "receiver", "left").select("from_key", "to_key", "declared_key", F.col("receiver_name").alias("receiver"), "relationship", "line", "inherited", "derived")


@register("detail_open_target", _detail_sql(_FIRST, "true", "SELECT rel AS relationship, src.inherited, derived, declared_key IS NOT NULL AS elsewhere, count(*) AS n FROM ans JOIN src ON src.k = ans.f GROUP BY ALL"))
def detail_open_target(spark, sf_dir):
    """What members of the first brand and of its supertypes depend on anywhere, by kind and provenance."""
    store = td.library_store(spark, sf_dir)
    first = store.types.agg(F.min("artifact")).first()[0]
    rows = engine.detail_dependencies(store, from_id=handle_of(first)).rows
    return rows.groupBy("relationship", "inherited", "derived", F.col("receiver").isNotNull().alias("elsewhere")).agg(F.count(F.lit(1)).alias("n"))


@register("detail_calls_into", _detail_sql("true", _LAST, "SELECT p.fqn AS type, count(*) AS rows, greatest((SELECT count(DISTINCT f) FROM ans WHERE rel = 'calls') - 10, 0) AS others FROM ans JOIN pk p ON p.k = ans.f WHERE rel = 'calls' GROUP BY p.artifact, p.fqn ORDER BY rows DESC, " + handle("'type:' || length(p.artifact) || ':' || p.artifact || ':' || p.fqn") + " LIMIT 10"))
def detail_calls_into(spark, sf_dir):
    """The types with most calls into the last brand, whoever they are."""
    store = td.library_store(spark, sf_dir)
    last = store.types.agg(F.max("artifact")).first()[0]
    top = engine.detail_dependencies(store, to_id=handle_of(last), relationship="calls").by_source_type()
    return named(top.withColumnRenamed("type", "id"), store.graph.nodes, type="id").select("type", "rows", "others")
