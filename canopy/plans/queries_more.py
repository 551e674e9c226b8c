"""Queries on search, paging, detail rows, views and change streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canopy.operators import aggregate as agg
from canopy.operators import detail, search, views
from canopy.plans.oracle import NODES, TRADE, with_
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.sources import testdata as td
from canopy.streaming import changes as ch


def _at(name: str):
    from canopy.functions.names import handle_of

    return handle_of(name)


@register("find_node", f"""{with_(TRADE, NODES)}, h AS (SELECT qn, name, kind, CASE WHEN lower(name) = 's1' THEN 0 WHEN lower(qn) = 's1' THEN 1 WHEN starts_with(lower(name), 's1') THEN 2 ELSE 3 END AS rank FROM nodes WHERE contains(lower(name), 's1') OR contains(lower(qn), 's1'))
 SELECT qn AS qualified_name, kind, CAST(rank AS INTEGER) AS rank, (SELECT count(*) FROM h) AS total FROM h ORDER BY rank, length(qn), lower(qn), qn LIMIT 50""")
def find_node(spark, sf_dir):
    """The 50 best matches of a name with the number of all."""
    return search.find_nodes(td.trade_graph(spark, sf_dir), "s1").select("qualified_name", "kind", "rank", "total")


@register("list_children", f"{with_(TRADE, NODES)} SELECT qn AS qualified_name, kind FROM nodes WHERE package = 'NATION_3' AND kind = 'java.interface' AND contains(lower(name), 's') ORDER BY lower(qn), qn LIMIT 200")
def list_children(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return search.list_children(g, _at("pkg:EUROPE:NATION_3"), ["java.interface"], "s").select("qualified_name", "kind")


@register("list_descendants", f"{with_(TRADE, NODES)} SELECT qn AS qualified_name, kind FROM nodes WHERE module = 'EUROPE' AND kind IN ('java.class', 'java.interface')")
def list_descendants(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return search.list_descendants(g, _at("EUROPE"), ["types"]).select("qualified_name", "kind")


@register("dependency_page", f"{with_(TRADE)} SELECT c_fqn AS from_name, s_fqn AS to_name, CAST(weight AS BIGINT) AS weight FROM e WHERE c_region = 'EUROPE' AND s_region = 'ASIA' ORDER BY 1, 2 LIMIT 100 OFFSET 200")
def dependency_page(spark, sf_dir):
    """Rows 200 to 299 of a listing."""
    g = td.trade_graph(spark, sf_dir)
    return search.page(agg.dependencies_between(g, _at("EUROPE"), _at("ASIA")).select("from_name", "to_name", "weight"), 200, 100)


_DETAIL = f"{with_(TRADE)}, k AS (SELECT CASE WHEN kind IN ('extends', 'implements') OR (kind = 'annotated_by' AND ln = 1) THEN c_fqn ELSE c_fqn || '#void line' || ln || '()' END AS from_key, c_fqn, s_fqn, kind, ln, c_region, s_region FROM f)"


@register("detail_rows", _DETAIL + " SELECT from_key, s_fqn AS to_key, kind AS relationship, ln AS line, count(*) AS n FROM k WHERE c_region = 'EUROPE' AND s_region = 'ASIA' AND kind = 'calls' GROUP BY ALL")
def detail_rows(spark, sf_dir):
    """Member-level facts of one kind between two regions; equal facts are counted."""
    types = td.trade_types(spark, sf_dir)
    scope = lambda region: types.where(F.col("artifact") == region).select("fqn")
    rows = detail.detail_rows(td.trade_dependencies(spark, sf_dir), scope("EUROPE"), scope("ASIA"), "calls")
    return rows.groupBy("from_key", "to_key", "relationship", "line").agg(F.count(F.lit(1)).alias("n"))


@register("detail_relationships", _DETAIL + " SELECT kind AS relationship, count(*) AS n FROM k WHERE s_region = 'AFRICA' GROUP BY 1")
def detail_relationships(spark, sf_dir):
    scope = td.trade_types(spark, sf_dir).where("artifact = 'AFRICA'").select("fqn")
    return detail.relationship_counts(detail.detail_rows(td.trade_dependencies(spark, sf_dir), None, scope))


@register("read_by", _DETAIL + " SELECT s_fqn AS from_key, from_key AS to_key, 'read_by' AS relationship, ln AS line, count(*) AS n FROM k WHERE kind = 'casts' AND s_region = 'ASIA' GROUP BY ALL")
def read_by(spark, sf_dir):
    """A stored kind seen from its target: ends and scopes change places."""
    facts = td.trade_dependencies(spark, sf_dir).withColumn("relationship", F.when(F.col("relationship") == "casts", F.lit("reads_field")).otherwise(F.col("relationship")))
    scope = td.trade_types(spark, sf_dir).where("artifact = 'ASIA'").select("fqn")
    return detail.detail_rows(facts, scope, None, "read_by").groupBy("from_key", "to_key", "relationship", "line").agg(F.count(F.lit(1)).alias("n"))


@register("access_digest", _DETAIL + " SELECT s_fqn AS to_key, count(DISTINCT from_key) AS accessors FROM k WHERE kind = 'calls' GROUP BY 1")
def access_digest(spark, sf_dir):
    """Distinct members that use each supplier."""
    return detail.access_digest(td.trade_dependencies(spark, sf_dir), "calls").select("to_key", "accessors")


@register("type_details", f"{with_(TRADE)} SELECT c_fqn AS fqn, min(CASE WHEN kind = 'extends' THEN s_fqn END) AS superclass, count(DISTINCT CASE WHEN kind = 'implements' THEN s_fqn END) AS interfaces, count(DISTINCT CASE WHEN kind = 'annotated_by' AND ln = 1 THEN s_fqn END) AS annotations FROM f GROUP BY 1")
def type_details(spark, sf_dir):
    """Superclass and the numbers of interfaces and annotations of each customer with orders."""
    facts = td.trade_dependencies(spark, sf_dir)
    members = spark.createDataFrame([], "owner_fqn string, kind string")
    rows = detail.type_details(td.trade_types(spark, sf_dir), members, facts).join(facts.select(F.col("from_type").alias("fqn")).distinct(), "fqn", "left_semi")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("fqn", "superclass", F.greatest(size("interfaces"), F.lit(0)).alias("interfaces"), F.greatest(size("annotations"), F.lit(0)).alias("annotations"))


@register("group_view", f"{with_(TRADE)}, x AS (SELECT CASE WHEN c_nation IN ('NATION_3', 'NATION_8') THEN 'pair' ELSE c_nation END AS a, CASE WHEN s_nation IN ('NATION_3', 'NATION_8') THEN 'pair' ELSE s_nation END AS b, weight FROM e WHERE c_region = 'EUROPE' AND s_region = 'EUROPE') SELECT a AS from_node, b AS to_node, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS type_pairs FROM x WHERE a <> b GROUP BY 1, 2")
def group_view(spark, sf_dir):
    """Pairs of a region's children after two nations were put into a group."""
    g = td.trade_graph(spark, sf_dir)
    view = views.View("v", (views.Group("pair", (views.Selector("{NATION_3,NATION_8}", "java.package"),)),))
    made, _ = views.grouped(g, view)
    ids = [r["id"] for r in made.children_of(_at("EUROPE")).select("id").collect()]
    return named(agg.pairwise(made, ids), made.nodes.withColumn("qualified_name", F.col("name")), from_node="i", to_node="j").select("from_node", "to_node", "weight", "type_pairs")


@register("move_effect", f"""{with_(TRADE)}, a AS (SELECT c_region AS x, s_region AS y, sum(weight) AS w FROM e WHERE c_region <> s_region GROUP BY 1, 2), n AS (SELECT CASE WHEN c_nation = 'NATION_3' THEN 'NEW' ELSE c_region END AS x, CASE WHEN s_nation = 'NATION_3' THEN 'NEW' ELSE s_region END AS y, weight FROM e),
 b AS (SELECT x, y, sum(weight) AS w FROM n WHERE x <> y GROUP BY 1, 2) SELECT coalesce(a.x, b.x) AS from_module, coalesce(a.y, b.y) AS to_module, CAST(coalesce(a.w, 0) AS BIGINT) AS before, CAST(coalesce(b.w, 0) AS BIGINT) AS after, CASE WHEN a.w IS NULL THEN 'added' WHEN b.w IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.x = b.x AND a.y = b.y WHERE a.w IS DISTINCT FROM b.w""")
def move_effect(spark, sf_dir):
    """How module dependencies change if one nation becomes a module of its own."""
    g = td.trade_graph(spark, sf_dir)
    types = td.trade_types(spark, sf_dir).select("artifact", "fqn")
    place = views.moved_types(types, [views.Move(views.Selector("NATION_3", "java.package"), "NEW")])
    names = g.nodes.select("id", "qualified_name").join(types, F.col("qualified_name") == F.col("fqn")).select("id", "artifact", "fqn")
    side = lambda s: names.select(F.col("id").alias(f"{s}_id"), F.col("artifact").alias(f"{s}_artifact"), F.col("fqn").alias(f"{s}_fqn"))
    weights = g.edges.join(side("from"), "from_id").join(side("to"), "to_id").select("from_artifact", "from_fqn", "to_artifact", "to_fqn", "weight")
    return views.restructuring_effect(weights, place).changes.na.fill(0, ["before", "after"]).select("from_module", "to_module", "before", "after", "change")


_SESSIONS = """WITH o AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)"""


@register("settled_sessions", _SESSIONS + " SELECT user_id AS module, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS settled, count(*) AS changes FROM s GROUP BY user_id, k")
def settled_sessions(spark, sf_dir):
    """Bursts of changes that an hour of silence ends."""
    return ch.settled(td.change_stream(spark, sf_dir), "1 hour")


@register("newest_only", _SESSIONS + ", r AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) AS n, min(ts) OVER (PARTITION BY user_id, k) AS started FROM s) SELECT user_id AS module, started, event_id AS item FROM r WHERE n = 1")
def newest_only(spark, sf_dir):
    """The latest event of each burst."""
    return ch.newest_only(td.change_stream(spark, sf_dir).withColumnRenamed("event_id", "item"), "1 hour")


@register("activity_trailing", "SELECT user_id AS module, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def activity_trailing(spark, sf_dir):
    """Changes of the same module in the last 24 hours."""
    return ch.activity(td.change_stream(spark, sf_dir), 24 * 3600).select("module", "event_id", "recent")


@register("breaker_windows", "WITH x AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, ts FROM events), y AS (SELECT h - to_hours(CAST(i AS INTEGER)) AS started FROM x, range(6) t(i)) SELECT started, count(*) AS completions FROM y GROUP BY 1 HAVING count(*) >= 10")
def breaker_windows(spark, sf_dir):
    """Six-hour windows, each hour, with ten changes or more."""
    return ch.saturated(td.change_stream(spark, sf_dir), "6 hours", "1 hour", 10)


@register("reload_diff", "WITH b AS (SELECT user_id AS module, max(event_id) AS s FROM events WHERE event_id % 3 <> 0 GROUP BY 1), a AS (SELECT user_id AS module, max(event_id) AS s FROM events WHERE event_id % 5 <> 0 GROUP BY 1) SELECT coalesce(a.module, b.module) AS module, CASE WHEN b.s IS NULL THEN 'added' WHEN a.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'kept' END AS status FROM a FULL OUTER JOIN b ON a.module = b.module")
def reload_diff(spark, sf_dir):
    """Modules of two states of the stream: added, removed, changed, kept."""
    events = td.change_stream(spark, sf_dir)
    state = lambda k: events.where(F.col("event_id") % k != 0).groupBy("module").agg(F.max("event_id").alias("signature"))
    return ch.reload_diff(state(3), state(5))


@register("output_signatures", "SELECT user_id AS module, CAST(sum(CAST('0x' || substr(md5(event_type || '|' || event_id || '|' || epoch_us(ts)), 1, 12) AS BIGINT)) AS VARCHAR) AS signature, count(*) AS files FROM events GROUP BY 1")
def output_signatures(spark, sf_dir):
    """Order-independent signatures of each module's events read as files."""
    events = td.change_stream(spark, sf_dir)
    return ch.output_signatures(events.select("module", F.col("kind").alias("path"), F.col("event_id").alias("size"), F.unix_micros("ts").alias("mtime")))


@register("rank_in_page", f"{with_(TRADE)} SELECT c_nation AS node, CAST(sum(weight) AS BIGINT) AS weight, row_number() OVER (ORDER BY sum(weight) DESC, c_nation) AS position FROM e GROUP BY 1")
def rank_in_page(spark, sf_dir):
    """Nations by outgoing weight."""
    g = td.trade_graph(spark, sf_dir)
    packages = agg.subtree_groups(g, "java.package").select(F.col("id").alias("from_id"), "bucket")
    rows = named(g.edges.join(packages, "from_id").groupBy("bucket").agg(F.sum("weight").alias("weight")), g.nodes, node="bucket")
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.col("weight").desc(), "node")).cast("long")).select("node", "weight", "position")
