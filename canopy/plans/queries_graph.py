"""Queries on ingest, hierarchy and aggregation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import names
from canopy.functions.bits import type_modifiers
from canopy.operators import aggregate as agg
from canopy.operators import ingest
from canopy.plans.oracle import NODES, TRADE, handle, sequence, with_
from canopy.plans.registry import register
from canopy.schema import COUNTED_KINDS, MODULE, PACKAGE
from canopy.sources import testdata as td


def named(df: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """``df`` with ids replaced by qualified names: new column = old column."""
    for new, old in columns.items():
        df = df.join(nodes.select(F.col("id").alias(old), F.col("qualified_name").alias(new)), old).drop(old)
    return df


def _pairs(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = td.trade_graph(spark, sf_dir)
        return named(agg.pairwise(g, groups=agg.subtree_groups(g, kind)), g.nodes, from_node="i", to_node="j").select("from_node", "to_node", "weight", "type_pairs", "attrs")

    return query


for _name, _kind, _level in (("pairwise_regions", MODULE, "region"), ("pairwise_nations", PACKAGE, "nation")):
    register(_name, f"{with_(TRADE)} SELECT c_{_level} AS from_node, s_{_level} AS to_node, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS type_pairs, bit_or(attrs) AS attrs FROM e WHERE c_{_level} <> s_{_level} GROUP BY 1, 2")(_pairs(_kind))


@register("adjacency_regions", f"{with_(TRADE)} SELECT c_region AS from_node, s_region AS to_node, CAST(sum(weight) AS BIGINT) AS weight FROM e GROUP BY 1, 2")
def adjacency_regions(spark, sf_dir):
    """Matrix with its diagonal."""
    g = td.trade_graph(spark, sf_dir)
    ids = [r["id"] for r in g.nodes.where(F.col("kind") == MODULE).select("id").orderBy("id").collect()]
    return named(agg.adjacency(g, ids), g.nodes, from_node="i", to_node="j").select("from_node", "to_node", "weight")


@register("aggregated_pairs", f"{with_(TRADE)} SELECT c_region AS from_node, s_nation AS to_node, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS type_pairs, bit_or(attrs) AS attrs FROM e GROUP BY 1, 2")
def aggregated_pairs(spark, sf_dir):
    """Every region against every nation: sources and targets nest."""
    g = td.trade_graph(spark, sf_dir)
    tops = g.nodes.where(F.col("kind").isin(MODULE, PACKAGE)).select("id", "kind").orderBy("id").collect()
    out = agg.aggregated_pairs(g, [r["id"] for r in tops if r["kind"] == MODULE], [r["id"] for r in tops if r["kind"] == PACKAGE])
    return named(out, g.nodes, from_node="source", to_node="target").select("from_node", "to_node", "weight", "type_pairs", "attrs")


@register("module_dependencies", f"{with_(TRADE)} SELECT c_region AS from_module, s_region AS to_module, CAST(sum(weight) AS BIGINT) AS weight FROM e WHERE c_region <> s_region GROUP BY 1, 2")
def module_dependencies(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.module_weights(g).withColumnsRenamed({"from_module": "i", "to_module": "j"}), g.nodes, from_module="i", to_module="j").select("from_module", "to_module", "weight")


@register("boundary_counts", f"{with_(TRADE)}, x AS (SELECT c_region AS module, 0 AS i, 1 AS o FROM e WHERE c_region <> s_region UNION ALL SELECT s_region, 1, 0 FROM e WHERE c_region <> s_region) SELECT module, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM x GROUP BY 1")
def boundary_counts(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.boundary_counts(g).withColumnRenamed("module", "m"), g.nodes, module="m").select("module", "incoming", "outgoing")


@register("type_edges", f"{with_(TRADE)} SELECT c_fqn AS from_type, s_fqn AS to_type, CAST(weight AS BIGINT) AS weight, attrs FROM e")
def type_edges(spark, sf_dir):
    """All type edges with weight and attributes."""
    g = td.trade_graph(spark, sf_dir)
    return named(g.edges.select("from_id", "to_id", "weight", "attrs"), g.nodes, from_type="from_id", to_type="to_id").select("from_type", "to_type", "weight", "attrs")


@register("reference_rollup", f"{with_(TRADE)} SELECT c_region AS artifact, c_fqn AS from_type, s_fqn AS to_type, kind, (kind IN ('extends', 'implements') OR (kind = 'annotated_by' AND ln = 1)) AS type_level, count(*) AS n FROM f GROUP BY ALL")
def reference_rollup(spark, sf_dir):
    """Facts rolled up to references by kind and level."""
    return ingest.rollup(td.trade_dependencies(spark, sf_dir))


@register("kinds_by_region_pair", f"{with_(TRADE)} SELECT c_region AS from_node, s_region AS to_node, kind, count(*) AS weight FROM f GROUP BY ALL")
def kinds_by_region_pair(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    top = g.top_of().withColumnRenamed("top", "bucket")
    return named(agg.kinds_of(agg.bucketed_edges(g, top), "i", "j"), g.nodes, from_node="i", to_node="j").select("from_node", "to_node", "kind", "weight")


@register("attribute_summary", f"{with_(TRADE)} SELECT 'is_extends' AS attribute, count(*) FILTER (attrs & 1 > 0) AS edges FROM e UNION ALL SELECT 'is_implements', count(*) FILTER (attrs & 2 > 0) FROM e UNION ALL SELECT 'is_annotated_by', count(*) FILTER (attrs & 4 > 0) FROM e UNION ALL SELECT 'is_depends_on_other', count(*) FILTER (attrs & 8 > 0) FROM e")
def attribute_summary(spark, sf_dir):
    return agg.attribute_counts(td.trade_graph(spark, sf_dir).edges)


@register("external_placeholders", f"{with_(TRADE)} SELECT DISTINCT s_fqn AS fqn, '<external>' AS artifact FROM f WHERE s_region = 'ASIA' AND c_region <> 'ASIA'")
def external_placeholders(spark, sf_dir):
    """With one region unscanned, its suppliers become external types."""
    types = td.trade_types(spark, sf_dir).where("artifact <> 'ASIA'")
    facts = td.trade_dependencies(spark, sf_dir).where("artifact <> 'ASIA'")
    return ingest.external_placeholders(ingest.rollup(facts), types).select("fqn", "artifact")


@register("external_weights", f"{with_(TRADE)} SELECT c_region AS from_module, CASE WHEN s_region = 'ASIA' THEN 'External Types' ELSE s_region END AS to_module, count(*) AS weight FROM f WHERE c_region <> 'ASIA' AND c_region <> s_region GROUP BY 1, 2")
def external_weights(spark, sf_dir):
    """Module weights where one region is unscanned: its types hang under the external module."""
    g = ingest.build_graph(td.trade_types(spark, sf_dir).where("artifact <> 'ASIA'"), td.trade_dependencies(spark, sf_dir).where("artifact <> 'ASIA'"))
    return named(agg.module_weights(g).withColumnsRenamed({"from_module": "i", "to_module": "j"}), g.nodes, from_module="i", to_module="j").select("from_module", "to_module", "weight")


_MIRROR = "SELECT s_fqn, s_region AS d FROM su UNION SELECT s_fqn, (SELECT r_name FROM region WHERE r_regionkey = s_suppkey % 5) FROM su"


def _mirrored(spark, sf_dir):
    """Every supplier's type defined twice: in its region and in one given by its number; classpaths turn by region."""
    types = td.trade_types(spark, sf_dir)
    regions = td.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    again = types.where("fqn LIKE '%.S%'").withColumn("k", (F.regexp_extract("fqn", r"\.S(\d+)$", 1).try_cast("long") % 5).cast("int")).join(F.broadcast(regions), F.col("k") == F.col("r_regionkey")).withColumn("artifact", F.col("r_name"))
    types = types.unionByName(again.select(types.columns)).dropDuplicates(["artifact", "fqn"])
    own = regions.select(F.col("r_name").alias("artifact_key"), F.col("r_regionkey").alias("a"))
    entries = own.crossJoin(regions.select(F.col("r_name").alias("dep_key"), F.col("r_regionkey").alias("b"))).select("artifact_key", F.col("artifact_key").alias("name"), F.pmod(F.col("b") - F.col("a"), F.lit(5)).alias("index"), "dep_key", F.lit(1).alias("internal"))
    return types, entries, ingest.rollup(td.trade_dependencies(spark, sf_dir))


@register("classpath_resolution", f"""{with_(TRADE)}, d AS ({_MIRROR}), o AS (SELECT c.r_name AS owner, x.r_name AS d, ((x.r_regionkey - c.r_regionkey) % 5 + 5) % 5 AS i FROM region c, region x),
 r AS (SELECT f.c_region, f.s_fqn, count(*) AS n FROM f GROUP BY 1, 2), p AS (SELECT c_region, r.s_fqn, n, arg_min(d.d, o.i) AS t FROM r JOIN d ON r.s_fqn = d.s_fqn JOIN o ON o.owner = c_region AND o.d = d.d GROUP BY 1, 2, 3)
 SELECT c_region AS artifact, t AS to_artifact, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def classpath_resolution(spark, sf_dir):
    """Names that several artifacts define, resolved by the first on the owner's classpath."""
    types, entries, references = _mirrored(spark, sf_dir)
    return ingest.resolve_classpath(references, types, entries).groupBy("artifact", "to_artifact").agg(F.sum("n").alias("n"))


@register("owner_first_resolution", f"""{with_(TRADE)}, d AS ({_MIRROR}), r AS (SELECT c_region, s_fqn, count(*) AS n FROM f GROUP BY 1, 2),
 p AS (SELECT c_region, r.s_fqn, n, coalesce(max(CASE WHEN d.d = c_region THEN d.d END), min(d.d)) AS t FROM r JOIN d ON r.s_fqn = d.s_fqn GROUP BY 1, 2, 3) SELECT c_region AS artifact, t AS to_artifact, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def owner_first_resolution(spark, sf_dir):
    """The same names, resolved to the owner's own artifact or the least definer."""
    types, _, references = _mirrored(spark, sf_dir)
    return ingest.resolve_owner_first(references, types).groupBy("artifact", "to_artifact").agg(F.sum("n").alias("n"))


@register("graph_nodes", f"{with_(TRADE, NODES)} SELECT qn AS qualified_name, kind, name FROM nodes UNION ALL SELECT '', 'root', ''")
def graph_nodes(spark, sf_dir):
    return td.trade_graph(spark, sf_dir).nodes.select("qualified_name", "kind", "name")


@register("handle_collisions", "SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS keys WHERE 1 = 0")
def handle_collisions(spark, sf_dir):
    return ingest.handle_collisions(td.trade_graph(spark, sf_dir).nodes)


@register("ancestors", f"{with_(TRADE, NODES)} SELECT qn AS node, package AS ancestor, 1 AS depth FROM nodes WHERE kind IN ('java.class', 'java.interface') UNION ALL SELECT qn, module, 2 FROM nodes WHERE kind IN ('java.class', 'java.interface') UNION ALL SELECT qn, module, 1 FROM nodes WHERE kind = 'java.package'")
def ancestors(spark, sf_dir):
    """The closure below the root: every node with its ancestors."""
    g = td.trade_graph(spark, sf_dir)
    strict = g.closure().where("depth > 0").select(F.col("descendant").alias("d"), F.col("ancestor").alias("a"), "depth")
    return named(strict, g.nodes, node="d", ancestor="a").where("ancestor <> ''").select("node", "ancestor", "depth")


@register("descendant_counts", f"{with_(TRADE, NODES)} SELECT n.qn AS node, count(x.qn) AS descendants, count(*) FILTER (x.kind IN ('java.class', 'java.interface')) AS types, count(*) FILTER (x.kind = 'java.package') AS packages FROM nodes n LEFT JOIN nodes x ON x.qn <> n.qn AND ((n.kind = 'java.module' AND x.module = n.qn) OR (n.kind = 'java.package' AND x.package = n.qn)) WHERE n.kind IN ('java.module', 'java.package') GROUP BY 1")
def descendant_counts(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    containers = g.nodes.where(F.col("kind").isin(MODULE, PACKAGE)).select("id", F.col("qualified_name").alias("node"))
    return containers.join(g.descendant_counts(), "id").select("node", "descendants", "types", "packages")



@register("outgoing_dependencies", f"{with_(TRADE)} SELECT c_fqn AS from_name, s_fqn AS to_name, CAST(weight AS BIGINT) AS weight, attrs FROM e WHERE c_region = 'EUROPE' AND s_region = 'ASIA'")
def outgoing_dependencies(spark, sf_dir):
    """Type dependencies from one region to another."""
    g = td.trade_graph(spark, sf_dir)
    return agg.dependencies_between(g, names.handle_of("EUROPE"), names.handle_of("ASIA")).select("from_name", "to_name", "weight", "attrs")


@register("incoming_dependencies", f"{with_(TRADE)} SELECT c_fqn AS from_name, s_fqn AS to_name, CAST(weight AS BIGINT) AS weight, attrs FROM e WHERE s_region = 'AFRICA'")
def incoming_dependencies(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return agg.dependencies_into(g, names.handle_of("AFRICA")).select("from_name", "to_name", "weight", "attrs")


@register("top_targets", f"{with_(TRADE)} SELECT s_fqn AS to_name, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM e WHERE c_region = 'EUROPE' GROUP BY 1 ORDER BY weight DESC, to_name LIMIT 10")
def top_targets(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return agg.top_by(agg.dependencies_between(g, names.handle_of("EUROPE")), "to_name")


@register("referenced_nodes", f"{with_(TRADE)} SELECT DISTINCT s_fqn AS node FROM e WHERE c_region = 'AMERICA' AND s_region <> 'AMERICA'")
def referenced_nodes(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.referenced(g, names.handle_of("AMERICA")), g.nodes, node="id").select("node")


@register("referencing_nodes", f"{with_(TRADE)} SELECT DISTINCT c_fqn AS node FROM e WHERE s_region = 'AMERICA' AND c_region <> 'AMERICA'")
def referencing_nodes(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.referenced(g, names.handle_of("AMERICA"), outgoing=False), g.nodes, node="id").select("node")


@register("children_referencing", f"{with_(TRADE)} SELECT DISTINCT c_nation AS node FROM e WHERE c_region = 'EUROPE' AND s_region = 'ASIA'")
def children_referencing(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.children_referencing(g, names.handle_of("EUROPE"), [names.handle_of("ASIA")]), g.nodes, node="id").select("node")


@register("filtered_dependencies", f"{with_(TRADE)} SELECT c_nation AS from_node, s_nation AS to_node, CAST(sum(weight) AS BIGINT) AS weight FROM e WHERE c_region IN ('EUROPE', 'ASIA') AND s_region = 'AFRICA' GROUP BY 1, 2")
def filtered_dependencies(spark, sf_dir):
    """Edges of a selection on both sides, by package."""
    g = td.trade_graph(spark, sf_dir)
    chosen = agg.filtered_dependencies(g, g.edges, [names.handle_of("EUROPE"), names.handle_of("ASIA")], [names.handle_of("AFRICA")])
    packages = agg.subtree_groups(g, PACKAGE)
    out = chosen.join(packages.select(F.col("id").alias("from_id"), F.col("bucket").alias("i")), "from_id").join(packages.select(F.col("id").alias("to_id"), F.col("bucket").alias("j")), "to_id").groupBy("i", "j").agg(F.sum("weight").alias("weight"))
    return named(out, g.nodes, from_node="i", to_node="j").select("from_node", "to_node", "weight")


@register("drill_down", f"{with_(TRADE)} SELECT c_nation AS node, CAST(sum(weight) AS BIGINT) AS weight FROM e WHERE c_region = 'EUROPE' AND s_region = 'ASIA' GROUP BY 1")
def drill_down(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.drill_down(g, names.handle_of("EUROPE"), names.handle_of("ASIA")), g.nodes, node="id").select("node", "weight")


@register("accumulated_outgoing", f"{with_(TRADE)} SELECT c_fqn AS from_type, s_fqn AS to_type, CAST(weight AS BIGINT) AS weight FROM e WHERE c_nation = 'NATION_3'")
def accumulated_outgoing(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return named(agg.accumulated(g, names.handle_of("pkg:EUROPE:NATION_3")).select("from_id", "to_id", "weight"), g.nodes, from_type="from_id", to_type="to_id").select("from_type", "to_type", "weight")


@register("region_density", f"{with_(TRADE)} SELECT round(count(*) / 20.0, 2) AS density FROM (SELECT DISTINCT c_region, s_region FROM e WHERE c_region <> s_region)")
def region_density(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return agg.density(agg.pairwise(g, groups=agg.subtree_groups(g, MODULE)), 5)


@register("split_packages", "SELECT p_type AS package, count(DISTINCT p_brand) AS modules FROM (SELECT replace(replace(p_type, ' ', '_'), '.', '_') AS p_type, p_brand FROM part) GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def split_packages(spark, sf_dir):
    """Part types that several brands share, read as package names in several modules."""
    types = td.table(spark, sf_dir, "part").select(F.col("p_brand").alias("artifact"), F.concat(F.regexp_replace("p_type", r"[ .]", "_"), F.lit(".P"), "p_partkey").alias("fqn"))
    return agg.split_packages(None, types)


@register("nodes_by_kind", f"{with_(TRADE, NODES)} SELECT kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'root', 1")
def nodes_by_kind(spark, sf_dir):
    return td.trade_graph(spark, sf_dir).nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("weight_by_kind", f"{with_(TRADE)} SELECT kind, count(*) AS weight FROM f GROUP BY 1")
def weight_by_kind(spark, sf_dir):
    return agg.kinds_of(td.trade_graph(spark, sf_dir).edges)


_TYPE_ID = lambda region, fqn: handle(f"'type:' || length({region}) || ':' || {region} || ':' || {fqn}")
_BITS = lambda text: f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


@register("fingerprint", f"""{with_(TRADE, NODES)}, k AS (SELECT CASE kind WHEN 'java.module' THEN qn WHEN 'java.package' THEN 'pkg:' || module || ':' || qn ELSE 'type:' || length(module) || ':' || module || ':' || qn END AS key, kind FROM nodes UNION ALL SELECT '<root>', 'root'),
 n AS (SELECT count(*) AS nodes, CAST(sum({_BITS(handle("key") + " || '|' || kind")}) AS VARCHAR) AS a FROM k), x AS (SELECT count(*) AS edges, CAST(sum({_BITS(_TYPE_ID("c_region", "c_fqn") + " || '|' || " + _TYPE_ID("s_region", "s_fqn") + " || '|' || weight")}) AS VARCHAR) AS b FROM e)
 SELECT nodes, edges, translate(to_base64(unhex(substr(sha256(nodes || ':' || edges || ':' || a || ':' || b), 1, 24))), '+/=', '-_') AS data_hash FROM n, x""")
def fingerprint(spark, sf_dir):
    """Order-independent hash of nodes and edges."""
    from canopy.functions.hashing import fingerprint as of

    g = td.trade_graph(spark, sf_dir)
    return of(g.nodes, g.edges)


@register("modifier_decoding", "SELECT p_size AS bits, CASE WHEN p_size & 1 > 0 THEN 'public' WHEN p_size & 2 > 0 THEN 'protected' WHEN p_size & 4 > 0 THEN 'private' ELSE 'package-private' END || CASE WHEN p_size & 32 > 0 THEN ' abstract' ELSE '' END || CASE WHEN p_size & 16 > 0 THEN ' final' ELSE '' END || CASE WHEN p_size & 8 > 0 THEN ' static' ELSE '' END AS modifiers, count(*) AS n FROM part GROUP BY 1, 2")
def modifier_decoding(spark, sf_dir):
    """Sizes read as bitmaps of type modifiers."""
    bits = F.col("p_size")
    return td.table(spark, sf_dir, "part").groupBy(bits.alias("bits"), F.array_join(type_modifiers(bits), " ").alias("modifiers")).agg(F.count(F.lit(1)).alias("n"))


@register("sequence_edges", f"{with_(sequence())} SELECT a AS from_type, b AS to_type, CAST(weight AS BIGINT) AS weight FROM g")
def sequence_edges(spark, sf_dir):
    g = td.sequence_graph(spark, sf_dir)
    return named(g.edges.select("from_id", "to_id", "weight"), g.nodes, from_type="from_id", to_type="to_id").select("from_type", "to_type", "weight")


@register("pre_order", f"{with_(TRADE, NODES)} SELECT qn AS qualified_name, kind, CASE kind WHEN 'java.package' THEN 1 ELSE 2 END AS depth, row_number() OVER (ORDER BY lower(coalesce(package, '')), CASE kind WHEN 'java.package' THEN 0 ELSE 1 END, lower(qn), qn) AS position FROM nodes WHERE module = 'EUROPE' AND kind <> 'java.module'")
def pre_order(spark, sf_dir):
    """Descendants of a module in depth-first order."""
    from pyspark.sql import Window

    g = td.trade_graph(spark, sf_dir)
    rows = g.pre_order(names.handle_of("EUROPE"))
    # One module's page: the position is global over it.
    return rows.withColumn("position", F.row_number().over(Window.orderBy("path")).cast("long")).select("qualified_name", "kind", "depth", "position")


assert set(td.LINE_KINDS.values()) <= set(COUNTED_KINDS)
