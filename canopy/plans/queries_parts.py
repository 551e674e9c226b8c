"""Queries on sources, sinks, navigation, filters and member facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.functions.bits import method_modifiers
from canopy.functions.names import handle_of, is_test_key, matches_pattern
from canopy.operators import aggregate as agg
from canopy.operators import detail, filters, search
from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.ingest import build_graph
from canopy.plans.materialize import delete_path, shared_dir, stage_table
from canopy.plans.oracle import NODES, TRADE, with_, with_recursive
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.schema import PACKAGE
from canopy.sources import tables
from canopy.sources import testdata as td
from canopy.streaming import changes as ch

_TYPES = "('java.class', 'java.interface')"


# --- sources and sinks ------------------------------------------------------------------------------------------------


@register("snapshot_round_trip", f"{with_(TRADE)} SELECT c_fqn AS from_type, s_fqn AS to_type, CAST(weight AS BIGINT) AS weight, attrs FROM e")
def snapshot_round_trip(spark, sf_dir):
    """The edges of a graph whose facts were written, checked and loaded again."""
    import uuid

    path = f"{shared_dir(spark)}/canopy-snapshot-{uuid.uuid4().hex}"
    tables.write_snapshot(path, types=td.trade_types(spark, sf_dir), dependencies=td.trade_dependencies(spark, sf_dir).drop("l_orderkey"))
    g = tables.load_graph(spark, path)
    rows = stage_table(named(g.edges.select("from_id", "to_id", "weight", "attrs"), g.nodes, from_type="from_id", to_type="to_id").select("from_type", "to_type", "weight", "attrs"))
    delete_path(spark, path)
    return rows


@register("types_by_name", f"{with_(TRADE)} SELECT c_fqn AS fqn, c_region AS artifact FROM cu WHERE c_custkey BETWEEN 1 AND 20 UNION ALL SELECT s_fqn, s_region FROM su WHERE s_suppkey BETWEEN 1 AND 5")
def types_by_name(spark, sf_dir):
    """Types of given names, whichever of them exist."""
    wanted = [f"NATION_{n}.{x}" for n in range(30) for x in (*(f"C{k}" for k in range(1, 21)), *(f"S{k}" for k in range(1, 6)))]
    return tables.types_by_name(td.trade_types(spark, sf_dir), wanted).select("fqn", "artifact")


_MEMBERS = f"{with_(TRADE)}, m AS (SELECT DISTINCT c_region AS artifact, c_fqn AS owner, c_fqn || '#void line' || ln || '()' AS member_key, ln, CASE WHEN ln % 2 = 1 THEN 1 ELSE 4 END + CASE WHEN ln % 3 = 0 THEN 8 ELSE 0 END AS bits FROM f)"


def _members(spark, sf_dir):
    """A method for each customer and line number: public where odd, else private, and static where divisible by three."""
    line = F.col("line")
    own = td.trade_dependencies(spark, sf_dir).select("artifact", F.col("from_type").alias("owner_fqn"), "line").distinct()
    signature = F.concat(F.lit("void line"), line, F.lit("()"))
    bits = F.when(line % 2 == 1, 1).otherwise(4) + F.when(line % 3 == 0, 8).otherwise(0)
    none = F.lit(None)
    return own.select(
        "artifact", "owner_fqn", F.concat("owner_fqn", F.lit("#"), signature).alias("member_key"), F.lit("METHOD").alias("kind"), F.concat(F.lit("line"), line).alias("name"), signature.alias("signature"), bits.cast("int").alias("modifiers"),
        line.cast("int").alias("line_from"), none.cast("int").alias("line_to"), none.cast("string").alias("bridge_target"),
    )


@register("members_by_owner", _MEMBERS + " SELECT owner AS owner_fqn, CAST(count(*) AS INTEGER) AS n, min(member_key) AS first, max(member_key) AS last FROM m GROUP BY 1")
def members_by_owner(spark, sf_dir):
    rows = tables.members_by_owner(_members(spark, sf_dir))
    return rows.select("owner_fqn", F.size("members").alias("n"), F.col("members")[0]["member_key"].alias("first"), F.element_at("members", -1)["member_key"].alias("last"))


@register("first_of_artifacts", "WITH p AS (SELECT p_type, p_partkey, min(p_brand) OVER (PARTITION BY p_type) AS least, p_brand FROM part) SELECT p_type, p_brand AS artifact, p_partkey FROM p WHERE p_brand = least")
def first_of_artifacts(spark, sf_dir):
    """Parts of the first brand, by name, that has their type."""
    return tables.first_of_artifacts(td.table(spark, sf_dir, "part").select("p_type", F.col("p_brand").alias("artifact"), "p_partkey"), "p_type")


@register("classpath_entries", "SELECT o.r_name AS artifact_key, string_agg(x.r_name, ',' ORDER BY ((x.r_regionkey - o.r_regionkey) % 5 + 5) % 5) AS entries FROM region o, region x GROUP BY 1")
def classpath_entries(spark, sf_dir):
    """Each region's classpath: itself, then the others in turn."""
    region = td.table(spark, sf_dir, "region")
    ring = [(r["r_name"], r["r_regionkey"]) for r in region.select("r_name", "r_regionkey").collect()]  # five rows
    rows = [(name, name, [(other, 1) for other, _ in sorted(ring, key=lambda x: (x[1] - key) % 5)[1:]]) for name, key in ring]
    artifacts = spark.createDataFrame(rows, "artifact_key string, name string, entries array<struct<dep_key: string, internal: int>>")
    return tables.classpaths(tables.classpath_rows(artifacts)).select("artifact_key", F.array_join("entries", ",").alias("entries"))


@register("source_artifact", "SELECT 'EUROPE' AS artifact")
def source_artifact(spark, sf_dir):
    return tables.source_artifact(td.trade_types(spark, sf_dir).where("artifact = 'EUROPE'"))


@register("filed_facts", f"{with_(TRADE)} SELECT c_region AS artifact, count(*) AS n FROM f GROUP BY 1")
def filed_facts(spark, sf_dir):
    """Facts without an artifact are filed under that of their owner; those of unknown owners drop out."""
    facts = td.trade_dependencies(spark, sf_dir)
    lost = facts.withColumn("artifact", F.when(F.col("line") % 2 == 0, F.col("artifact")))
    orphans = facts.limit(0).unionByName(facts.where("line = 1").withColumns({"artifact": F.lit(None).cast("string"), "from_type": F.lit("nowhere.X")}))
    return tables.filed(lost.unionByName(orphans), td.trade_types(spark, sf_dir)).groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))


@register("scanned_dependencies", f"{with_(TRADE)} SELECT c_fqn AS from_type, s_fqn AS to_type, count(*) AS n FROM f WHERE kind = 'casts' AND split_part(c_fqn, '.C', 2) IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') GROUP BY 1, 2")
def scanned_dependencies(spark, sf_dir):
    """Facts of one kind from given types."""
    rows = tables.dependencies(td.trade_dependencies(spark, sf_dir), [f"NATION_{n}.C{k}" for n in range(30) for k in range(1, 10)], (), "casts")
    return rows.groupBy("from_type", "to_type").agg(F.count(F.lit(1)).alias("n"))


# --- navigation -------------------------------------------------------------------------------------------------------


def _ids(graph: DependencyGraph, *keys: str):
    return graph.nodes.sparkSession.createDataFrame([(handle_of(k),) for k in keys], "id long")


def _names(graph: DependencyGraph, ids):
    return graph.nodes.join(ids.select("id"), "id", "left_semi").select(F.col("qualified_name").alias("node"))


@register("expanded_children", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE qn = 'EUROPE' OR (kind = 'java.package' AND module = 'EUROPE')")
def expanded_children(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return _names(g, g.expanded(_ids(g, "EUROPE"), "SELF_AND_CHILDREN"))


@register("expanded_successors", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE module = 'EUROPE' OR package = 'NATION_0'")
def expanded_successors(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    package = g.nodes.where("qualified_name = 'NATION_0'").select("id")
    return _names(g, g.expanded(_ids(g, "EUROPE").unionByName(package).distinct(), "SELF_AND_SUCCESSORS"))


@register("with_ancestors", f"{with_(TRADE, NODES)}, x AS (SELECT * FROM nodes WHERE kind = 'java.interface' AND name LIKE 'S1%') SELECT qn AS node FROM x UNION SELECT package FROM x UNION SELECT module FROM x UNION SELECT '' FROM x")
def with_ancestors(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return _names(g, g.with_ancestors(g.nodes.where("kind = 'java.interface' AND name LIKE 'S1%'").select("id")))


@register("within_anchors", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE kind = 'java.interface' AND module IN ('EUROPE', 'ASIA')")
def within_anchors(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    return _names(g, g.within(g.nodes.where("kind = 'java.interface'").select("id"), _ids(g, "EUROPE", "ASIA")))


@register("descendants_of_kind", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE kind = 'java.package' AND module IN ('EUROPE', 'ASIA')")
def descendants_of_kind(spark, sf_dir):
    """A kind filters but doesn't prune; seeds that nest or repeat don't repeat results."""
    g = td.trade_graph(spark, sf_dir)
    return _names(g, g.descendants_of(_ids(g, "EUROPE", "ASIA", "EUROPE"), [PACKAGE]))


@register("pruned_traversal", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE module = 'EUROPE' AND kind <> 'java.module' AND coalesce(package, '') <> 'NATION_3'")
def pruned_traversal(spark, sf_dir):
    """A node that fails cuts its subtree off."""
    g = td.trade_graph(spark, sf_dir)
    return _names(g, g.traverse(handle_of("EUROPE"), F.col("qualified_name") != "NATION_3"))


@register("child_containing", f"{with_(TRADE)} SELECT s_fqn AS node, s_nation AS child FROM su WHERE s_region = 'EUROPE'")
def child_containing(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    held = g.child_containing(handle_of("EUROPE"), g.nodes.where("kind = 'java.interface'").select("id"))
    return named(held.withColumnsRenamed({"id": "a", "child": "b"}), g.nodes, node="a", child="b").select("node", "child")


@register("common_ancestors", f"{with_(TRADE)} SELECT c_fqn AS a, s_fqn AS b, CASE WHEN c_nation = s_nation THEN c_nation WHEN c_region = s_region THEN c_region ELSE '' END AS ancestor FROM e WHERE c_region = 'EUROPE'")
def common_ancestors(spark, sf_dir):
    """The deepest node above both ends of each dependency of a region."""
    g = td.trade_graph(spark, sf_dir)
    pairs = agg.accumulated(g, handle_of("EUROPE")).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    found = g.lowest_common_ancestor(pairs).withColumnsRenamed({"a": "x", "b": "y", "ancestor": "z"})
    return named(found, g.nodes, a="x", b="y", ancestor="z").select("a", "b", "ancestor")


@register("accumulated_incoming", f"{with_(TRADE)} SELECT c_fqn AS from_type, s_fqn AS to_type, CAST(weight AS BIGINT) AS weight FROM e WHERE s_nation = 'NATION_3'")
def accumulated_incoming(spark, sf_dir):
    g = td.trade_graph(spark, sf_dir)
    rows = agg.accumulated(g, handle_of("pkg:EUROPE:NATION_3"), outgoing=False).select("from_id", "to_id", "weight")
    return named(rows, g.nodes, from_type="from_id", to_type="to_id").select("from_type", "to_type", "weight")


_PART_NAMES = "pn AS (SELECT replace(replace(p_brand, '.', '_'), '#', '_') || '.P' || p_partkey AS outer_name, p_partkey, p_size FROM part)"


def _nested_graph(spark, sf_dir) -> DependencyGraph:
    """Parts as types, with a member type, a type within that and an anonymous one for some."""
    part = td.table(spark, sf_dir, "part").select(F.col("p_brand").alias("artifact"), F.concat(F.regexp_replace("p_brand", r"[.#]", "_"), F.lit(".P"), "p_partkey").alias("fqn"), "p_size")
    ends = F.explode(F.filter(F.array(F.lit(""), F.when(F.col("p_size") % 2 == 0, F.lit("$In")), F.when(F.col("p_size") % 4 == 0, F.lit("$In$Deep")), F.when(F.col("p_size") % 3 == 0, F.lit("$1"))), lambda x: x.isNotNull()))
    types = part.select("artifact", ends.alias("end"), "fqn").select("artifact", F.concat("fqn", "end").alias("fqn"), F.lit("CLASS").alias("kind"), F.lit(1).alias("modifiers"))
    facts = spark.createDataFrame([], "artifact string, from_key string, from_type string, to_type string, relationship string")
    return build_graph(types, facts, placeholders=None)


@register("nested_types", f"{with_(_PART_NAMES)} SELECT outer_name AS outer_type, outer_name || '$In' AS inner_type FROM pn WHERE p_size % 2 = 0 UNION ALL SELECT outer_name || '$In', outer_name || '$In$Deep' FROM pn WHERE p_size % 4 = 0")
def nested_types(spark, sf_dir):
    """Member types directly below each type; anonymous ones are left out."""
    g = _nested_graph(spark, sf_dir)
    return named(g.nested(direct=True).withColumnsRenamed({"outer": "a", "inner": "b"}), g.nodes, outer_type="a", inner_type="b").select("outer_type", "inner_type")


@register("enclosing_types", f"{with_(_PART_NAMES)} SELECT outer_name || '$In' AS inner_type, outer_name AS outer_type FROM pn WHERE p_size % 2 = 0 UNION ALL SELECT outer_name || '$In$Deep', outer_name || '$In' FROM pn WHERE p_size % 4 = 0 UNION ALL SELECT outer_name || '$1', outer_name FROM pn WHERE p_size % 3 = 0")
def enclosing_types(spark, sf_dir):
    g = _nested_graph(spark, sf_dir)
    return named(g.enclosing().withColumnsRenamed({"outer": "a", "inner": "b"}), g.nodes, outer_type="a", inner_type="b").select("inner_type", "outer_type")


@register("moved_node", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE package = 'NATION_3' AND kind IN {_TYPES} UNION ALL SELECT 'NATION_3' UNION ALL SELECT qn FROM nodes WHERE module = 'ASIA' AND kind <> 'java.module'")
def moved_node(spark, sf_dir):
    """What lies below a module after another module's package was moved into it."""
    g = td.trade_graph(spark, sf_dir)
    other = g.moved([handle_of("pkg:EUROPE:NATION_3")], handle_of("ASIA"))
    return _names(other, other.descendants_of(_ids(g, "ASIA")))


@register("adjacency_list", f"{with_(TRADE)}, r AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS k FROM region) SELECT CAST(a.k AS INTEGER) AS at, coalesce(string_agg(CAST(b.k AS VARCHAR), ',' ORDER BY b.k), '') AS targets FROM r a LEFT JOIN (SELECT DISTINCT c_region, s_region FROM e) x ON x.c_region = a.r_name LEFT JOIN r b ON b.r_name = x.s_region GROUP BY a.k")
def adjacency_list(spark, sf_dir):
    """For each region, by its place, the places of those it depends on."""
    g = td.trade_graph(spark, sf_dir)
    regions = sorted(r["r_name"] for r in td.table(spark, sf_dir, "region").select("r_name").collect())  # five rows
    return agg.adjacency_list(g, [handle_of(r) for r in regions]).select("at", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@register("graph_overview", f"""{with_(TRADE, NODES)}, c AS (SELECT c_region AS i, s_region AS j, sum(weight) AS w FROM e GROUP BY 1, 2)
 SELECT m.qn AS name, (SELECT count(*) FROM nodes p WHERE p.kind = 'java.package' AND p.module = m.qn) AS packages, (SELECT count(*) FROM nodes t WHERE t.kind IN {_TYPES} AND t.module = m.qn) AS types,
 CAST(coalesce((SELECT sum(w) FROM c WHERE i = m.qn AND j = m.qn), 0) AS BIGINT) AS inner_weight, CAST(coalesce((SELECT sum(w) FROM c WHERE i = m.qn AND j <> m.qn), 0) AS BIGINT) AS outgoing_weight, CAST(coalesce((SELECT sum(w) FROM c WHERE j = m.qn AND i <> m.qn), 0) AS BIGINT) AS incoming_weight,
 (SELECT count(*) FROM c WHERE i = m.qn AND j <> m.qn) AS depends_on, (SELECT count(*) FROM c WHERE j = m.qn AND i <> m.qn) AS used_by FROM nodes m WHERE m.kind = 'java.module'""")
def graph_overview(spark, sf_dir):
    """Sizes and couplings of all modules, as one page."""
    return search.page(agg.overview(td.trade_graph(spark, sf_dir))).drop("id")


# --- filters ----------------------------------------------------------------------------------------------------------


@register("static_members", _MEMBERS + " SELECT member_key AS node FROM m WHERE artifact = 'EUROPE' AND bits & 8 > 0 AND bits & 1 > 0")
def static_members(spark, sf_dir):
    """Methods of one module that are public and static."""
    g = build_graph(td.trade_types(spark, sf_dir), td.trade_dependencies(spark, sf_dir), _members(spark, sf_dir), placeholders=None)
    return search.list_descendants(g, handle_of("EUROPE"), ["java.method"], None, ["STATIC", "public"]).select(F.col("qualified_name").alias("node"))


@register("pattern_nodes", f"{with_(TRADE, NODES)} SELECT qn AS node FROM nodes WHERE kind = 'java.interface' AND module = 'EUROPE' AND regexp_matches(qn, '^NATION_.*\\.S[^:]*[37]$')")
def pattern_nodes(spark, sf_dir):
    """Nodes of a kind below a node whose name matches a pattern with alternatives."""
    g = td.trade_graph(spark, sf_dir)
    return filters.select_nodes(g, "NATION_**.S*{3,7}", "java.interface", handle_of("EUROPE")).select(F.col("qualified_name").alias("node"))


@register("test_keys", "SELECT p_brand || CASE WHEN p_size % 5 = 0 THEN ':test' ELSE '' END AS key, count(*) AS n FROM part WHERE p_size % 5 = 0 AND p_brand LIKE '%1%' GROUP BY 1")
def test_keys(spark, sf_dir):
    """Keys of test modules, by suffix, whose names match a pattern."""
    key = F.concat("p_brand", F.when(F.col("p_size") % 5 == 0, F.lit(":test")).otherwise(F.lit("")))
    return td.table(spark, sf_dir, "part").where(matches_pattern(F.col("p_brand"), "**1**")).select(key.alias("key")).where(is_test_key(F.col("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("unknown_ids", "SELECT CAST(i AS BIGINT) AS id FROM (VALUES (1), (2)) t(i)")
def unknown_ids(spark, sf_dir):
    """Ids that no node has."""
    return agg.unknown_ids(td.trade_graph(spark, sf_dir), [1, handle_of("EUROPE"), 2, 1])


@register("dependency_ids", f"{with_(TRADE)} SELECT c_region AS from_node, s_region AS to_node FROM (SELECT min(c_fqn || '>' || s_fqn) AS x, c_region, s_region FROM e GROUP BY 2, 3)")
def dependency_ids(spark, sf_dir):
    """One dependency of each pair of regions, found again by its id."""
    g = td.trade_graph(spark, sf_dir)
    tops = g.top_of()
    cells = agg.bucketed_edges(g, tops.withColumnRenamed("top", "bucket")).groupBy("i", "j").agg(F.min(F.struct("from_id", "to_id")).alias("e"))
    ids = [f"{r['e']['from_id']}_{r['e']['to_id']}_depends" for r in cells.collect()]  # one for each pair of regions
    found, _ = agg.dependencies_by_id(g, [*ids, "1_2_depends"])
    a, b = (tops.select(F.col("id").alias(f"{side}_id"), F.col("top").alias(side)) for side in ("from", "to"))
    return named(found.join(a, "from_id").join(b, "to_id").select(F.col("from").alias("i"), F.col("to").alias("j")), g.nodes, from_node="i", to_node="j").select("from_node", "to_node")


@register("numbered_page", f"{with_(TRADE)} SELECT c_fqn AS from_name, s_fqn AS to_name FROM e WHERE c_region = 'EUROPE' ORDER BY 1, 2 LIMIT 50 OFFSET 100")
def numbered_page(spark, sf_dir):
    """The third page of fifty."""
    g = td.trade_graph(spark, sf_dir)
    rows = named(agg.accumulated(g, handle_of("EUROPE")).select("from_id", "to_id"), g.nodes, from_name="from_id", to_name="to_id").select("from_name", "to_name").orderBy("from_name", "to_name")
    return search.numbered_page(rows, 3, 50)[0]


# --- member facts -----------------------------------------------------------------------------------------------------


@register("supertype_pairs", f"{with_recursive('d AS (SELECT p_partkey AS sub, p_partkey // 2 AS super, 1 AS depth FROM part WHERE p_partkey >= 2 UNION ALL SELECT sub, super // 2, depth + 1 FROM d WHERE super >= 2)')} SELECT 'P' || sub AS sub, 'P' || super AS super, depth, sub % 3 <> 0 AND depth = 1 AS direct_class FROM d")
def supertype_pairs(spark, sf_dir):
    """All supertypes of parts, each of which extends (or, by threes, implements) the part of half its number."""
    key = F.col("p_partkey")
    facts = td.table(spark, sf_dir, "part").where(key >= 2).select(F.concat(F.lit("P"), key).alias("from_type"), F.concat(F.lit("P"), F.floor(key / 2)).alias("to_type"), F.when(key % 3 == 0, "implements").otherwise("extends").alias("relationship"))
    return detail.supertype_pairs(facts).select("sub", "super", "depth", (F.col("by_class") & (F.col("depth") == 1)).alias("direct_class"))


@register("inherited_facts", "WITH h AS (SELECT p_partkey AS k, p_partkey // 2 AS s FROM part), c AS (SELECT DISTINCT a.k AS t, true AS inherited FROM h a WHERE a.k IN (SELECT x.s FROM h x WHERE x.k % 10 = 0 AND x.k >= 2) AND a.k % 10 <> 0) SELECT 'P' || k AS from_type, false AS inherited FROM h WHERE k % 10 = 0 UNION ALL SELECT 'P' || t, inherited FROM c")
def inherited_facts(spark, sf_dir):
    """Facts of a scope and of the direct supertypes outside it."""
    key = F.col("p_partkey")
    name = lambda k: F.concat(F.lit("P"), k)
    part = td.table(spark, sf_dir, "part")
    facts = part.select(name(key).alias("from_type"), F.lit("x").alias("to_type"), F.lit("calls").alias("relationship"))
    pairs = part.where(key >= 2).select(name(key).alias("sub"), name(F.floor(key / 2)).alias("super"))
    scope = part.where(key % 10 == 0).select(name(key).alias("fqn"))
    return detail.with_inherited(facts, scope, pairs).select("from_type", "inherited")


@register("method_details", _MEMBERS + " SELECT member_key, CASE WHEN bits & 8 > 0 THEN 1 ELSE 0 END AS is_static, ln AS line_from FROM m")
def method_details(spark, sf_dir):
    members = _members(spark, sf_dir)
    parameters = spark.createDataFrame([], "method_key string, index int, name string, type_fqn string, annotations string")
    rows = detail.method_details(members, parameters, td.trade_dependencies(spark, sf_dir))
    return rows.select("member_key", F.array_contains("modifiers", "static").cast("int").alias("is_static"), "line_from")


@register("field_details", f"{with_(TRADE)} SELECT s.s_fqn || '#long total' AS member_key, (SELECT count(DISTINCT c_fqn || '#' || ln) FROM f WHERE f.s_fqn = s.s_fqn AND kind = 'casts') AS readers, (SELECT count(DISTINCT c_fqn || '#' || ln) FROM f WHERE f.s_fqn = s.s_fqn AND kind = 'instantiates') AS writers FROM su s")
def field_details(spark, sf_dir):
    """Distinct readers and writers of a field of each supplier."""
    suppliers = td.trade_types(spark, sf_dir).where("kind = 'INTERFACE'")
    fields = suppliers.select(F.col("fqn").alias("owner_fqn"), F.concat("fqn", F.lit("#long total")).alias("member_key"), F.lit("FIELD").alias("kind"), F.lit("total").alias("name"), F.lit("long total").alias("signature"), F.lit(16).alias("modifiers"))
    facts = td.trade_dependencies(spark, sf_dir)
    used = F.when(F.col("relationship") == "casts", "reads_field").when(F.col("relationship") == "instantiates", "writes_field").otherwise(F.col("relationship"))
    facts = facts.withColumns({"relationship": used, "to_key": F.concat("to_type", F.lit("#long total"))})
    return detail.field_details(fields, facts).select("member_key", "readers", "writers")


@register("display_names", f"{with_(TRADE)} SELECT CASE WHEN ln <= 3 THEN c_fqn || '.line' || ln ELSE 'external.member ' || c_fqn || '#void line' || ln || '()' END AS shown, count(*) AS n FROM f WHERE kind = 'calls' GROUP BY 1")
def display_names(spark, sf_dir):
    """Names of calling members; those that no member row defines are external."""
    members = _members(spark, sf_dir).where("line_from <= 3")
    rows = detail.display_names(td.trade_dependencies(spark, sf_dir).where("relationship = 'calls'"), members, "from_key")
    return rows.groupBy(F.col("from_key_name").alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@register("facts_between_known", f"{with_(TRADE)} SELECT c_region AS artifact, count(*) AS n FROM f WHERE c_region <> 'ASIA' AND s_region <> 'ASIA' GROUP BY 1")
def facts_between_known(spark, sf_dir):
    types = td.trade_types(spark, sf_dir).where("artifact <> 'ASIA'")
    return detail.between_known(td.trade_dependencies(spark, sf_dir), types).groupBy("artifact").agg(F.count(F.lit(1)).alias("n"))


# --- streams ----------------------------------------------------------------------------------------------------------


@register("rescanned", "SELECT user_id AS module, count(*) AS n FROM events WHERE user_id % 7 <> 0 AND user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, 2 * count(*) FROM events WHERE user_id % 7 = 0 GROUP BY 1")
def rescanned(spark, sf_dir):
    """Modules by sevens are scanned anew (twice the facts), odd ones are no longer declared."""
    events = td.change_stream(spark, sf_dir).select("module", "event_id")
    changed = events.where("module % 7 = 0").select("module").distinct()
    fresh = events.where("module % 7 = 0")
    declared = events.where("module % 2 = 0").select("module").distinct()
    return ch.rescanned(events, fresh.unionByName(fresh), changed, declared).groupBy("module").agg(F.count(F.lit(1)).alias("n"))
