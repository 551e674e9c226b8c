"""Queries on intervals, roll-ups, placed levels, restructuring views, field inheritance and SQL functions, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from canopy.functions.names import handle_of
from canopy.functions.sql import register_functions
from canopy.operators import detail, ingest, intervals, placement, rollups
from canopy.operators.restructure import restructure
from canopy.operators.views import parse_view
from canopy.plans.materialize import delete_path, shared_dir, stage_table
from canopy.plans.oracle import LIBRARY, NODES, TRADE, handle, with_, with_recursive
from canopy.plans.queries_graph import named
from canopy.plans.registry import register
from canopy.sources import archives
from canopy.sources import testdata as td

# --- intervals --------------------------------------------------------------------------------------------------------


@register("interval_sizes", f"{with_(TRADE, NODES)} SELECT qn AS node, CASE kind WHEN 'java.module' THEN (SELECT count(*) FROM nodes x WHERE x.module = n.qn) - 1 WHEN 'java.package' THEN (SELECT count(*) FROM nodes x WHERE x.package = n.qn) - 1 ELSE 0 END AS descendants FROM nodes n UNION ALL SELECT '', (SELECT count(*) FROM nodes)")
def interval_sizes(spark, sf_dir):
    """How many nodes lie below each, from the two numbers of its interval."""
    g = td.trade_graph(spark, sf_dir)
    rows = intervals.interval_tree(g).descendant_counts()
    return named(rows, g.nodes, node="id").select("node", "descendants")


@register("interval_pairs", f"{with_(TRADE)} SELECT a.k AS source, b.k AS target, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS type_pairs, bit_or(attrs) AS attrs FROM e, (SELECT r_name AS k FROM region UNION SELECT n_name FROM nation) a, (SELECT r_name AS k FROM region) b WHERE a.k IN (c_region, c_nation) AND b.k = s_region GROUP BY 1, 2")
def interval_pairs(spark, sf_dir):
    """Dependencies of every region and nation on every region, by ranges of numbers."""
    g = td.trade_graph(spark, sf_dir)
    of = lambda *kinds: sorted(r["id"] for r in g.nodes.where(F.col("kind").isin(*kinds)).select("id").collect())  # noqa: E731  thirty rows
    rows = intervals.interval_tree(g).aggregated_pairs(of("java.module", "java.package"), of("java.module"))
    return named(rows.withColumnsRenamed({"source": "i", "target": "j"}), g.nodes, source="i", target="j").select("source", "target", "weight", "type_pairs", "attrs")


# --- roll-up over the fixed path ------------------------------------------------------------------------------------------


_KINDS = ("extends", "implements", "annotated_by", "calls", "instantiates", "casts")
_ROLLUP = f"""{with_(TRADE)}, k AS (SELECT c_fqn, s_fqn, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS)} FROM f GROUP BY 1, 2),
t AS (SELECT c_region AS module, c_nation AS package, c_fqn AS fqn, 1 AS classes, 0 AS interfaces FROM cu UNION ALL SELECT s_region, s_nation, s_fqn, 0, 1 FROM su),
r AS (SELECT module, package, classes, interfaces, 0 AS edges, 0 AS weight, 0 AS crossing, 0 AS attrs, {', '.join(f'0 AS {k}' for k in _KINDS)} FROM t
  UNION ALL SELECT c_region, c_nation, 0, 0, 1, weight, CASE WHEN c_region <> s_region THEN 1 ELSE 0 END, attrs, {', '.join(_KINDS)} FROM e JOIN k USING (c_fqn, s_fqn))
SELECT CASE grouping(module, package) WHEN 3 THEN 'graph' WHEN 1 THEN 'module' ELSE 'package' END AS level, module, package, CAST(sum(classes) AS BIGINT) AS classes, CAST(sum(interfaces) AS BIGINT) AS interfaces, CAST(sum(edges) AS BIGINT) AS edges,
  CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(crossing) AS BIGINT) AS crossing, CAST(sum(attrs & 1) AS BIGINT) AS is_extends, CAST(sum((attrs >> 3) & 1) AS BIGINT) AS is_other, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in _KINDS)}
FROM r GROUP BY ROLLUP (module, package)"""


@register("overview_rollup", _ROLLUP)
def overview_rollup(spark, sf_dir):
    """Nodes by kind, edges by attribute and weight by kind of the graph, its modules and packages, from one pass."""
    rows = rollups.path_rollup(td.trade_graph(spark, sf_dir)).where("level <> 'type'")
    of = lambda column, key: F.coalesce(F.try_element_at(column, F.lit(key)), F.lit(0).cast("long"))
    return rows.select(
        "level", "module", "package", of("nodes_by_kind", "java.class").alias("classes"), of("nodes_by_kind", "java.interface").alias("interfaces"), "edges", "weight", "crossing", of("edges_by_attribute", "is_extends").alias("is_extends"),
        of("edges_by_attribute", "is_depends_on_other").alias("is_other"), *[of("weight_by_kind", k).alias(k) for k in _KINDS],
    )


# --- placed levels ----------------------------------------------------------------------------------------------------


_GROUPS = (placement.LevelGroup("pinned"), placement.LevelGroup("lifted", span=True, min_level=15), placement.LevelGroup("top", place=1))
_SIZES = {"pinned": (7, 8), "lifted": (8, 9), "top": (11,)}
_PLACED = f"""{with_recursive(
    "pk AS (SELECT p_partkey AS n, CASE WHEN p_size IN (7, 8) THEN 0 WHEN p_size = 9 THEN 1 WHEN p_size = 11 THEN 2 END AS grp FROM part)",
    "ky AS (SELECT n, grp, CASE WHEN grp IN (0, 2) THEN -1 - grp ELSE n END AS key FROM pk)",
    "ed AS (SELECT x.n AS a, y.n AS b FROM pk x JOIN pk y ON y.n = x.n // 2 AND x.n <> y.n)",
    "ke AS (SELECT DISTINCT x.key AS a, y.key AS b FROM ed JOIN ky x ON x.n = a JOIN ky y ON y.n = b WHERE x.key <> y.key)",
    "rc AS (SELECT DISTINCT key AS a, key AS b FROM ky UNION SELECT rc.a, ke.b FROM rc JOIN ke ON rc.b = ke.a)",
    "co AS (SELECT x.a AS key, min(x.b) AS core FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY 1)",
    "ce AS (SELECT DISTINCT x.core AS a, y.core AS b FROM ke JOIN co x ON x.key = a JOIN co y ON y.key = b WHERE x.core <> y.core)",
    "wy AS (SELECT DISTINCT core AS a, core AS b, 0 AS d FROM co UNION SELECT wy.a, ce.b, d + 1 FROM wy JOIN ce ON wy.b = ce.a)",
    "l0 AS (SELECT a AS core, max(d) AS level FROM wy GROUP BY 1)",
    "m0 AS (SELECT n, grp, core, level FROM ky JOIN co USING (key) JOIN l0 USING (core))",
    "lf AS (SELECT greatest(15 - min(level), 0) AS lift FROM m0 WHERE grp = 1)",
    "fl AS (SELECT core, max(CASE WHEN grp = 1 AND lift > 0 THEN level + lift ELSE 0 END) AS floor FROM m0, lf GROUP BY 1)",
    "l1 AS (SELECT a AS core, max(d + floor) AS level FROM wy JOIN fl ON fl.core = wy.b GROUP BY 1)",
    "m1 AS (SELECT n, grp, l1.level FROM m0 JOIN l1 USING (core))",
    "lv AS (SELECT n, grp, CASE WHEN grp = 2 THEN 1 + (SELECT max(level) FROM m1 WHERE grp IS DISTINCT FROM 2) ELSE level END AS level FROM m1)",
)} SELECT a AS from_part, b AS to_part, CAST(x.level AS INTEGER) AS from_level, CAST(y.level AS INTEGER) AS to_level, CASE WHEN x.level > y.level THEN 0 WHEN x.level < y.level THEN 1 WHEN x.grp = y.grp AND x.grp IN (0, 2) THEN 3 ELSE 2 END AS class
FROM ed JOIN lv x ON x.n = a JOIN lv y ON y.n = b"""


@register("placed_levels", _PLACED)
def placed_levels(spark, sf_dir):
    """Edges from each part to the part of half its number, under a pinned, a lifted and a placed group of parts by size."""
    part = td.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    edges = part.select(F.col("id").alias("from_id"), F.floor(F.col("id") / 2).alias("to_id")).where("from_id <> to_id").join(part.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    sizes = spark.createDataFrame([(name, size) for name, own in _SIZES.items() for size in own], "name string, p_size int")
    members = part.withColumn("p_size", F.col("p_size").cast("int")).join(F.broadcast(sizes), "p_size").select("name", "id")
    levels = placement.placed_levels(part.select("id"), edges, _GROUPS, members)
    return placement.violations(edges, levels).select(F.col("from_id").alias("from_part"), F.col("to_id").alias("to_part"), "from_level", "to_level", "class")


# --- restructuring views ------------------------------------------------------------------------------------------------


def _restructured(spark, sf_dir):
    """Regions under a view: one nation gets a module of its own, one becomes part of a package elsewhere, a region joins another."""
    moves = [
        {"select": {"match": "NATION_4", "kind": "java.package"}, "to": "EUROPE/united"},
        {"select": {"match": "NATION_3", "kind": "java.package"}, "to": "NEW"},
        {"select": {"match": "ASIA", "kind": "java.module"}, "to": "EUROPE"},
        {"select": {"match": "NATION_5.C*0", "kind": "types"}, "to": "NEW/united.NATION_4"},
        {"select": {"match": "NATION_4", "kind": "java.package", "within": "ASIA"}, "to": "AFRICA"},
    ]
    view = parse_view(json.dumps({"name": "v", "restructure": True, "modules": [{"name": "NEW"}], "moves": moves}))
    return restructure(td.trade_graph(spark, sf_dir), view)


_PLACE = f"""{with_(TRADE)}, t AS (SELECT c_fqn AS fqn, c_region AS r, c_nation AS n FROM cu UNION ALL SELECT s_fqn, s_region, s_nation FROM su),
p AS (SELECT fqn, r AS module, CASE WHEN n = 'NATION_4' THEN 'EUROPE' WHEN n = 'NATION_3' THEN 'NEW' WHEN regexp_matches(fqn, '^NATION_5\\.C[^:]*0$') THEN 'NEW' WHEN r = 'ASIA' THEN 'EUROPE' ELSE r END AS new_module,
  CASE WHEN n = 'NATION_4' THEN 'united.NATION_4' WHEN regexp_matches(fqn, '^NATION_5\\.C[^:]*0$') THEN 'united.NATION_4' ELSE n END AS new_package FROM t)"""


@register("restructured_place", f"{_PLACE} SELECT * FROM p")
def restructured_place(spark, sf_dir):
    """Module and package of every type before and after the moves of a view."""
    return _restructured(spark, sf_dir).place.select("fqn", "module", "new_module", "new_package")


@register("restructured_modules", f"""{_PLACE}, w AS (SELECT a.module AS fm, b.module AS tm, a.new_module AS fn, b.new_module AS tn, weight FROM e JOIN p a ON a.fqn = c_fqn JOIN p b ON b.fqn = s_fqn),
x AS (SELECT fm AS from_module, tm AS to_module, CAST(sum(weight) AS BIGINT) AS before FROM w WHERE fm <> tm GROUP BY 1, 2), y AS (SELECT fn AS from_module, tn AS to_module, CAST(sum(weight) AS BIGINT) AS after FROM w WHERE fn <> tn GROUP BY 1, 2)
SELECT from_module, to_module, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change FROM x FULL JOIN y USING (from_module, to_module) WHERE before IS DISTINCT FROM after""")
def restructured_modules(spark, sf_dir):
    """What the view changes between modules."""
    return _restructured(spark, sf_dir).effect.changes.select("from_module", "to_module", "before", "after", "change")


# --- fields and their heirs -------------------------------------------------------------------------------------------


_FIELDS = f"""{with_recursive(LIBRARY)},
meant AS (SELECT x.k AS t, max_by(a.k, a.up) AS owner FROM pk x JOIN (SELECT k, k AS a, 0 AS up FROM pk UNION ALL SELECT k, a, -depth FROM anc) y ON y.k = x.k JOIN (SELECT k AS kk FROM pk WHERE k % 4 = 0) d ON d.kk = y.a JOIN LATERAL (SELECT y.a AS k, y.up AS up) a ON true GROUP BY 1),
ac AS (SELECT DISTINCT m.owner, st.from_key, split_part(st.from_key, '#', 1) AS from_type, st.rel FROM st JOIN meant m ON m.t = st.t WHERE st.rel IN ('reads_field', 'writes_field')),
tp AS (SELECT owner, rel, from_type, count(*) AS n FROM ac GROUP BY 1, 2, 3)
SELECT fqn || '#int size' AS member_key, (SELECT count(*) FROM ac WHERE owner = k AND rel = 'reads_field') AS readers, (SELECT count(*) FROM ac WHERE owner = k AND rel = 'writes_field') AS writers,
  coalesce((SELECT string_agg(from_key, ' ' ORDER BY from_key) FROM (SELECT from_key FROM ac WHERE owner = k AND rel = 'reads_field' ORDER BY from_key LIMIT 10)), '') AS first_readers,
  (SELECT from_type FROM tp WHERE owner = k AND rel = 'writes_field' ORDER BY n DESC, from_type LIMIT 1) AS top_writer, greatest((SELECT count(*) FROM tp WHERE owner = k AND rel = 'writes_field') - 10, 0) AS other_writers
FROM pk WHERE k % 4 = 0"""


@register("field_heirs", _FIELDS)
def field_heirs(spark, sf_dir):
    """Readers and writers of every field, also through types that inherit it and don't hide it."""
    rows = detail.field_details(td.library_members(spark, sf_dir), td.library_facts(spark, sf_dir))
    return rows.select(
        "member_key", "readers", "writers", F.coalesce(F.array_join("readers_sample", " "), F.lit("")).alias("first_readers"), F.get("writers_by_type", F.lit(0))["type"].alias("top_writer"), F.col("writers_other_types").alias("other_writers")
    )


# --- functions in SQL -------------------------------------------------------------------------------------------------


_HANDLE = handle("'type:' || length(artifact) || ':' || artifact || ':' || split_part(key, '#', 1)")


@register("functions_in_sql", f"""{with_recursive(LIBRARY)} SELECT m.key AS member_key, {_HANDLE} AS owner_id, CASE WHEN priv THEN 'private' ELSE 'public' END || CASE WHEN stat THEN ' static' ELSE '' END AS modifiers
FROM m JOIN pk ON pk.k = m.k WHERE j IN (1, 2) AND m.k % 10 = 1""")
def functions_in_sql(spark, sf_dir):
    """Members by a name pattern with their owners' ids and modifiers, in SQL alone."""
    register_functions(spark)
    td.library_members(spark, sf_dir).createOrReplaceTempView("canopy_library_members")
    return spark.sql(
        "SELECT member_key, node_handle(type_key(artifact, owner_fqn)) AS owner_id, array_join(decode_modifiers(modifiers, 'method'), ' ') AS modifiers FROM canopy_library_members "
        "WHERE kind = 'METHOD' AND member_key RLIKE name_pattern_regex('**.P*1#void {m1,m2}()')"
    )


# --- archives ---------------------------------------------------------------------------------------------------------


@register("archived_types", f"{with_(TRADE)} SELECT c_fqn AS fqn, c_region AS artifact, 'CLASS' AS kind, 1 AS modifiers FROM cu UNION ALL SELECT s_fqn, s_region, 'INTERFACE', 33 FROM su")
def archived_types(spark, sf_dir):
    """Types written as archives, one or more for each artifact, and read back through the data source."""
    folder = f"{shared_dir(spark)}/canopy-archives-{uuid.uuid4().hex}"
    written = archives.write_archives(td.trade_types(spark, sf_dir), "types", folder)
    stage_table(written, narrow=True)  # the job that writes them
    rows = archives.read_archive_tables(spark, folder, "types").select("fqn", "artifact", "kind", "modifiers")
    rows = stage_table(rows)
    delete_path(spark, folder)
    return rows


# --- handles ----------------------------------------------------------------------------------------------------------


_KEYS = "k AS (SELECT CASE kind WHEN 'java.module' THEN qn WHEN 'java.package' THEN 'pkg:' || module || ':' || qn ELSE 'type:' || length(module) || ':' || module || ':' || qn END AS key FROM nodes UNION ALL SELECT '<root>')"


@register("crowded_handles", f"{with_(TRADE, NODES, _KEYS)} SELECT {handle('key')} % 97 AS id, count(DISTINCT key) AS keys FROM k GROUP BY 1 HAVING count(DISTINCT key) > 1")
def crowded_handles(spark, sf_dir):
    """Which of 97 numbers several keys would share, were handles that short."""
    nodes = td.trade_graph(spark, sf_dir).nodes
    return ingest.handle_collisions(nodes.withColumn("id", F.col("id") % 97))
