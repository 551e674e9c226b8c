"""Common table expressions of the oracle SQL: the graphs of :mod:`canopy.sources.testdata`, from the driver's tables."""

TRADE = """
nat AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cu AS (SELECT c_custkey, r_name AS c_region, n_name AS c_nation, n_name || '.C' || c_custkey AS c_fqn FROM customer JOIN nat ON c_nationkey = n_nationkey),
su AS (SELECT s_suppkey, r_name AS s_region, n_name AS s_nation, n_name || '.S' || s_suppkey AS s_fqn FROM supplier JOIN nat ON s_nationkey = n_nationkey),
f AS (SELECT c_fqn, s_fqn, c_region, s_region, c_nation, s_nation, l_linenumber AS ln, l_orderkey,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'extends' WHEN 'AO' THEN 'implements' WHEN 'NF' THEN 'annotated_by' WHEN 'NO' THEN 'calls' WHEN 'RF' THEN 'instantiates' WHEN 'RO' THEN 'casts' ELSE 'calls' END AS kind
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey JOIN su ON l_suppkey = s_suppkey),
e AS (SELECT c_fqn, s_fqn, min(c_region) AS c_region, min(s_region) AS s_region, min(c_nation) AS c_nation, min(s_nation) AS s_nation, count(*) AS weight,
        CAST(max(CASE WHEN kind = 'extends' THEN 1 ELSE 0 END) + max(CASE WHEN kind = 'implements' THEN 2 ELSE 0 END) + max(CASE WHEN kind = 'annotated_by' AND ln = 1 THEN 4 ELSE 0 END)
          + max(CASE WHEN kind NOT IN ('extends', 'implements', 'annotated_by') OR (kind = 'annotated_by' AND ln <> 1) THEN 8 ELSE 0 END) AS INTEGER) AS attrs
      FROM f GROUP BY c_fqn, s_fqn)"""

NODES = """
nodes AS (
  SELECT r.r_name AS qn, 'java.module' AS kind, r.r_name AS name, r.r_name AS module, NULL AS package FROM region r WHERE r.r_name IN (SELECT c_region FROM cu UNION SELECT s_region FROM su)
  UNION ALL SELECT DISTINCT n_name, 'java.package', n_name, r_name, n_name FROM nat WHERE n_name IN (SELECT c_nation FROM cu UNION SELECT s_nation FROM su)
  UNION ALL SELECT c_fqn, 'java.class', 'C' || c_custkey, c_region, c_nation FROM cu
  UNION ALL SELECT s_fqn, 'java.interface', 'S' || s_suppkey, s_region, s_nation FROM su)"""


def sequence() -> str:
    return """
pt AS (SELECT p_partkey, p_brand, replace(replace(p_brand, '.', '_'), '#', '_') || '_' || replace(replace(p_type, ' ', '_'), '.', '_') AS package,
         replace(replace(p_brand, '.', '_'), '#', '_') || '_' || replace(replace(p_type, ' ', '_'), '.', '_') || '.P' || p_partkey AS fqn FROM part),
ld AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nxt FROM lineitem),
sp AS (SELECT l_partkey AS a, nxt AS b FROM ld WHERE nxt IS NOT NULL AND nxt <> l_partkey),
g AS (SELECT x.fqn AS a, y.fqn AS b, min(x.p_brand) AS a_brand, min(y.p_brand) AS b_brand, min(x.package) AS a_package, min(y.package) AS b_package, count(*) AS weight
      FROM sp JOIN pt x ON a = x.p_partkey JOIN pt y ON b = y.p_partkey GROUP BY x.fqn, y.fqn)"""


def handle(key: str) -> str:
    """SQL of a node's id from the SQL of its key."""
    return f"(CAST('0x' || substr(sha256({key}), 3, 14) AS BIGINT) & 9007199254740991)"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)


#: The library of classes: ``pk`` its types, ``anc`` their supertypes, ``m`` methods, ``st`` stored and ``dv`` derived facts.
LIBRARY = """
pk AS (SELECT p_partkey AS k, p_brand AS artifact, replace(replace(p_brand, '.', '_'), '#', '_') || '.P' || p_partkey AS fqn FROM part),
anc AS (SELECT k, k // 2 AS a, 1 AS depth FROM pk WHERE k >= 1 UNION ALL SELECT k, a // 2, depth + 1 FROM anc WHERE a >= 1),
m AS (SELECT k, j, fqn || '#void m' || j || '()' AS key, k % 13 = 0 AS priv, k % 11 = 0 AS stat FROM pk, (VALUES (0), (1), (2), (3)) t(j) WHERE (k + j) % 3 = 0),
ld AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS nxt FROM lineitem),
ca AS (SELECT DISTINCT x.k AS f, x.fqn AS from_type, y.k AS t, y.fqn AS to_type, CAST(l_linenumber AS INTEGER) AS line FROM ld JOIN pk x ON l_partkey = x.k JOIN pk y ON nxt = y.k WHERE nxt IS NOT NULL),
cl AS (SELECT f, from_type, from_type || '#void m' || (line % 4) || '()' AS from_key, t, to_type, (line + 1) % 4 AS j, to_type || '#void m' || ((line + 1) % 4) || '()' AS to_key, line FROM ca),
st AS (SELECT x.k AS f, x.fqn AS from_key, y.k AS t, y.fqn AS to_key, CAST(NULL AS BIGINT) AS j, CASE WHEN x.k % 3 = 0 THEN 'implements' ELSE 'extends' END AS rel, CAST(NULL AS INTEGER) AS line FROM pk x JOIN pk y ON y.k = x.k // 2
  UNION ALL SELECT f, from_key, t, to_key, j, 'calls', line FROM cl
  UNION ALL SELECT f, from_type || '#void m' || (line % 4) || '()', t, to_type || '#int size', -1, CASE WHEN line % 2 = 0 THEN 'reads_field' ELSE 'writes_field' END, line FROM ca WHERE line <= 2),
dr AS (
  SELECT x.k AS f, x.key AS from_key, y.k AS t, y.key AS to_key, 'overrides' AS rel, CAST(x.j + 1 AS INTEGER) AS line FROM m x JOIN anc ON anc.k = x.k JOIN m y ON y.k = anc.a AND y.j = x.j WHERE NOT (x.priv OR x.stat OR y.priv OR y.stat)
  UNION SELECT c.f, c.from_key, i.k, i.key, 'calls', c.line FROM cl c LEFT JOIN m d ON d.k = c.t AND d.j = c.j JOIN anc ON anc.a = c.t JOIN m i ON i.k = anc.k AND i.j = c.j WHERE NOT coalesce(d.stat, false) AND NOT (i.priv OR i.stat) AND i.key <> c.from_key
  UNION SELECT f, from_key, t, to_key, 'calls', line FROM (
    SELECT c.f, c.from_key, i.k AS t, i.key AS to_key, c.line, row_number() OVER (PARTITION BY c.f, c.from_key, c.t, c.j, c.line ORDER BY anc.depth) AS r
    FROM cl c JOIN anc ON anc.k = c.t JOIN m i ON i.k = anc.a AND i.j = c.j WHERE NOT i.priv AND NOT EXISTS (SELECT 1 FROM m d WHERE d.k = c.t AND d.j = c.j)) WHERE r = 1 AND to_key <> from_key),
dv AS (SELECT * FROM dr WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.from_key = dr.from_key AND st.to_key = dr.to_key AND st.rel = dr.rel)),
decl AS (SELECT t, j, arg_min(key, depth) AS declared_key FROM (
    SELECT w.t, w.j, m.key, anc.depth FROM (SELECT DISTINCT t, j FROM cl) w JOIN anc ON anc.k = w.t JOIN m ON m.k = anc.a AND m.j = w.j WHERE NOT EXISTS (SELECT 1 FROM m d WHERE d.k = w.t AND d.j = w.j)
    UNION ALL SELECT w.t, -1, pk.fqn || '#int size', anc.depth FROM (SELECT DISTINCT t FROM cl WHERE t % 4 <> 0) w JOIN anc ON anc.k = w.t JOIN pk ON pk.k = anc.a WHERE pk.k % 4 = 0) GROUP BY t, j)"""
