"""DuckDB SQL for the operators that SQL can express on whole tables."""

#: CRC-32 of a short ASCII text, a step for each bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''),
  lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

_TOLD = "sha256({0})".format(" || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")))


def _tree(name: str, base: str) -> str:
    """Levels of the trees over ``base(grp, pos, node)``, whose last node is where ``n`` is 1."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, pos, node, count(*) OVER (PARTITION BY grp) AS n FROM {base}
  UNION ALL
  SELECT grp, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3)"""


def _folds(name: str, base: str, tree: str) -> str:
    """What the leaves ``base(key, grp, pos, node)`` and the nodes beside their paths give, level by level."""
    return f"""{name} AS (
  SELECT key, grp, 0 AS lvl, pos, node, '' AS sibs FROM {base}
  UNION ALL
  SELECT f.key, f.grp, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.node ELSE t.node END, '' ORDER BY t.pos)),
    any_value(f.sibs) || coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), '')
  FROM {name} f JOIN {tree} t ON t.grp = f.grp AND t.lvl = f.lvl AND t.pos // 3 = f.pos // 3 AND t.n > 1 GROUP BY f.key, f.grp, f.lvl, f.pos)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS grp, {_TOLD.format(text="text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN {_TOLD.format(text="replace(text, chr(10), '')")} ELSE {_TOLD.format(text="text")} END AS seen
  FROM documents),
placed AS (SELECT *, row_number() OVER (ORDER BY grp, doc_id NULLS FIRST, leaf) AS key, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
base AS (SELECT grp, pos, leaf AS node FROM placed),
{_tree("nodes", "base")},
subs AS (SELECT grp AS name, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos FROM nodes WHERE n = 1),
top_base AS (SELECT '' AS grp, pos, subroot AS node FROM subs),
{_tree("tops", "top_base")},
low AS (SELECT key, grp, pos, seen AS node FROM placed),
{_folds("folds", "low", "nodes")},
ends AS (SELECT key, arg_max(node, lvl) AS node, arg_max(sibs, lvl) AS sibs FROM folds GROUP BY key),
high AS (SELECT e.key, '' AS grp, s.pos, e.node FROM ends e JOIN placed p USING (key) JOIN subs s ON s.name = p.grp),
{_folds("top_folds", "high", "tops")},
top_ends AS (SELECT key, arg_max(node, lvl) AS node, arg_max(sibs, lvl) AS sibs FROM top_folds GROUP BY key)
SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, sha256(e.sibs || t.sibs) AS proof_sha256, t.node AS folded_root, t.node = r.node AS verified
FROM placed p JOIN subs s ON s.name = p.grp JOIN ends e USING (key) JOIN top_ends t USING (key) JOIN tops r ON r.n = 1
"""

ORACLE_SQL = {"op13_merkle_manifest": MERKLE}
