"""What-if hierarchies: grouping views and restructuring views over one graph."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions.names import handle_of, matches_pattern, package_of, pattern_regex, simple_name
from canopy.operators.filters import select_nodes
from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.ordering import components
from canopy.plans.materialize import stage_table

MOST_FINDINGS, MOST_NODES, MOST_MODULE_ROWS = 50, 10, 100


@dataclass(frozen=True)
class Selector:
    match: str
    kind: str | None = None
    within: str | None = None


@dataclass(frozen=True)
class Group:
    name: str
    members: tuple[Selector, ...] = ()
    groups: tuple[Group, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Move:
    select: Selector
    to: str


@dataclass(frozen=True)
class View:
    name: str
    groups: tuple[Group, ...] = ()
    restructure: bool = False
    modules: tuple[str, ...] = ()
    moves: tuple[Move, ...] = ()
    description: str | None = None


@dataclass(frozen=True)
class Finding:
    code: str
    severity: str
    message: str
    where: str = ""


def parse_view(text: str) -> View:
    """A view from JSON; all problems are collected with their places before the document is refused."""
    problems: list[str] = []

    def selector(x, at: str) -> Selector | None:
        raw = {"match": x} if isinstance(x, str) else x
        if not isinstance(raw, dict) or not isinstance(raw.get("match"), str):
            problems.append(f"{at}: a pattern or an object with 'match' is needed")
            return None
        if extra := set(raw) - {"match", "kind", "within"}:
            problems.append(f"{at}: unknown fields {sorted(extra)}")
        try:
            pattern_regex(raw["match"])
        except ValueError as e:
            problems.append(f"{at}.match: {e}")
        return Selector(raw["match"], raw.get("kind"), raw.get("within"))

    def group(x, at: str) -> Group | None:
        if not isinstance(x, dict) or not isinstance(x.get("name"), str) or not x["name"]:
            problems.append(f"{at}: a group needs a name")
            return None
        if extra := set(x) - {"name", "description", "members", "groups"}:
            problems.append(f"{at}: unknown fields {sorted(extra)}")
        members = [selector(m, f"{at}.members[{i}]") for i, m in enumerate(x.get("members", []))]
        inner = [group(g, f"{at}.groups[{i}]") for i, g in enumerate(x.get("groups", []))]
        return Group(x["name"], tuple(m for m in members if m), tuple(g for g in inner if g), x.get("description"))

    try:
        raw = json.loads(text)
    except ValueError as e:
        raise QueryError("INVALID_VIEW_DOCUMENT", f"not JSON: {e}") from e
    if not isinstance(raw, dict) or not isinstance(raw.get("name"), str) or not raw.get("name"):
        raise QueryError("INVALID_VIEW_DOCUMENT", "a view needs a name", problems=["name: missing"])
    if extra := set(raw) - {"name", "description", "restructure", "groups", "modules", "moves"}:
        problems.append(f"unknown fields {sorted(extra)}")
    groups = [group(g, f"groups[{i}]") for i, g in enumerate(raw.get("groups", []))]
    moves = []
    for i, m in enumerate(raw.get("moves", [])):
        if not isinstance(m, dict) or not isinstance(m.get("to"), str):
            problems.append(f"moves[{i}]: a move needs 'select' and 'to'")
        elif (s := selector(m.get("select"), f"moves[{i}].select")) is not None:
            moves.append(Move(s, m["to"]))
    if moves and not raw.get("restructure"):
        problems.append("moves: only a restructuring view has moves")
    if problems:
        raise QueryError("INVALID_VIEW_DOCUMENT", "; ".join(problems), problems=problems)
    names = tuple(m if isinstance(m, str) else m["name"] for m in raw.get("modules", []))
    return View(raw["name"], tuple(g for g in groups if g), bool(raw.get("restructure")), names, tuple(moves), raw.get("description"))


# --- grouping ---------------------------------------------------------------------------------------------------------


def _flat(groups: Sequence[Group], above: str = "") -> Iterator[tuple[str, str, Group]]:
    for g in groups:
        path = f"{above}/{g.name}" if above else g.name
        yield path, above, g
        yield from _flat(g.groups, path)


def resolve_groups(graph: DependencyGraph, view: View) -> tuple[DataFrame, list[Finding]]:
    """``(id, path, parent_id)`` of group members: the first group takes a node, a member inside another is dropped."""
    rows = None
    order: dict[str, int] = {}
    for path, _, g in _flat(view.groups):
        order[path] = len(order)
        for s in g.members:
            within = handle_of(s.within) if s.within else None
            found = select_nodes(graph, s.match, s.kind, within).where("kind <> 'root'").select("id", F.lit(path).alias("path"), F.lit(order[path]).alias("at"))
            rows = found if rows is None else rows.unionByName(found)
    spark = graph.nodes.sparkSession
    if rows is None:
        return spark.createDataFrame([], "id long, path string, parent_id long"), [Finding("EMPTY_VIEW", "warning", "the view has no members")]
    rank = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    ranked = stage_table(rows.distinct().withColumn("rank", rank))
    chosen = ranked.where("rank = 1").select("id", "path")
    covered = graph.closure().where("depth > 0").join(chosen.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
    members = stage_table(chosen.join(covered, "id", "left_anti").join(graph.tree.select(F.col("node_id").alias("id"), "parent_id"), "id"))
    findings = [Finding("NODE_IN_TWO_GROUPS", "warning", "a later group wanted a node that was taken", r["path"]) for r in ranked.where("rank > 1").select("path").distinct().orderBy("path").limit(MOST_FINDINGS).collect()]
    parents = {r["path"]: r["n"] for r in members.groupBy("path").agg(F.countDistinct("parent_id").alias("n")).collect()}  # one row for each group
    for path, _, g in _flat(view.groups):
        if path not in parents and not g.groups:
            findings.append(Finding("EMPTY_GROUP", "warning", "nothing matches", path))
        elif parents.get(path, 1) > 1:
            findings.append(Finding("MIXED_PARENTS", "error", "members have different parents", path))
    return members, findings


def grouped(graph: DependencyGraph, view: View) -> tuple[DependencyGraph, list[Finding]]:
    """The graph under group nodes, each where its members (or its inner groups) were."""
    members, findings = resolve_groups(graph, view)
    if any(f.severity == "error" for f in findings):
        return graph, findings
    spark = graph.nodes.sparkSession
    parent = {r["path"]: r["parent_id"] for r in members.groupBy("path").agg(F.min("parent_id").alias("parent_id")).collect()}  # one row for each group
    flat = list(_flat(view.groups))
    for path, above, _ in reversed(flat):
        if above and path in parent:
            parent.setdefault(above, parent[path])
    key = lambda path: f"view:{view.name}:{path}"
    placed = [(path, above, g) for path, above, g in flat if path in parent]
    nodes = spark.createDataFrame([(handle_of(key(p)), key(p), "view.group", g.name, key(p), 0) for p, _, g in placed], graph.nodes.select("id", "key", "kind", "name", "qualified_name", "modifiers").schema)
    tree = spark.createDataFrame([(handle_of(key(p)), handle_of(key(a)) if a in parent else parent[p]) for p, a, _ in placed], "node_id long, parent_id long")
    groups = spark.createDataFrame([(p, handle_of(key(p))) for p, _, _ in placed], "path string, group_id long")
    moved = members.join(F.broadcast(groups), "path").select(F.col("id").alias("node_id"), "group_id")  # one row for each group of the document
    under = graph.tree.join(moved, "node_id", "left").select("node_id", F.coalesce("group_id", "parent_id").alias("parent_id"))
    return graph.fork(tree=stage_table(under.unionByName(tree)), nodes=graph.nodes.unionByName(nodes)), findings


# --- restructuring ----------------------------------------------------------------------------------------------------


def moved_types(types: DataFrame, moves: Sequence[Move]) -> DataFrame:
    """``types(artifact, fqn)`` with ``new_artifact`` and ``new_fqn`` after all moves in their order.

    A move selects modules by name, packages or types by qualified name as they are after earlier moves; the target is a
    module or ``module/package``.  A package keeps its name unless a package is given, then its prefix is replaced.
    """
    out = types.select("artifact", "fqn", F.col("artifact").alias("new_artifact"), F.col("fqn").alias("new_fqn"))
    for move in moves:
        module, _, package = move.to.partition("/")
        pattern = move.select.match
        own, fqn = F.col("new_artifact"), F.col("new_fqn")
        inside = F.lit(True) if move.select.within is None else own == move.select.within
        kind = move.select.kind or ""
        as_module = matches_pattern(own, pattern) if kind in ("", "java.module") else F.lit(False)
        as_type = matches_pattern(fqn, pattern) if kind not in ("java.module", "java.package") else F.lit(False)
        matched = _matching_prefix(package_of(fqn), pattern) if kind in ("", "java.package") else F.lit(None).cast("string")
        renamed = fqn
        if package:
            tail = F.when(matched.isNotNull(), F.substr(fqn, F.length(matched) + 2)).otherwise(simple_name(fqn))
            renamed = F.when(as_module, F.concat(F.lit(package + "."), fqn)).otherwise(F.concat(F.lit(package + "."), tail))
        hit = inside & (as_module | as_type | matched.isNotNull())
        out = out.select("artifact", "fqn", F.when(hit, F.lit(module)).otherwise(own).alias("new_artifact"), F.when(hit, renamed).otherwise(fqn).alias("new_fqn"))
    return out


def _matching_prefix(package: Column, pattern: str) -> Column:
    """The shortest package on the way to ``package`` that matches, else null: the outermost selected node."""
    parts = F.split(package, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.try_element_at(F.filter(prefixes, lambda p: matches_pattern(p, pattern)), F.lit(1))


@dataclass
class Effect:
    """How dependencies between modules change: a table, and the cycles that are new."""

    changes: DataFrame
    cycles: list[list[str]] = field(default_factory=list)
    new_cycles: list[list[str]] = field(default_factory=list)


def _module_weights(type_weights: DataFrame, place: DataFrame, column: str) -> DataFrame:
    a = place.select(F.col("artifact").alias("from_artifact"), F.col("fqn").alias("from_fqn"), F.col(column).alias("from_module"))
    b = place.select(F.col("artifact").alias("to_artifact"), F.col("fqn").alias("to_fqn"), F.col(column).alias("to_module"))
    return type_weights.join(a, ["from_artifact", "from_fqn"]).join(b, ["to_artifact", "to_fqn"]).where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.sum("weight").alias("weight"))


def _cycles(weights: DataFrame) -> list[list[str]]:
    """Cycles between modules; their number is checked before any pair is fetched, as in a matrix."""
    modules = weights.select(F.explode(F.array("from_module", "to_module")).alias("m")).distinct().limit(1001).collect()
    if len(modules) > 1000:
        raise QueryError("INPUT_TOO_LARGE", "more than 1000 modules")
    rows = weights.select("from_module", "to_module").collect()
    names = sorted(r["m"] for r in modules)
    at = {n: i for i, n in enumerate(names)}
    matrix = np.zeros((len(names), len(names)), np.int64)
    for r in rows:
        matrix[at[r[0]], at[r[1]]] = 1
    return sorted(sorted(names[v] for v in own) for own in components(matrix) if len(own) > 1)


def restructuring_effect(type_weights: DataFrame, place: DataFrame) -> Effect:
    """``changes(from_module, to_module, before, after, change)`` of a restructuring, and its cycles.

    ``type_weights(from_artifact, from_fqn, to_artifact, to_fqn, weight)``; ``place`` is what :func:`moved_types` returns.
    A cycle is new unless one cycle before held all its modules.
    """
    return changed_weights(*(stage_table(_module_weights(type_weights, place, c)) for c in ("artifact", "new_artifact")))


def changed_weights(before: DataFrame, after: DataFrame) -> Effect:
    """The effect from ``(from_module, to_module, weight)`` before and after."""
    both = before.withColumnRenamed("weight", "before").join(after.withColumnRenamed("weight", "after"), ["from_module", "to_module"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    old, now = _cycles(before), _cycles(after)
    return Effect(both.withColumn("change", change).where("change IS NOT NULL"), now, [c for c in now if not any(set(c) <= set(o) for o in old)])


def split_packages_after(place: DataFrame) -> DataFrame:
    """Packages in more than one module after the moves but not before: ``(package, modules)``."""
    many = lambda artifact, fqn: place.groupBy(package_of(F.col(fqn)).alias("package")).agg(F.countDistinct(artifact).alias("modules")).where("modules > 1 AND package <> ''")
    return many("new_artifact", "new_fqn").join(many("artifact", "fqn").select("package"), "package", "left_anti")


class ViewRegistry:
    """Named views; defined ones shadow those of the project, which cannot be deleted."""

    def __init__(self, project: Sequence[View] = ()) -> None:
        self._project: dict[str, View] = {}
        for v in project:
            self._project.setdefault(v.name, v)
        self._state: dict[str, View] = {}
        self._made: dict[tuple, object] = {}

    def define(self, text: str) -> View:
        view = parse_view(text)
        self._state[view.name] = view
        self._made = {k: v for k, v in self._made.items() if k[0] != view.name}
        return view

    def names(self) -> list[str]:
        return sorted({*self._project, *self._state})

    def find(self, name: str) -> View:
        if (view := self._state.get(name) or self._project.get(name)) is None:
            raise QueryError("VIEW_NOT_FOUND", f"no view {name}", "list the views", known=self.names())
        return view

    def delete(self, name: str) -> None:
        if name in self._state:
            del self._state[name]
        elif name in self._project:
            raise QueryError("PROJECT_VIEW", f"{name} belongs to the project")
        else:
            raise QueryError("VIEW_NOT_FOUND", f"no view {name}", "list the views", known=self.names())

    def applied(self, graph: DependencyGraph, name: str, generation: str = "") -> DependencyGraph:
        """The graph under a view, made once for each generation: first its moves, then its groups over what they gave."""
        from canopy.operators.restructure import restructure

        view = self.find(name)
        if (view.name, generation, view) not in self._made:
            made, findings = graph, []
            if view.restructure:
                moved = restructure(graph, view)
                made, findings = moved.graph, list(moved.findings)
            if view.groups:
                made, more = grouped(made, view)
                findings += more
            if errors := [f for f in findings if f.severity == "error"]:
                raise QueryError("VIEW_INVALID", errors[0].message, findings=[f.__dict__ for f in findings][:MOST_FINDINGS])
            self._made[(view.name, generation, view)] = made
        return self._made[(view.name, generation, view)]
