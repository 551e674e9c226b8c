"""Restructuring views: modules and moves applied to a fork of a hierarchy.

Moves act on containers.  A container (module or package) has a place, its module and qualified name, and a *final* container
that holds its content now.  A move rewrites the places below the selected nodes: into a module under their own names, or into
a package under a new name.  Where a place is taken, the container there takes the content, and the mover's final container
becomes that one; finals compose, so a later move of an emptied package follows its content.  Types stay with the container
they are declared in, and are resolved through its final container once, after all moves; only types that a move selects
get a container of their own.  So a move costs joins over the containers, whatever the number of types.

Selectors are resolved against the base hierarchy, targets against the hierarchy at the move.  Real nodes keep their ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions.names import handle_of, matches_pattern, node_handle, package_of, simple_name
from canopy.operators.filters import kind_filter
from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.views import MOST_FINDINGS, Effect, Finding, Selector, View, changed_weights
from canopy.plans.materialize import stage_table
from canopy.schema import EXTERNAL_NAME, MODULE, PACKAGE, ROOT_KEY, SCOPE_TYPE_KINDS, TYPE_KINDS

#: Codes of findings with their severities.
SEVERITIES = {
    "SELECTOR_MATCHES_NOTHING": "warning", "WITHIN_MATCHES_NOTHING": "warning", "NODE_IN_TWO_GROUPS": "error", "MEMBER_INSIDE_OTHER_GROUPS_MEMBER": "error",
    "MEMBER_INSIDE_OWN_MEMBER": "warning", "MEMBERS_WITH_DIFFERENT_PARENTS": "error", "EMPTY_GROUP": "warning", "GROUP_HANDLE_COLLISION": "error",
    "MOVE_SELECTS_NOTHING": "warning", "UNKNOWN_MOVE_TARGET": "error", "AMBIGUOUS_MOVE_TARGET": "error", "NODE_MOVED_TWICE": "error", "MOVE_INTO_OWN_SUBTREE": "error",
    "CANNOT_MOVE": "error", "MOVE_OF_MERGED_PACKAGE": "error", "VIRTUAL_HANDLE_COLLISION": "error", "VIRTUAL_MODULE_EMPTY": "warning", "REAL_MODULE_EMPTY": "info", "SPLIT_PACKAGE": "info",
}


def module_key(view: str, name: str) -> str:
    return f"view:{view}:module:{name}"


def package_keys(view: str, module: Column, fqn: Column) -> Column:
    return F.concat(F.lit(f"view:{view}:package:"), module, F.lit("/"), fqn)


@dataclass
class Restructured:
    """The fork, its virtual modules by name, what was found, ``place(id, fqn, module, new_module, package, new_package)`` of
    all types by the names of their modules and packages, and the effect on modules.  Unless ``applied``, the graph is the base."""

    graph: DependencyGraph
    virtual_modules: dict[str, int]
    findings: list[Finding]
    place: DataFrame | None = None
    effect: Effect | None = None
    applied: bool = True


def prefixes(fqn: str) -> Column:
    """Every package on the way down to ``fqn``, itself included; none for the empty name."""
    parts = F.split(fqn, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(F.col(fqn) == "", F.array().cast("array<string>")).otherwise(every)


def matching(graph: DependencyGraph, selector: Selector) -> DataFrame:
    """``(id, kind)`` of nodes that a selector matches; ``within`` matches the nodes they must lie below."""
    out = graph.nodes.where(matches_pattern(F.col("qualified_name"), selector.match) & kind_filter([selector.kind] if selector.kind else None) & (F.col("kind") != "root"))
    if selector.within is not None:
        anchors = graph.nodes.where(matches_pattern(F.col("qualified_name"), selector.within)).select(F.col("id").alias("ancestor"))
        below = graph.closure().where("depth > 0").join(anchors, "ancestor", "left_semi").select(F.col("descendant").alias("id")).distinct()
        out = out.join(below, "id", "left_semi")
    return out.select("id", "kind")


@dataclass
class _Run:
    graph: DependencyGraph
    view: View
    findings: list[Finding] = field(default_factory=list)
    modules: dict[str, int] = field(default_factory=dict)

    def found(self, code: str, where: str, message: str) -> None:
        self.findings.append(Finding(code, SEVERITIES[code], message, where))

    def report(self, where: str, *found: tuple[str, DataFrame, str]) -> None:
        """A finding for each row's ``name`` of each ``(code, rows, message)``, as many as a report shows; one job for all."""
        rows = None
        for k, (_, named, _) in enumerate(found):
            own = named.select(F.lit(k).alias("k"), "name")
            rows = own if rows is None else rows.unionByName(own)
        for r in rows.orderBy("k", "name").limit(MOST_FINDINGS).collect():
            code, _, message = found[r["k"]]
            self.found(code, where, f"{r['name']} {message}")

    # --- the state: containers, and types that were moved by themselves

    def begin(self) -> None:
        g, spark = self.graph, self.graph.nodes.sparkSession
        tops = g.top_of().withColumnRenamed("top", "module")
        of_kind = lambda *k: g.nodes.where(F.col("kind").isin(*k)).select("id", "kind", "name", "qualified_name").join(tops, "id")
        is_module = F.col("kind") == MODULE
        shown = of_kind(MODULE, PACKAGE).select(
            "id", F.when(is_module, F.col("qualified_name")).otherwise(F.col("name")).alias("name"), F.when(is_module, F.lit("")).otherwise(F.col("qualified_name")).alias("fqn"), "module", F.lit(False).alias("virtual"), F.lit(True).alias("alive"),
            F.col("id").alias("final"), F.lit(False).alias("blocked"),
        )
        virtual = [(self.modules[m], m, "", self.modules[m], True, True, self.modules[m], False) for m in self.view.modules]
        self.containers = stage_table(shown.unionByName(spark.createDataFrame(virtual, shown.schema)) if virtual else shown)
        self.types = stage_table(of_kind(*SCOPE_TYPE_KINDS).withColumnRenamed("module", "base_module").join(g.tree.select(F.col("node_id").alias("id"), F.col("parent_id").alias("container")), "id"))
        self.moved_types = stage_table(self.types.where(F.lit(False)).select("id", "container"))
        external = g.nodes.where((F.col("kind") == MODULE) & (F.col("qualified_name") == EXTERNAL_NAME)).select("id").first()
        self.external = external["id"] if external else None

    def modules_by_name(self) -> DataFrame:
        return self.containers.where("fqn = '' AND alive").select(F.col("id").alias("module"), F.col("name").alias("module_name"))

    def located_types(self) -> DataFrame:
        """Types with the container, module and package that hold them now."""
        own = self.types.join(self.moved_types.withColumnRenamed("container", "other"), "id", "left").withColumn("container", F.coalesce("other", "container")).drop("other")
        finals = self.containers.select(F.col("id").alias("container"), "final")
        places = self.containers.select(F.col("id").alias("final"), "module", F.col("fqn").alias("package"))
        return own.join(finals, "container").join(places, "final").drop("container").withColumnRenamed("final", "container")

    # --- selection

    def select(self) -> None:
        """``picks(move, id, kind)``: outermost selected nodes, each for the first move that selects it."""
        every, rows = [], None
        for i, move in enumerate(self.view.moves):
            own = stage_table(matching(self.graph, move.select), narrow=True)
            if own.isEmpty():
                self.found("MOVE_SELECTS_NOTHING", f"moves[{i}]", f"{move.select.match} selects nothing")
            every.append(own.withColumn("move", F.lit(i)))
        for own in every:
            rows = own if rows is None else rows.unionByName(own)
        inner = self.graph.closure().where("depth > 0").join(rows.select("move", F.col("id").alias("ancestor")), "ancestor").select("move", F.col("descendant").alias("id")).distinct()
        outer = stage_table(rows.join(inner, ["move", "id"], "left_anti").withColumn("first", F.min("move").over(Window.partitionBy("id"))))
        named = outer.where("move > first").join(self.graph.nodes.select("id", F.col("qualified_name").alias("name")), "id")
        for r in named.select("move", "first", "name").orderBy("move", "name").limit(MOST_FINDINGS).collect():
            self.found("NODE_MOVED_TWICE", f"moves[{r['move']}]", f"{r['name']} is already moved by moves[{r['first']}]")
        self.picks = stage_table(outer.where("move = first").select("move", "id", "kind"), narrow=True)

    def target(self, i: int, to: str) -> tuple[int, str] | None:
        """Module and package of a move's target; the package is empty for the module itself."""
        module, _, package = to.partition("/")
        if module in self.modules:
            return self.modules[module], package
        real = self.containers.where("fqn = '' AND alive AND NOT virtual").where(matches_pattern(F.col("name"), module))
        rows = [r["id"] for r in real.select("id").limit(MOST_FINDINGS).collect()]
        usable = [x for x in rows if x != self.external]
        if len(usable) == 1:
            return usable[0], package
        why = f"matches {len(usable)} modules" if usable else "names code that was not scanned" if rows else "names no module"
        self.found("AMBIGUOUS_MOVE_TARGET" if usable else "UNKNOWN_MOVE_TARGET", f"moves[{i}]", f"the target {to} {why}; the move is skipped")
        return None

    # --- moves

    def apply(self, i: int) -> None:
        to = self.view.moves[i].to
        picked = self.picks.where(F.col("move") == i)
        if picked.isEmpty() or (target := self.target(i, to)) is None:
            return
        where, (module, package) = f"moves[{i}]", target
        into_package = package != ""
        named = picked.join(self.graph.nodes.select("id", F.col("qualified_name").alias("name")), "id").join(self.graph.top_of(), "id")
        is_external = F.col("top") == self.external if self.external is not None else F.lit(False)
        movable = F.col("kind").isin(PACKAGE, *TYPE_KINDS) | ((F.col("kind") == MODULE) & F.lit(not into_package))
        refused = [("CANNOT_MOVE", named.where(is_external), "holds code that was not scanned"), ("CANNOT_MOVE", named.where(~is_external & ~movable), "is not moved: a module is only merged into a module, and members stay with their types")]
        named = stage_table(named.where(~is_external & movable), narrow=True)

        # A package that was emptied is where its content went, unless that is a package of the graph with content of its own.
        places = self.containers.select(F.col("id").alias("final"), F.col("module").alias("from_module"), F.col("fqn").alias("from_fqn"))
        followed = named.where(F.col("kind").isin(MODULE, PACKAGE)).join(self.containers.select("id", "final", "blocked"), "id")
        refused.append(("MOVE_OF_MERGED_PACKAGE", followed.where("blocked"), "was merged into a package with content of its own; this move is skipped"))
        sources = followed.where("NOT blocked").join(places, "final").select("name", "final", "from_module", "from_fqn").dropDuplicates(["final"])
        if into_package:
            inside = (F.col("from_module") == module) & ((F.col("from_fqn") == package) | F.lit(package).startswith(F.concat("from_fqn", F.lit("."))))
            refused.append(("MOVE_INTO_OWN_SUBTREE", sources.where(inside), f"cannot move into {package}, which lies inside it"))
            sources = sources.where(~inside)
        self.report(where, *refused)
        renamed = F.concat(F.lit(package + "."), simple_name(F.col("from_fqn"))) if into_package else F.col("from_fqn")
        rewrites = stage_table(sources.where(F.col("from_module") != module if not into_package else F.lit(True)).select("from_module", "from_fqn", renamed.alias("to_fqn")), narrow=True)
        kinds = named.where(F.col("kind").isin(*TYPE_KINDS)).select("id")
        self.rewrite(module, package, rewrites, into_package, stage_table(kinds, narrow=True))

    def rewrite(self, module: int, package: str, rewrites: DataFrame, rename: bool, types: DataFrame) -> None:
        """Places below ``rewrites(from_module, from_fqn, to_fqn)`` go to ``module``, and single types with them."""
        below = self.containers.where("alive").withColumn("from_fqn", F.explode(F.concat(F.array(F.lit("")), prefixes("fqn")))).join(rewrites.withColumnRenamed("from_module", "module"), ["module", "from_fqn"])
        # Where selected nodes lie in one another by now, the innermost decides.
        below = below.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.length("from_fqn").desc()))).where("rank = 1")
        new_fqn = F.concat("to_fqn", F.expr("substring(fqn, length(from_fqn) + 1)"))
        moving = stage_table(below.select("id", "name", "fqn", "module", "virtual", "blocked", F.lit(module).cast("long").alias("new_module"), new_fqn.alias("new_fqn")).where("module <> new_module OR fqn <> new_fqn"))

        type_rows = self.located_types()
        chosen = type_rows.join(types, "id", "left_semi")
        selected = self.picks.select("id")
        outers = F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\$")) - 1), lambda n: F.array_join(F.slice(F.split("name", r"\$"), 1, n), "$"))
        nested = type_rows.where("instr(name, '$') > 0").join(selected, "id", "left_anti").withColumn("outer", F.explode(outers)).drop("qualified_name")
        follow = nested.join(chosen.select("module", "package", F.col("name").alias("outer"), "qualified_name"), ["module", "package", "outer"]).dropDuplicates(["id"])
        to_package = (lambda name: F.lit(package)) if rename else (lambda name: package_of(F.col(name)))
        moved = stage_table(chosen.select("id", to_package("qualified_name").alias("fqn")).unionByName(follow.select("id", to_package("qualified_name").alias("fqn"))))

        # Places that must exist: every package down to where something goes.
        wanted = moving.select(F.col("new_fqn").alias("fqn")).unionByName(moved.select("fqn"))
        if rename:
            wanted = wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(package).alias("fqn")))
        wanted = wanted.select(F.explode(prefixes("fqn")).alias("fqn")).distinct().withColumn("module", F.lit(module).cast("long"))
        staying = self.containers.where("alive").join(moving.select("id"), "id", "left_anti")
        taken = staying.select("module", "fqn", F.col("id").alias("keeper"), F.col("virtual").alias("keeper_virtual"))
        if rename:
            arriving = None
        else:  # the first of those that come to a free place keeps its id
            order = Window.partitionBy("new_module", "new_fqn").orderBy("module_name", "fqn", "id")
            ranked = moving.join(self.modules_by_name(), "module").withColumn("at", F.row_number().over(order)).where("at = 1")
            arriving = ranked.select(F.col("new_module").alias("module"), F.col("new_fqn").alias("fqn"), F.col("id").alias("keeper"), F.col("virtual").alias("keeper_virtual")).join(taken.select("module", "fqn"), ["module", "fqn"], "left_anti")
        held = stage_table(taken if arriving is None else taken.unionByName(arriving))
        missing = wanted.join(held.select("module", "fqn"), ["module", "fqn"], "left_anti").join(self.modules_by_name(), "module")
        fresh = missing.select(node_handle(package_keys(self.view.name, F.col("module_name"), F.col("fqn"))).alias("id"), "module", "fqn")
        created = stage_table(fresh.select("id", simple_name(F.col("fqn")).alias("name"), "fqn", "module", F.lit(True).alias("virtual"), F.lit(True).alias("alive"), F.col("id").alias("final"), F.lit(False).alias("blocked")), narrow=True)
        held = held.unionByName(created.select("module", "fqn", F.col("id").alias("keeper"), F.lit(True).alias("keeper_virtual")))

        gone = moving.join(held.select(F.col("module").alias("new_module"), F.col("fqn").alias("new_fqn"), "keeper", "keeper_virtual"), ["new_module", "new_fqn"])
        gone = stage_table(gone.select("id", "new_module", "new_fqn", "keeper", (~F.col("keeper_virtual")).alias("real")))
        own = gone.select("id", "new_module", "new_fqn", (F.col("keeper") == F.col("id")).alias("kept"))
        after = gone.where("keeper <> id").select(F.col("id").alias("final"), "keeper", "real")
        state = self.containers.join(own, "id", "left").join(after, "final", "left").select(
            "id", "name", F.when(F.col("kept"), F.col("new_fqn")).otherwise(F.col("fqn")).alias("fqn"), F.when(F.col("kept"), F.col("new_module")).otherwise(F.col("module")).alias("module"), "virtual",
            (F.col("alive") & F.coalesce("kept", F.lit(True))).alias("alive"), F.coalesce("keeper", "final").alias("final"), (F.col("blocked") | F.coalesce("real", F.lit(False))).alias("blocked"),
        )
        self.containers = stage_table(state.unionByName(created))
        # The module's own container holds what has no package.
        holders = self.containers.where("alive").where(F.col("module") == module).select("fqn", F.col("id").alias("container"))
        others = self.moved_types.join(moved.select("id"), "id", "left_anti")
        self.moved_types = stage_table(others.unionByName(moved.join(holders, "fqn").select("id", "container")))

    # --- the end

    def collisions(self) -> list[str]:
        made = self.containers.where("virtual").select("id", "name")
        taken = made.join(self.graph.nodes.select("id"), "id", "left_semi").unionByName(made.groupBy("id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "name"))
        return [r["name"] for r in taken.limit(MOST_FINDINGS).collect()]

    def finished(self) -> Restructured:
        g, view = self.graph, self.view
        located = stage_table(self.located_types())
        needed = located.select("module", F.explode(prefixes("package")).alias("fqn")).distinct()
        packages = stage_table(self.containers.where("alive AND fqn <> ''").join(needed, ["module", "fqn"], "left_semi"))
        modules = self.containers.where("alive AND fqn = ''")
        places = modules.select("module", "fqn", "id").unionByName(packages.select("module", "fqn", "id"))
        up = packages.select("id", F.col("module").alias("m"), package_of(F.col("fqn")).alias("fqn"))
        spots = places.select(F.col("module").alias("m"), "fqn", F.col("id").alias("parent_id"))
        tree = modules.select(F.col("id").alias("node_id"), F.lit(handle_of(ROOT_KEY)).alias("parent_id"))
        tree = tree.unionByName(up.join(spots, ["m", "fqn"]).select(F.col("id").alias("node_id"), "parent_id"))
        tree = tree.unionByName(located.select("id", F.col("module").alias("m"), F.col("package").alias("fqn")).join(spots, ["m", "fqn"]).select(F.col("id").alias("node_id"), "parent_id"))
        ours = g.nodes.where(F.col("kind").isin(MODULE, PACKAGE, *SCOPE_TYPE_KINDS)).select(F.col("id").alias("node_id"))
        rest = g.tree.join(ours, "node_id", "left_anti").select("node_id", "parent_id")
        live = places.select("id")
        removed = g.nodes.where(F.col("kind").isin(MODULE, PACKAGE)).select("id").join(live, "id", "left_anti")
        virtual = packages.where("virtual").join(self.modules_by_name(), "module").select("id", package_keys(view.name, F.col("module_name"), F.col("fqn")).alias("key"), F.lit(PACKAGE).alias("kind"), "name", F.col("fqn").alias("qualified_name"))
        virtual = virtual.unionByName(modules.where("virtual").select("id", F.concat(F.lit(f"view:{view.name}:module:"), F.col("name")).alias("key"), F.lit(MODULE).alias("kind"), "name", F.col("name").alias("qualified_name")))
        nodes = g.nodes.select("id", "key", "kind", "name", "qualified_name", "modifiers").join(removed, "id", "left_anti").unionByName(virtual.withColumn("modifiers", F.lit(0)))
        fork = g.fork(tree=stage_table(tree.unionByName(rest)), nodes=stage_table(nodes))

        names = g.nodes.where(F.col("kind") == MODULE).select(F.col("id").alias("base_module"), F.col("qualified_name").alias("old"))
        parents = g.nodes.where(F.col("kind") == PACKAGE).select(F.col("id").alias("parent_id"), F.col("qualified_name").alias("old_package"))
        base = g.tree.select(F.col("node_id").alias("id"), "parent_id").join(parents, "parent_id", "left").select("id", F.coalesce("old_package", F.lit("")).alias("old_package"))
        place = located.join(names, "base_module").join(self.modules_by_name(), "module").join(base, "id")
        place = stage_table(place.select("id", F.col("qualified_name").alias("fqn"), F.col("old").alias("module"), F.col("module_name").alias("new_module"), F.col("old_package").alias("package"), F.col("package").alias("new_package")))
        self.report_modules(place, modules)
        before, after = (place.select(F.col("id"), F.col(c).alias("module")) for c in ("module", "new_module"))
        weigh = lambda where: g.edges.join(where.select(F.col("id").alias("from_id"), F.col("module").alias("from_module")), "from_id").join(where.select(F.col("id").alias("to_id"), F.col("module").alias("to_module")), "to_id").where("from_module <> to_module").groupBy("from_module", "to_module").agg(F.sum("weight").alias("weight"))
        return Restructured(fork, self.modules, self.findings, place, changed_weights(stage_table(weigh(before), narrow=True), stage_table(weigh(after), narrow=True)))

    def report_modules(self, place: DataFrame, modules: DataFrame) -> None:
        full = place.select(F.col("new_module").alias("name")).distinct()
        left = place.select(F.col("module").alias("name")).distinct().join(full, "name", "left_anti").join(modules.where("NOT virtual").select("name"), "name", "left_semi")
        empty = ("VIRTUAL_MODULE_EMPTY", modules.where("virtual").select("name").join(full, "name", "left_anti"), "receives nothing; it stays empty")
        homes = lambda package, module: place.where(F.col(package) != "").select(F.col(package).alias("name"), F.col(module).alias("in")).distinct()
        now, was = homes("new_package", "new_module"), homes("package", "module")
        gained = now.join(was, ["name", "in"], "left_anti").select("name").distinct()
        split = now.join(gained, "name", "left_semi").groupBy("name").agg(F.array_join(F.sort_array(F.collect_set("in")), ", ").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shown = split.select(F.concat("name", F.lit(" ("), "all", F.lit(")")).alias("name"))
        self.report("moves", empty, ("REAL_MODULE_EMPTY", left, "is left empty; it stays in the view"), ("SPLIT_PACKAGE", shown, "now has types in several modules"))


def restructure(graph: DependencyGraph, view: View) -> Restructured:
    """The modules and moves of a view, applied in the order of the document."""
    run = _Run(graph, view)
    run.modules = {m: handle_of(module_key(view.name, m)) for m in view.modules}
    if len(run.modules) < len(view.modules):
        raise QueryError("INVALID_VIEW_DOCUMENT", "two virtual modules have one name")
    run.begin()
    run.select() if view.moves else None
    for i in range(len(view.moves)):
        run.apply(i)
    if taken := run.collisions():
        run.found("VIRTUAL_HANDLE_COLLISION", "moves", f"ids of virtual nodes are taken: {taken}; the view is not applied")
        return Restructured(graph, {}, run.findings, applied=False)
    return run.finished()
