"""Member-level dependencies between any two scopes: stored and derived facts in one plan.

A :class:`DetailStore` has the facts of one snapshot with the graph built from them.  Names are resolved once for each
(artifact, name), not for each fact: a fact's owner is its own artifact's type, its target what that artifact's classpath
picks.  Facts that no scan can see (overrides, dispatched and inherited calls) belong to a generation; an answer derives those
between its scopes only, since all of them are many times the stored ones.

An answer joins facts with the two scopes.  What the depending side inherits is code it runs, so its supertypes belong to
the scope, unless they lie in the target scope; their rows are marked.  A stored reference to a member that its static type
only inherits points at the declaration, with the static type as receiver; a derived call that says the same is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions import names
from canopy.functions.names import handle_of
from canopy.operators import aggregate as agg
from canopy.operators import detail, ingest
from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.reach import breadth_first
from canopy.plans.materialize import scratch, stage_table
from canopy.schema import DEPENDENCY_KINDS, EXTENDS_BIT, EXTERNAL_ARTIFACT, EXTERNAL_TYPE, MEMBER_KINDS, REVERSED_KINDS, ROOT_KEY

#: The relationships whose facts have a parameter's position.
PARAMETER_KINDS = ("parameter_type", "parameter_annotated_by")
_ENDS = {"from_key": "to_key", "from_type": "to_type", "from_id": "to_id", "from_artifact": "to_artifact"}
_SWAPPED = _ENDS | {v: k for k, v in _ENDS.items()}


def _is_member(key: str) -> Column:
    return F.contains(key, F.lit("#"))


@dataclass(frozen=True)
class DetailStore:
    """``types(artifact, fqn, kind, modifiers)``, ``members`` and ``facts`` with their ``artifact``, and their graph."""

    graph: DependencyGraph
    types: DataFrame
    members: DataFrame
    facts: DataFrame
    classpath: DataFrame | None = None
    generation: str = "0"
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = stage_table(build())
        return self._cache[name]

    def definers(self) -> DataFrame:
        """Types of the graph, external ones included, as ``(artifact, fqn, id)``."""
        return self._once("definers", self._definers)

    def _definers(self) -> DataFrame:
        nodes = self.graph.nodes
        own = self.types.select("artifact", "fqn").distinct().withColumn("id", names.node_handle(names.type_key(F.col("artifact"), F.col("fqn")))).join(nodes.select("id"), "id", "left_semi")
        external = nodes.where(F.col("kind") == EXTERNAL_TYPE).select(F.lit(EXTERNAL_ARTIFACT).alias("artifact"), F.col("qualified_name").alias("fqn"), "id")
        return own.select("artifact", "fqn", "id").unionByName(external).distinct()

    def first(self) -> DataFrame:
        """``(fqn, artifact, id)``: the least artifact that defines each name."""
        return self._once("first", lambda: self.definers().groupBy("fqn").agg(F.min(F.struct("artifact", "id")).alias("d")).select("fqn", "d.artifact", "d.id"))

    def hierarchy(self) -> DataFrame:
        """The graph's edges to supertypes, from these facts alone."""
        facts = self.facts.where(F.col("relationship").isin("extends", "implements"))
        return self._once("hierarchy", lambda: ingest.resolved_edges(ingest.type_references(facts), self.definers(), self.classpath).select("from_id", "to_id", "weight", "attrs"))

    def prepared(self) -> DetailStore:
        """The store with its tables written."""
        for table in (self.definers, self.first, self.hierarchy, self.member_ids):
            table()
        return self

    def stored(self) -> DataFrame:
        """Facts both of whose types are in the graph, with ``from_id``, ``to_id`` and the target's artifact."""
        return self._once("stored", self.stored_between)

    def stored_between(self, source: DataFrame | None = None, target: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """:meth:`stored`, of facts ``where`` a condition holds, from ``source(id)`` and to ``target(id)`` only where given."""
        known, rows = self.definers(), self.facts if where is None else self.facts.where(where)
        scopes = {side: ids if ids is None else stage_table(ids.select("id").distinct()) for side, ids in (("from", source), ("to", target))}
        for side, ids in scopes.items():
            if ids is not None:
                # A name of the scope may still mean another artifact's type.
                rows = detail.among_types(rows, f"{side}_type", stage_table(known.join(ids, "id", "left_semi").select("fqn").distinct()))
        out = rows = rows if source is None and target is None else stage_table(rows)
        pairs = lambda c: rows.select("artifact", F.col(c).alias("to_type")).distinct()
        resolve = ingest.resolve_owner_first if self.classpath is None else lambda rows, types: ingest.resolve_classpath(rows, types, self.classpath)
        for side, resolved in (("from", ingest.resolve_owner_first(pairs("from_type"), known)), ("to", resolve(pairs("to_type"), known))):
            found = resolved.where("to_artifact IS NOT NULL").select("artifact", F.col("to_type").alias(f"{side}_type"), F.col("to_artifact").alias(f"{side}_artifact"))
            located = found.withColumn(f"{side}_id", names.node_handle(names.type_key(F.col(f"{side}_artifact"), F.col(f"{side}_type"))))
            if scopes[side] is not None:
                located = located.join(scopes[side].select(F.col("id").alias(f"{side}_id")), f"{side}_id", "left_semi")
            out = out.join(located, ["artifact", f"{side}_type"])
        return out.select(*_FACT, F.lit(False).alias("derived"))

    def derived(self) -> DataFrame:
        """Facts that follow from the type hierarchy of all artifacts, in the form of :meth:`stored`."""
        return self._once("derived", self.derived_between)

    def derived_between(self, source: DataFrame | None = None, target: DataFrame | None = None, kinds: Sequence[str] = detail.DERIVABLE) -> DataFrame:
        """:meth:`derived` of some kinds, from ``source(id)`` and to ``target(id)`` only where given."""
        scoped = {side: self.first() if ids is None else stage_table(self.first().join(ids.select("id").distinct(), "id", "left_semi")) for side, ids in (("from", source), ("to", target))}
        names_of = lambda side, ids: ids if ids is None else scoped[side].select("fqn")
        rows = detail.derived(self.facts, self._own_members(), self.types, names_of("from", source), names_of("to", target), kinds)
        for side, types in scoped.items():
            located = types.select(F.col("fqn").alias(f"{side}_type"), F.col("artifact").alias(f"{side}_artifact"), F.col("id").alias(f"{side}_id"))
            rows = rows.join(F.broadcast(located) if types.limit(_MOST_LOCATED + 1).count() <= _MOST_LOCATED else located, f"{side}_type")
        return rows.withColumns({"parameter_index": F.lit(None).cast("int"), "parameter_name": F.lit(None).cast("string")}).select(*_FACT, F.lit(True).alias("derived"))

    def _own_members(self) -> DataFrame:
        """Members of the types that :meth:`first` names."""
        return self.members.join(self.first().select("artifact", F.col("fqn").alias("owner_fqn")), ["artifact", "owner_fqn"], "left_semi")

    def derived_references(self) -> DataFrame:
        """``(to_id, to_key)`` that derived facts may have as targets."""
        located = self.first().select(F.col("fqn").alias("owner_fqn"), F.col("id").alias("to_id"))
        return self._own_members().select("owner_fqn", F.coalesce("bridge_target", "member_key").alias("to_key")).join(located, "owner_fqn").select("to_id", "to_key").distinct()

    def derived_for(self, generation: str) -> DataFrame:
        """Derived facts, none where the asking graph is of another generation."""
        return self.derived() if generation == self.generation else self.derived().where(F.lit(False))

    def member_ids(self) -> DataFrame:
        """``(owner_id, member_key, signature, member_id)``."""
        artifact = F.col("artifact")
        shown = self.members.select(names.node_handle(names.type_key(artifact, F.col("owner_fqn"))).alias("owner_id"), "member_key", F.expr("substring(member_key, instr(member_key, '#') + 1)").alias("signature"), names.node_handle(names.member_node_key(artifact, F.col("member_key"))).alias("member_id"))
        return self._once("members", lambda: shown.dropDuplicates(["member_id"]))


_FACT = ["from_key", "from_type", "from_artifact", "from_id", "to_key", "to_type", "to_artifact", "to_id", "relationship", "line", "parameter_index", "parameter_name"]


#: Types of a scope that a join sends to every task at most.
_MOST_LOCATED = 250_000


@dataclass(frozen=True)
class _Scope:
    """Types of a node's subtree; of a member its type, with the member's key."""

    types: DataFrame
    member: str | None


def _scope(store: DetailStore, node_id: int) -> _Scope:
    nodes, tree = store.graph.nodes, store.graph.tree
    found = nodes.where(F.col("id") == node_id).select("kind", "qualified_name").first()
    if found is None:
        raise QueryError("NODE_NOT_FOUND", f"no node has the id {node_id}", "look the node up by its name")
    if found["kind"] not in MEMBER_KINDS:
        return _Scope(store.graph.scope_types([node_id]).select("id"), None)
    owner = tree.where(F.col("node_id") == node_id).select(F.col("parent_id").alias("id"))
    return _Scope(owner, found["qualified_name"])


def undeclared(store: DetailStore, references: DataFrame) -> DataFrame:
    """``(to_id, to_key, signature)`` of ``references(to_id, to_key)`` to members that their receiver does not declare itself."""
    wanted = references.where(_is_member("to_key")).select("to_id", "to_key").distinct()
    # A key names its owner, so a reference names a member of its receiver where both agree.
    own = store.member_ids().select(F.col("owner_id").alias("to_id"), F.col("member_key").alias("to_key"))
    return stage_table(wanted.join(own, ["to_id", "to_key"], "left_anti").withColumn("signature", F.expr("substring(to_key, instr(to_key, '#') + 1)")))


def declarations(store: DetailStore, missing: DataFrame) -> DataFrame:
    """``(to_id, to_key, declared_id, declared_key, declarer_id)`` for what :func:`undeclared` found: superclasses first, as
    long as each has one, then the nearest supertype."""
    members = store.member_ids().select(F.col("owner_id").alias("super"), "signature", "member_key", "member_id")
    steps = store.hierarchy().select(F.col("from_id").alias("sub"), F.col("to_id").alias("super"), F.col("attrs").bitwiseAND(F.lit(1 << EXTENDS_BIT)).cast("boolean").alias("by_class"))
    single = steps.where("by_class").groupBy("sub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sub", F.lit(True).alias("several"))
    steps = steps.join(single, "sub", "left").select("sub", "super", (F.col("by_class") & F.col("several").isNull()).alias("by_class"))
    above = detail.declared_above(steps, missing.select(F.col("to_id").alias("sub"), "signature"), members)
    found = missing.join(above.withColumnRenamed("sub", "to_id"), ["to_id", "signature"]).join(members, ["super", "signature"])
    best = F.min(F.struct((~F.col("by_class")).alias("x"), "depth", "member_key", "super", "member_id"))
    return found.groupBy("to_id", "to_key").agg(best.alias("d")).select("to_id", "to_key", F.col("d.member_id").alias("declared_id"), F.col("d.member_key").alias("declared_key"), F.col("d.super").alias("declarer_id"))


def _declared(store: DetailStore, rows: DataFrame, references: DataFrame) -> DataFrame:
    """``rows`` with the :func:`declarations` of their targets, which are among ``references``."""
    missing = undeclared(store, references)
    if missing.isEmpty():
        return rows.withColumns({"declared_id": F.lit(None).cast("long"), "declared_key": F.lit(None).cast("string"), "declarer_id": F.lit(None).cast("long")})
    return rows.join(declarations(store, missing), ["to_id", "to_key"], "left")


@dataclass(frozen=True)
class DetailAnswer:
    """``rows`` in total order, and summaries over all of them."""

    rows: DataFrame
    relationship: str | None
    graph: DependencyGraph
    from_id: int | None
    to_id: int | None

    def inherited(self) -> DataFrame:
        """One row: how many rows come from supertypes."""
        return self.rows.agg(F.count_if("inherited").alias("inherited"), F.count(F.lit(1)).alias("total"))

    def by_relationship(self) -> DataFrame:
        """``(relationship, n)``; the kind asked for is there even with no row."""
        counts = detail.relationship_counts(self.rows)
        if self.relationship is None:
            return counts
        asked = self.rows.sparkSession.range(1).select(F.lit(self.relationship).alias("relationship"), F.lit(0).cast("long").alias("n"))
        return counts.unionByName(asked).groupBy("relationship").agg(F.sum("n").alias("n"))

    def by_source_type(self, limit: int = 10) -> DataFrame:
        """``(type, rows, others)``: the depending types of most rows, and how many further ones there are."""
        counts = self.rows.groupBy(F.col("from_parent").alias("type")).agg(F.count(F.lit(1)).alias("rows"))
        all_types = counts.agg(F.count(F.lit(1)).alias("n"))  # one row
        top = counts.orderBy(F.col("rows").desc(), "type").limit(limit)
        return top.join(F.broadcast(all_types), F.lit(True)).select("type", "rows", F.greatest(F.col("n") - limit, F.lit(0)).alias("others"))

    def by_source_nodes(self) -> DataFrame:
        return agg.drill_down(self.graph, handle_of(ROOT_KEY) if self.from_id is None else self.from_id, self.to_id)

    def by_target_nodes(self) -> DataFrame:
        return agg.drill_down(self.graph, handle_of(ROOT_KEY) if self.to_id is None else self.to_id, self.from_id, outgoing=False)


def detail_dependencies(store: DetailStore, from_id: int | None = None, to_id: int | None = None, relationship: str | None = None, position: int | None = None) -> DetailAnswer:
    """Facts from one scope into another; one of them may be open.

    Rows: the ids ``from_node, from_parent, to_node, to_parent`` (null where the target is a type) and ``receiver`` (where it
    is not what declares the target), ``relationship, line, parameter_index, parameter_name, inherited, derived`` and the names
    ``from_key, from_type, to_key, to_type`` as compiled and ``declared_key`` as resolved.
    """
    if relationship is not None and relationship not in DEPENDENCY_KINDS:
        raise QueryError("INVALID_RELATIONSHIP", f"unknown relationship {relationship}", "use one of the known kinds", allowed=list(DEPENDENCY_KINDS))
    if position is not None and position < 0:
        raise QueryError("INVALID_PARAMETER", f"parameter positions start at 0, not {position}")
    if position is not None and relationship is not None and relationship not in PARAMETER_KINDS:
        raise QueryError("INVALID_PARAMETER", f"{relationship} facts have no parameter position", "ask for a parameter relationship", allowed=list(PARAMETER_KINDS))
    if from_id is None and to_id is None:
        raise QueryError("INVALID_PARAMETER", "at most one scope may be open")
    source, target = (None if i is None else _scope(store.prepared(), i) for i in (from_id, to_id))
    with scratch() as keep:
        rows = keep(stage_table(_answer(store, source, target, relationship, position)))

    member = lambda side: F.when(_is_member(f"{side}_key"), names.node_handle(names.member_node_key(F.col(f"{side}_artifact"), F.col(f"{side}_key")))).otherwise(F.col(f"{side}_id"))
    shown = rows.select(
        member("from").alias("from_node"), F.col("from_id").alias("from_parent"), F.coalesce("declared_id", member("to")).alias("to_node"), F.coalesce("declarer_id", F.when(_is_member("to_key"), F.col("to_id"))).alias("to_parent"),
        F.when(F.col("declared_id").isNotNull(), F.col("to_id")).alias("receiver"), "relationship", "line", "parameter_index", "parameter_name", "inherited", "derived", "from_key", "from_type", "to_key", "to_type", F.coalesce("declared_key", "to_key").alias("declared_key"),
    )
    return DetailAnswer(shown.orderBy(*detail.fact_order()), relationship, store.graph, from_id, to_id)


def _answer(store: DetailStore, source: _Scope | None, target: _Scope | None, relationship: str | None, position: int | None) -> DataFrame:
    """The rows between two scopes with ``inherited`` and the :func:`declarations` of their targets.

    Each scope goes down to the facts: what can't be in the answer is neither resolved nor derived.
    """
    to_ids = None if target is None else stage_table(target.types.select("id").distinct())
    scope = from_ids = None
    if source is not None:
        above = breadth_first(store.hierarchy(), source.types, incoming=False).select("id")
        if target is not None:
            above = above.join(to_ids, "id", "left_anti")
        scope = stage_table(source.types.select("id", F.lit(False).alias("inherited")).distinct().unionByName(above.withColumn("inherited", F.lit(True))))
        from_ids = scope.select("id")

    def of_members(rows: DataFrame) -> DataFrame:
        """Rows of the members that are asked for, with ``inherited``."""
        rows = rows if target is None or target.member is None else rows.where(F.col("to_key") == target.member)
        if source is None:
            return rows.withColumn("inherited", F.lit(False))
        rows = rows if source.member is None else rows.where(F.col("from_key") == source.member)
        few = scope.limit(_MOST_LOCATED + 1).count() <= _MOST_LOCATED
        own = scope.withColumnRenamed("id", "from_id")
        return rows.join(F.broadcast(own) if few else own, "from_id")

    if relationship in REVERSED_KINDS:
        rows = store.stored_between(to_ids, from_ids, F.col("relationship") == REVERSED_KINDS[relationship])
        rows = rows.select(*[(F.lit(relationship) if c == "relationship" else F.col(_SWAPPED.get(c, c))).alias(c) for c in rows.columns])
    else:
        kind = F.lit(True) if relationship is None else F.col("relationship") == relationship
        rows = store.stored_between(from_ids, to_ids, kind if position is None else kind & (F.col("parameter_index") == position))
    stored = stage_table(of_members(rows))
    stored = stage_table(_declared(store, stored, stored))
    kinds = [k for k in detail.DERIVABLE if relationship in (None, k)]
    if position is not None or not kinds:
        return stored

    derived = of_members(store.derived_between(from_ids, to_ids, kinds))
    # A derived call that a stored row, pointed at the same declaration, says already.
    line = F.coalesce("line", F.lit(-1)).alias("__line")
    said = stored.where("declared_key IS NOT NULL AND parameter_index IS NULL").select("from_id", "from_key", F.col("declared_key").alias("__declared"), F.col("declarer_id").alias("__in"), "relationship", line).distinct()
    derived = derived.withColumns({"__line": line, "__declared": F.col("to_key"), "__in": F.col("to_id")}).join(said, ["from_id", "from_key", "__declared", "__in", "relationship", "__line"], "left_anti").drop("__line", "__declared", "__in")
    return stored.unionByName(_declared(store, derived, store.derived_references()))
