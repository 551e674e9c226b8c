"""A graph kept up to date by signed deltas: only changed modules' facts are read again.

A :class:`LiveGraph` has the tables of one generation: types, rolled-up references by module, resolved references between
types, edges and nodes.  When modules change, their facts are rolled up anew.  What no longer holds counts -1, what holds
now +1: references of the changed modules, and references of any module to names whose definers changed (their targets may
move to another module, to a placeholder or from it).  Deltas are summed by pair of types, and only pairs with a delta get
a new edge.  A generation is written as a whole; until it is, queries read the one before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.operators import ingest
from canopy.operators.hierarchy import DependencyGraph
from canopy.plans.materialize import release, stage_table

Placeholders = Callable[[Column], Column]
_PAIR = ["from_id", "to_id", "kind", "type_level"]


@dataclass(frozen=True)
class LiveGraph:
    """One generation: ``types(artifact, fqn, kind, modifiers)`` as scanned, ``references`` as rolled up, ``resolved`` between
    ids, and ``edges``."""

    types: DataFrame
    references: DataFrame
    resolved: DataFrame
    edges: DataFrame
    generation: int = 1
    placeholders: Placeholders | None = None

    def graph(self) -> DependencyGraph:
        """The graph of the generation; nodes follow from the names."""
        nodes = ingest.graph_nodes(_known(self.types, self.references, self.placeholders))
        return DependencyGraph(nodes.drop("path"), ingest.tree_of(nodes), self.edges, extensions={"paths": nodes}, _cache={"closure": ingest.closure_of(nodes)})


def _known(types: DataFrame, references: DataFrame, placeholders: Placeholders | None) -> DataFrame:
    known = types.select("artifact", "fqn", ingest.type_kind(F.col("kind")).alias("kind"), "modifiers")
    return known if placeholders is None else known.unionByName(ingest.external_placeholders(references, types, placeholders))


def _resolved(references: DataFrame, definers: DataFrame) -> DataFrame:
    """References between ids, of owners that are types, with what ``definers(artifact, fqn)`` say.

    Ids are computed once for each type.  A reference has one row, and what a name means follows from owner and name, so two
    rows of an artifact never become one.
    """
    return ingest.resolved_edges(references, definers, columns=("kind", "type_level", "n"))


def start(types: DataFrame, facts: DataFrame, placeholders: Placeholders | None = None) -> LiveGraph:
    """The first generation, from all facts."""
    types = stage_table(types.select("artifact", "fqn", "kind", "modifiers"))
    references = stage_table(ingest.rollup(facts))
    resolved = stage_table(_resolved(references, _known(types, references, placeholders)))
    return LiveGraph(types, references, resolved, stage_table(ingest.type_dependencies(resolved)), placeholders=placeholders)


def changed_modules(live: LiveGraph, changed: DataFrame, types: DataFrame, facts: DataFrame) -> LiveGraph:
    """The next generation, where the modules ``changed(artifact)`` have these ``types`` and ``facts``; with none of either a
    module is gone."""
    changed = F.broadcast(stage_table(changed.select("artifact").distinct(), narrow=True)) if _few(changed) else stage_table(changed.select("artifact").distinct())
    of_changed = lambda rows, how: rows.join(changed, "artifact", how)
    old_types, new_types = of_changed(live.types, "left_semi"), of_changed(types.select(live.types.columns), "left_semi")
    old_refs, new_refs = of_changed(live.references, "left_semi"), stage_table(ingest.rollup(of_changed(facts, "left_semi")))
    all_types = stage_table(of_changed(live.types, "left_anti").unionByName(new_types))
    all_refs = stage_table(of_changed(live.references, "left_anti").unionByName(new_refs))

    # Names that gained or lost a definer: whoever refers to them may mean another type now.
    pair = ["artifact", "fqn"]
    gone, come = (a.select(pair).distinct().join(b.select(pair).distinct(), pair, "left_anti") for a, b in ((old_types, new_types), (new_types, old_types)))
    moved = stage_table(gone.unionByName(come).select(F.col("fqn").alias("to_type")).distinct())
    # A placeholder is a definer too: it ends when a name is defined, or when no module refers to it.
    asked = (old_refs.unionByName(new_refs)).select("to_type").distinct()
    touched = stage_table(moved.unionByName(asked).distinct()) if live.placeholders is not None else moved
    elsewhere = of_changed(live.references, "left_anti").join(moved, "to_type", "left_semi")
    before, after = old_refs.unionByName(elsewhere), new_refs.unionByName(elsewhere)

    def said(refs: DataFrame, all_refs: DataFrame, types: DataFrame, sign: int) -> DataFrame:
        """Resolved rows of ``refs``, with the definers of their names and owners only."""
        wanted = refs.select(F.col("to_type").alias("fqn")).unionByName(refs.select(F.col("from_type").alias("fqn"))).distinct()
        own = types.join(wanted, "fqn", "left_semi")
        known = _known(own, all_refs.join(touched, "to_type", "left_semi") if live.placeholders is not None else refs, live.placeholders)
        return _resolved(refs, known).withColumn("n", F.col("n") * sign)

    delta = said(before, live.references, live.types, -1).unionByName(said(after, all_refs, all_types, 1))
    delta = stage_table(delta.groupBy(*_PAIR).agg(F.sum("n").alias("n")).where("n <> 0"))
    resolved = stage_table(live.resolved.unionByName(delta).groupBy(*_PAIR).agg(F.sum("n").alias("n")).where("n > 0"))
    pairs = delta.select("from_id", "to_id").distinct()
    renewed = ingest.type_dependencies(resolved.join(pairs, ["from_id", "to_id"], "left_semi"))
    edges = stage_table(live.edges.join(pairs, ["from_id", "to_id"], "left_anti").unionByName(renewed))
    release(moved, delta)
    return LiveGraph(all_types, all_refs, resolved, edges, live.generation + 1, live.placeholders)


_FEW = 10_000


def _few(changed: DataFrame) -> bool:
    """Whether the names of changed modules are few enough to be sent to every task."""
    return changed.select("artifact").distinct().limit(_FEW + 1).count() <= _FEW


class Maintainer:
    """For ``foreachBatch``: each batch of changed modules makes a generation; one that fails leaves the last one in place.

    ``read(artifacts)`` gives types and facts of modules by name, so that a partitioned source prunes all others.
    """

    def __init__(self, live: LiveGraph, read: Callable[[list[str]], tuple[DataFrame, DataFrame]]) -> None:
        self.live, self.read = live, read
        self.failures: list[tuple[int, Exception]] = []
        self._last_batch = -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self._last_batch:  # a batch that is delivered again has been applied
            return
        names_changed = sorted(r["module"] for r in batch.select("module").distinct().collect())  # modules of one batch
        if names_changed:
            spark = batch.sparkSession
            changed = spark.createDataFrame([(x,) for x in names_changed], "artifact string")
            try:
                self.live = changed_modules(self.live, changed, *self.read(names_changed))
            except Exception as error:  # the previous generation stays; the caller sees why
                self.failures.append((batch_id, error))
        self._last_batch = batch_id
