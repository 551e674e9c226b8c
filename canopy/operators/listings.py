"""Listings as a client sees them: filtered, totally ordered rows, summaries over all of them, and pages behind a cursor.

A listing's rows are written once; summaries and pages read what was written.  A page is at most ``limit`` rows and at most
``PAGE_CHARACTERS`` of JSON, and tells where the next one begins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions.hashing import query_hash
from canopy.operators import aggregate as agg
from canopy.operators import reach, search
from canopy.operators.filters import kind_filter
from canopy.operators.hierarchy import DependencyGraph
from canopy.plans.materialize import stage_table

TOP = 10


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    returned: int
    next_cursor: str | None


@dataclass(frozen=True)
class Listing:
    """``rows`` (written) with the columns that order them, and what the cursor is bound to."""

    tool: str
    rows: DataFrame
    order: tuple[str, ...]
    query_hash: str
    data_hash: str = ""
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    def total(self) -> int:
        if "total" not in self._cache:
            self._cache["total"] = self.rows.count()
        return self._cache["total"]

    def page(self, limit: int = 100, cursor: str | None = None, most: int = 300, characters: int = search.PAGE_CHARACTERS) -> Page:
        """The rows from the cursor on; refused if it belongs to another request or state, or if one row exceeds the budget."""
        offset = 0 if cursor is None else search.Cursor.decode(cursor).validate(self.tool, self.query_hash, self.data_hash).offset
        ordered = self.rows.orderBy(*self.order)
        wanted = stage_table(search.page(ordered, offset, limit, most), narrow=True)
        shown = stage_table(search.within_budget(wanted, list(self.order), characters), narrow=True)
        returned = shown.count()
        size = F.length(F.to_json(F.struct(*shown.columns)))
        if returned == 1 and (shown.agg(F.max(size)).first()[0] or 0) > characters:
            raise QueryError("RESPONSE_TOO_LARGE", f"one row has more than {characters} characters", "narrow the scope: pass the other side, a smaller node or a filter")
        end = offset + returned
        following = search.Cursor(self.tool, self.query_hash, self.data_hash, end).encode() if end < self.total() else None
        return Page(shown.orderBy(*self.order), self.total(), returned, following)

    def top(self, by: str, limit: int = TOP) -> DataFrame:
        """``(by, n, weight, others)``: the groups with most rows and how many further groups there are."""
        weight = F.sum("weight") if "weight" in self.rows.columns else F.count(F.lit(1))
        groups = stage_table(self.rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), weight.cast("long").alias("weight")), narrow=True)
        others = max(0, groups.count() - limit)
        return groups.orderBy(F.col("n").desc(), by).limit(limit).withColumn("others", F.lit(others).cast("long"))

    def by_attribute(self) -> DataFrame:
        """``(attribute, edges)`` over all rows; every attribute is there."""
        return agg.attribute_counts(self.rows)

    def by_kind(self) -> DataFrame:
        """``(kind, weight)`` over all rows."""
        return agg.kinds_of(self.rows)


def dependency_listing(graph: DependencyGraph, from_id: int | None = None, to_id: int | None = None, incoming: bool = False, data_hash: str = "") -> Listing:
    """Type dependencies out of a subtree (into another), or with ``incoming`` into one; edges keep their direction."""
    if from_id is None and to_id is None:
        raise QueryError("INVALID_PARAMETER", "at least one scope is needed")
    known = {r["id"] for r in graph.nodes.where(F.col("id").isin(*[i for i in (from_id, to_id) if i is not None])).select("id").collect()}
    if missing := [i for i in (from_id, to_id) if i is not None and i not in known]:
        raise QueryError("NODE_NOT_FOUND", f"no node with id {missing[0]} exists", "look the node up by its name")
    rows = agg.dependencies_into(graph, to_id, from_id) if incoming else agg.dependencies_between(graph, from_id, to_id) if from_id is not None else agg.dependencies_into(graph, to_id)
    order = ("to_name", "from_name", "to_id", "from_id") if incoming else ("from_name", "to_name", "from_id", "to_id")
    tool = "incoming_dependencies" if incoming else "outgoing_dependencies"
    return Listing(tool, stage_table(rows), order, query_hash({"fromId": from_id, "toId": to_id}), data_hash)


def affected_listing(graph: DependencyGraph, node_id: int, incoming: bool = True, max_depth: int | None = None, kinds: Sequence[str] | None = None, data_hash: str = "") -> tuple[Listing, DataFrame]:
    """What (transitively) depends on a subtree, nearest first, and all that was reached, for paths.

    A kind filters the result, not the search.
    """
    reached = stage_table(reach.affected(graph, node_id, incoming, max_depth))
    shown = graph.nodes.where(kind_filter(kinds)).select("id", "kind", "qualified_name")
    modules = graph.top_of().join(graph.nodes.select(F.col("id").alias("top"), F.col("qualified_name").alias("module")), "top").select("id", "module")
    rows = reached.join(shown, "id").join(modules, "id").select("distance", "qualified_name", "id", "kind", "module", "via")
    arguments = query_hash({"nodeId": node_id, "direction": "incoming" if incoming else "outgoing", "maxDepth": max_depth, "kinds": None if kinds is None else list(kinds)})
    return Listing("affected_by", stage_table(rows), ("distance", "qualified_name", "id"), arguments, data_hash), reached


def with_paths(page: DataFrame, reached: DataFrame) -> DataFrame:
    """A page's rows with ``path``: the ids from the start to the row's node, along the nodes they were reached by."""
    rows = page.withColumn("path", F.when(F.col("via").isNull(), F.array("id")).otherwise(F.array("via", "id"))).withColumn("__at", F.col("via"))
    steps = reached.select(F.col("id").alias("__at"), F.col("via").alias("__up"))
    deepest = page.agg(F.max("distance")).first()[0] or 0
    for _ in range(1, deepest):
        rows = rows.join(steps, "__at", "left")
        rows = rows.withColumn("path", F.when(F.col("__up").isNull(), F.col("path")).otherwise(F.concat(F.array("__up"), "path"))).withColumn("__at", F.col("__up")).drop("__up")
        rows = stage_table(rows, narrow=True)  # a page's rows
    return rows.drop("__at")
