"""Finding and listing nodes, and paging through results."""

from __future__ import annotations

import base64
import json
import time
from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators.filters import expand_kinds, kind_filter, modifier_filter, name_contains
from canopy.operators.hierarchy import DependencyGraph, child_order
from canopy.schema import MEMBER_KINDS

FOUND, LISTED = 50, 200
PAGE_CHARACTERS = 50_000
CURSOR_VERSION = 1


def find_nodes(graph: DependencyGraph, name: str, kinds: Sequence[str] | None = None, limit: int | None = FOUND) -> DataFrame:
    """Nodes whose name or qualified name contains ``name`` in any case, best first, with ``rank`` and the ``total``.

    Rank 0 is an equal name, 1 an equal qualified name, 2 a name that begins so, 3 the rest; then shorter qualified names,
    then the order of names.  Members are searched only when asked for.
    """
    wanted = F.lower(F.lit(name))
    own, full = F.lower("name"), F.lower("qualified_name")
    of_kind = kind_filter(kinds) if expand_kinds(kinds) else ~F.col("kind").isin(*MEMBER_KINDS, "root")
    hits = graph.nodes.where(of_kind & (F.contains(own, wanted) | F.contains(full, wanted)))
    rank = F.when(own == wanted, 0).when(full == wanted, 1).when(F.startswith(own, wanted), 2).otherwise(3)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    ranked = hits.withColumn("rank", rank).orderBy("rank", F.length("qualified_name"), *child_order())
    return (ranked if limit is None else ranked.limit(limit)).crossJoin(F.broadcast(total))  # the total is one row


def list_children(graph: DependencyGraph, node_id: int, kinds: Sequence[str] | None = None, pattern: str | None = None, modifiers: Sequence[str] | None = None, limit: int = LISTED) -> DataFrame:
    if not 1 <= limit <= LISTED:
        raise QueryError("INVALID_PARAMETER", f"limit must be 1 to {LISTED}")
    return graph.children_of(node_id).where(kind_filter(kinds) & name_contains(pattern) & modifier_filter(modifiers)).orderBy(*child_order()).limit(limit)


def list_descendants(graph: DependencyGraph, node_id: int, kinds: Sequence[str] | None = None, pattern: str | None = None, modifiers: Sequence[str] | None = None) -> DataFrame:
    """Descendants in depth-first order; the filter leaves subtrees of other nodes in."""
    return graph.pre_order(node_id).where(kind_filter(kinds) & name_contains(pattern) & modifier_filter(modifiers)).orderBy("path")


# --- paging -----------------------------------------------------------------------------------------------------------


def page(rows: DataFrame, offset: int = 0, limit: int = 100, most: int = 300) -> DataFrame:
    """A slice of totally ordered rows; past the end it is empty."""
    if offset < 0 or not 1 <= limit <= most:
        raise QueryError("INVALID_PARAMETER", f"offset must not be negative and limit 1 to {most}")
    return rows.offset(offset).limit(limit)


def within_budget(page_rows: DataFrame, order: Sequence[Column | str], characters: int = PAGE_CHARACTERS) -> DataFrame:
    """The first rows of a page whose JSON fits the budget; at least one.  A page is at most some hundred rows."""
    size = F.length(F.to_json(F.struct(*[F.col(c) for c in page_rows.columns]))) + 1
    w = Window.orderBy(*order)
    kept = page_rows.withColumn("__size", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return kept.where((F.col("__size") <= characters) | (F.col("__n") == 1)).drop("__size", "__n")


def numbered_page(rows: DataFrame, number: int, size: int) -> tuple[DataFrame, int]:
    """A page by number from 1, and how many pages there are."""
    if number < 1 or size < 1:
        raise QueryError("INVALID_PARAMETER", "page number and size start at 1")
    return rows.offset((number - 1) * size).limit(size), -(-rows.count() // size)


@dataclass(frozen=True)
class Cursor:
    """Where a listing goes on: which tool, request and data it belongs to."""

    tool: str
    query_hash: str
    data_hash: str
    offset: int
    version: int = CURSOR_VERSION

    def encode(self) -> str:
        text = json.dumps({"v": self.version, "tool": self.tool, "qh": self.query_hash, "dh": self.data_hash, "offset": self.offset}, separators=(",", ":"))
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            raw = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            out = Cursor(str(raw["tool"]), str(raw["qh"]), str(raw["dh"]), int(raw["offset"]), int(raw["v"]))
        except (ValueError, KeyError, TypeError) as e:
            raise QueryError("INVALID_CURSOR_FORMAT", "the cursor cannot be read", "start again without a cursor") from e
        if out.offset < 0:
            raise QueryError("INVALID_CURSOR_FORMAT", "the cursor has a negative offset", "start again without a cursor")
        return out

    def validate(self, tool: str, query_hash: str, data_hash: str) -> Cursor:
        """Refused if it belongs to another version, tool, request or data, in this order."""
        for code, same in (("STALE_CURSOR_VERSION", self.version == CURSOR_VERSION), ("WRONG_TOOL_CURSOR", self.tool == tool), ("STALE_CURSOR_QUERY", self.query_hash == query_hash), ("STALE_CURSOR_DATA", self.data_hash == data_hash)):
            if not same:
                raise QueryError(code, "the cursor belongs to another state", "start again without a cursor")
        return self


class ContinuationStore:
    """Arguments behind cursors: the latest ``most``, each for ``seconds``."""

    def __init__(self, most: int = 512, seconds: float = 1800.0, clock=time.monotonic) -> None:
        self._most, self._seconds, self._clock = most, seconds, clock
        self._held: OrderedDict[str, tuple[float, dict]] = OrderedDict()

    def put(self, cursor: str, arguments: dict) -> None:
        self._held[cursor] = (self._clock(), arguments)
        self._held.move_to_end(cursor)
        while len(self._held) > self._most:
            self._held.popitem(last=False)

    def get(self, cursor: str) -> dict:
        at, arguments = self._held.get(cursor, (None, None))
        if at is None or self._clock() - at > self._seconds:
            self._held.pop(cursor, None)
            raise QueryError("CURSOR_ARGUMENTS_UNKNOWN", "the arguments behind the cursor are gone", "repeat the full request")
        self._held.move_to_end(cursor)
        return arguments
