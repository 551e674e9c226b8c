"""Request filters: kinds, modifiers, names, selectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions.names import matches_pattern
from canopy.operators.hierarchy import DependencyGraph
from canopy.schema import EXTERNAL_TYPE, KIND_ALIASES, MEMBER_KINDS, MODIFIER_BITS, NODE_KINDS


def expand_kinds(kinds: Sequence[str] | None, allowed: Sequence[str] = (*NODE_KINDS, EXTERNAL_TYPE)) -> list[str] | None:
    """Kinds with aliases written out; unknown ones are refused."""
    if not kinds:
        return None
    out = [k for name in kinds for k in KIND_ALIASES.get(name, (name,))]
    if bad := sorted({k for k in out if k not in allowed}):
        raise QueryError("INVALID_KIND", f"unknown kinds {bad}", "use one of the allowed kinds", allowed=[*KIND_ALIASES, *allowed])
    return list(dict.fromkeys(out))


def kind_filter(kinds: Sequence[str] | None) -> Column:
    wanted = expand_kinds(kinds)
    return F.lit(True) if wanted is None else F.col("kind").isin(*wanted)


def modifier_filter(required: Sequence[str] | None) -> Column:
    """Members that have all required modifiers, in either case; other nodes never match."""
    if not required:
        return F.lit(True)
    out = F.col("kind").isin(*MEMBER_KINDS)
    for name in (m.lower() for m in required):
        if name == "package-private":
            out = out & (F.col("modifiers").bitwiseAND(F.lit(7)) == 0)
        elif name in MODIFIER_BITS:
            out = out & (F.col("modifiers").bitwiseAND(F.lit(1 << MODIFIER_BITS[name])) != 0)
        else:
            raise QueryError("INVALID_PARAMETER", f"unknown modifier {name}")
    return out


def name_contains(pattern: str | None) -> Column:
    return F.lit(True) if not pattern else F.contains(F.lower("name"), F.lit(pattern.lower()))


def select_nodes(graph: DependencyGraph, pattern: str, kind: str | None = None, within: int | None = None, on: str = "qualified_name") -> DataFrame:
    """Nodes whose name matches a pattern, of a kind, strictly below a node."""
    out = graph.nodes.where(matches_pattern(F.col(on), pattern) & kind_filter([kind] if kind else None))
    if within is not None:
        below = graph.closure().where((F.col("ancestor") == within) & (F.col("depth") > 0)).select(F.col("descendant").alias("id"))
        out = out.join(below, "id", "left_semi")
    return out
