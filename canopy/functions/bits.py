"""Bitmaps of modifiers and edge attributes as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.schema import ANNOTATED_BIT, EDGE_ATTRIBUTES, EXTENDS_BIT, FIELD_MODIFIERS, IMPLEMENTS_BIT, METHOD_MODIFIERS, MODIFIER_BITS, OTHER_BIT, TYPE_MODIFIERS


def bit_is_set(bitmap: Column, position: int) -> Column:
    return bitmap.bitwiseAND(F.lit(1 << position)) != 0


def with_bit(bitmap: Column, position: int, value: Column | bool = True) -> Column:
    on, off = bitmap.bitwiseOR(F.lit(1 << position)), bitmap.bitwiseAND(F.lit(~(1 << position)))
    return F.when(value, on).otherwise(off) if isinstance(value, Column) else on if value else off


def pack_modifiers(names: Sequence[str]) -> int:
    """Bitmap of modifier names; ``package-private`` has no bit."""
    return sum(1 << MODIFIER_BITS[n.lower()] for n in dict.fromkeys(names) if n.lower() != "package-private")


def visibility(bitmap: Column) -> Column:
    out = F.lit("package-private")
    for name in ("private", "protected", "public"):
        out = F.when(bit_is_set(bitmap, MODIFIER_BITS[name]), F.lit(name)).otherwise(out)
    return out


def _decoded(bitmap: Column, names: Sequence[str]) -> Column:
    rest = [F.when(bit_is_set(bitmap, MODIFIER_BITS[n]), F.lit(n)) for n in names]
    return F.array_compact(F.array(visibility(bitmap), *rest))


def method_modifiers(bitmap: Column) -> Column:
    return _decoded(bitmap, METHOD_MODIFIERS)


def field_modifiers(bitmap: Column) -> Column:
    return _decoded(bitmap, FIELD_MODIFIERS)


def type_modifiers(bitmap: Column) -> Column:
    return _decoded(bitmap, TYPE_MODIFIERS)


def edge_attributes(bitmap: Column) -> Column:
    """Struct of booleans, one for each edge attribute."""
    return F.struct(*[bit_is_set(bitmap, position).alias(name) for position, name in EDGE_ATTRIBUTES])


def edge_bits(extends: Column, implements: Column, annotated: Column, other: Column) -> Column:
    bit = lambda c, position: F.when(c, F.lit(1 << position)).otherwise(F.lit(0))
    return (bit(extends, EXTENDS_BIT) + bit(implements, IMPLEMENTS_BIT) + bit(annotated, ANNOTATED_BIT) + bit(other, OTHER_BIT)).cast("int")
