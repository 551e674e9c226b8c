"""Keys, names and name patterns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.schema import PRIMITIVES, UBIQUITOUS_PREFIXES, UBIQUITOUS_TYPES


def type_key(artifact: Column, fqn: Column) -> Column:
    return F.concat(F.lit("type:"), F.length(artifact).cast("string"), F.lit(":"), artifact, F.lit(":"), fqn)


def member_node_key(artifact: Column, member_key: Column) -> Column:
    return F.concat(F.lit("member:"), F.length(artifact).cast("string"), F.lit(":"), artifact, F.lit(":"), member_key)


def package_key(artifact: Column, fqn: Column) -> Column:
    return F.concat(F.lit("pkg:"), artifact, F.lit(":"), fqn)


def artifact_of_type_key(key: Column) -> Column:
    size = F.regexp_extract(key, r"^type:(\d+):", 1)
    n = F.when(size == "", F.lit("0")).otherwise(size).cast("int")
    return key.substr(F.length(size) + 7, n)


def type_of(key: Column) -> Column:
    """The owner of a member key."""
    return F.substring_index(key, "#", 1)


def package_of(fqn: Column) -> Column:
    """The package of a type, empty for none."""
    return F.when(F.instr(fqn, ".") > 0, F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def name_and_parameters(signature: Column) -> Column:
    """A signature without its return type; the whole where it has no space."""
    at = F.instr(signature, " ")
    return F.when(at > 0, signature.substr(at + 1, F.length(signature))).otherwise(signature)


def declared_type(signature: Column) -> Column:
    """The declared type in a field's signature ``type name``."""
    return F.substring_index(signature, " ", 1)


def array_element(fqn: Column) -> Column:
    return F.regexp_replace(fqn, r"(\[\])+$", "")


def has_external_node(fqn: Column) -> Column:
    """Whether an unscanned target becomes a node: no primitives, arrays, default package, ubiquitous types."""
    out = ~fqn.isin(*PRIMITIVES, *UBIQUITOUS_TYPES) & ~fqn.startswith("[") & fqn.contains(".")
    for prefix in UBIQUITOUS_PREFIXES:
        out = out & ~fqn.startswith(prefix)
    return out


def node_handle(key: Column) -> Column:
    """Public id of a key: the first 8 bytes of its SHA-256, big-endian, masked to 53 bits."""
    return F.conv(F.substring(F.sha2(key, 256), 3, 14), 16, 10).cast("long").bitwiseAND(F.lit((1 << 53) - 1))


def pattern_regex(pattern: str) -> str:
    """Regular expression of a name pattern: ``*`` within a segment, ``**`` across segments, ``{a,b}`` alternatives."""
    if not pattern:
        raise ValueError("a pattern must not be empty")
    out, opened, i = ["^"], None, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            double = pattern.startswith("**", i)
            out.append(".*" if double else "[^:]*")
            i += double
        elif c == "{":
            if opened is not None:
                raise ValueError(f"nested '{{' at position {i + 1} in '{pattern}'")
            opened = i
            out.append("(?:")
        elif c == "}":
            if opened is None:
                raise ValueError(f"'}}' without '{{' at position {i + 1} in '{pattern}'")
            opened = None
            out.append(")")
        elif c == "," and opened is not None:
            out.append("|")
        else:
            out.append("\\" + c if c in "\\.[]()^$|?+" else c)
        i += 1
    if opened is not None:
        raise ValueError(f"'{{' at position {opened + 1} is not closed in '{pattern}'")
    return "".join([*out, "$"])


def matches_pattern(column: Column, pattern: str) -> Column:
    regex = pattern_regex(pattern)
    return column.rlike(regex) if any(c in pattern for c in "*{}") else column == F.lit(pattern)


def is_test_key(key: Column) -> Column:
    return key.endswith(":test")


def handle_of(key: str) -> int:
    """:func:`node_handle` of a key known on the driver."""
    import hashlib

    return int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") & ((1 << 53) - 1)
