"""The engine's functions for queries written in SQL.

They are SQL functions of the session (expressions that Catalyst inlines), not Python: ``node_handle``, ``type_key``,
``package_of``, ``decode_modifiers`` and ``name_pattern_regex``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from canopy.schema import FIELD_MODIFIERS, METHOD_MODIFIERS, MODIFIER_BITS, TYPE_MODIFIERS

_VISIBILITY = ("public", "protected", "private")


def _quoted(text: str) -> str:
    """A SQL string literal; backslashes are escapes in it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _decoded(flags: tuple[str, ...]) -> str:
    """Visibility (none is package-private), then the flags in their order."""
    on = lambda name: f"(coalesce(bits, 0) & {1 << MODIFIER_BITS[name]}) <> 0"
    visible = "CASE " + " ".join(f"WHEN {on(v)} THEN '{v}'" for v in _VISIBILITY) + " ELSE 'package-private' END"
    return f"array_compact(array({visible}, {', '.join(f'CASE WHEN {on(x)} THEN {_quoted(x)} END' for x in flags)}))"


def _pattern() -> str:
    """``*`` stays within a segment, ``**`` does not, ``{a,b}`` are alternatives; everything else stands for itself."""
    steps = (
        (r"([\\.\[\]()^$|?+])", r"\\$1"),  # what is special in an expression but not in a pattern
        (r",(?=[^{}]*\})", "|"),
        (r"\{", "(?:"),
        (r"\}", ")"),
        (r"\*\*", "\x01"),
        (r"\*", "[^:]*"),
        ("\x01", ".*"),
    )
    out = "pattern"
    for find, put in steps:
        out = f"regexp_replace({out}, {_quoted(find)}, {_quoted(put)})"
    nested, unbalanced = r"\{[^}]*\{", r"^[^{}]*(\{[^{}]*\}[^{}]*)*$"
    wrong = f"pattern = '' OR pattern RLIKE {_quoted(nested)} OR NOT pattern RLIKE {_quoted(unbalanced)}"
    return f"CASE WHEN {wrong} THEN raise_error(concat('malformed pattern ', pattern)) ELSE concat('^', {out}, '$') END"


def definitions() -> dict[str, str]:
    """Name to the signature and body of each function."""
    kinds = " ".join(f"WHEN '{kind}' THEN {_decoded(flags)}" for kind, flags in (("type", TYPE_MODIFIERS), ("method", METHOD_MODIFIERS), ("field", FIELD_MODIFIERS)))
    return {
        "node_handle": f"(key STRING) RETURNS BIGINT RETURN cast(conv(substring(sha2(key, 256), 3, 14), 16, 10) AS BIGINT) & {(1 << 53) - 1}",
        "type_key": "(artifact STRING, fqn STRING) RETURNS STRING RETURN concat('type:', length(artifact), ':', artifact, ':', fqn)",
        "package_of": f"(fqn STRING) RETURNS STRING RETURN CASE WHEN instr(fqn, '.') > 0 THEN regexp_extract(fqn, {_quoted(r'^(.*)\.[^.]*$')}, 1) ELSE '' END",
        "decode_modifiers": f"(bits INT, kind STRING) RETURNS ARRAY<STRING> RETURN CASE kind {kinds} END",
        "name_pattern_regex": f"(pattern STRING) RETURNS STRING RETURN {_pattern()}",
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Define the functions in the session; returns their names."""
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
