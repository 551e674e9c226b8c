"""Fact relations, vocabularies and bit layouts."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in fields])


_S, _I = T.StringType(), T.IntegerType()

TYPES = _struct(("artifact", _S, False), ("fqn", _S, False), ("kind", _S, False), ("source_file", _S, True), ("class_hash", _S, True), ("modifiers", _I, False))
MEMBERS = _struct(
    ("owner_fqn", _S, False), ("member_key", _S, False), ("kind", _S, False), ("name", _S, False), ("signature", _S, False), ("modifiers", _I, True), ("line_from", _I, True), ("line_to", _I, True), ("bridge_target", _S, True)
)
PARAMETERS = _struct(("method_key", _S, False), ("index", _I, False), ("name", _S, False), ("type_fqn", _S, False), ("annotations", _S, True))
DEPENDENCIES = _struct(
    ("from_key", _S, False), ("from_type", _S, False), ("to_key", _S, False), ("to_type", _S, False), ("relationship", _S, False), ("line", _I, True), ("parameter_index", _I, True), ("parameter_name", _S, True)
)
CLASSPATH = _struct(("artifact_key", _S, False), ("name", _S, False), ("index", _I, False), ("dep_key", _S, False), ("internal", _I, False))
TABLES = {"types": TYPES, "members": MEMBERS, "parameters": PARAMETERS, "dependencies": DEPENDENCIES, "classpath": CLASSPATH}

#: Entry of a file's footer, and of a written column's metadata, that names the storage format; and the format.
FORMAT_KEY, FORMAT_VERSION = "canopy.format.version", 3
#: Table names of a format that is no longer read.
STALE_TABLES = ("refs", "detail_refs")

# Node kinds.
MODULE, PACKAGE = "java.module", "java.package"
CLASS, INTERFACE, ENUM, RECORD, ANNOTATION = "java.class", "java.interface", "java.enum", "java.record", "java.annotation"
METHOD, FIELD, CONSTRUCTOR, PRIMITIVE, EXTERNAL_TYPE = "java.method", "java.field", "java.constructor", "java.primitive", "external.type"
TYPE_KINDS = (CLASS, INTERFACE, ENUM, RECORD, ANNOTATION)
MEMBER_KINDS = (METHOD, FIELD)
NODE_KINDS = (MODULE, PACKAGE, *TYPE_KINDS, *MEMBER_KINDS)
#: What counts as a type where dependencies are collected; the alias ``types`` leaves external types out.
SCOPE_TYPE_KINDS = (*TYPE_KINDS, EXTERNAL_TYPE)
KIND_ALIASES = {"types": TYPE_KINDS, "members": MEMBER_KINDS, "packages": (PACKAGE,)}
TYPE_KIND_OF = {"CLASS": CLASS, "INTERFACE": INTERFACE, "ENUM": ENUM, "RECORD": RECORD, "ANNOTATION": ANNOTATION}
MEMBER_KIND_OF = {"METHOD": METHOD, "CONSTRUCTOR": METHOD, "FIELD": FIELD}

# Dependency kinds in vocabulary order.
COUNTED_KINDS = (
    "extends", "implements", "annotated_by", "parameter_annotated_by", "annotation_value", "type_argument", "has_type", "parameter_type", "returns", "throws",
    "calls", "reads_field", "writes_field", "instantiates", "casts", "catches", "class_literal",
)
UNCOUNTED_KINDS = ("raises",)
DERIVED_KINDS = ("overrides", "read_by", "written_by")
DEPENDENCY_KINDS = COUNTED_KINDS + UNCOUNTED_KINDS + DERIVED_KINDS
STRUCTURAL_KINDS = ("extends", "implements", "annotated_by")
REVERSED_KINDS = {"read_by": "reads_field", "written_by": "writes_field"}

# Edge attribute bits and their names.
EXTENDS_BIT, IMPLEMENTS_BIT, ANNOTATED_BIT, OTHER_BIT = 0, 1, 2, 3
EDGE_ATTRIBUTES = ((EXTENDS_BIT, "is_extends"), (IMPLEMENTS_BIT, "is_implements"), (ANNOTATED_BIT, "is_annotated_by"), (OTHER_BIT, "is_depends_on_other"))

# Modifier bits.
MODIFIER_BITS = {
    "public": 0, "protected": 1, "private": 2, "static": 3, "final": 4, "abstract": 5, "synchronized": 6, "native": 7, "transient": 8, "volatile": 9, "default": 10, "bridge": 11, "synthetic": 12, "constant": 13, "generic": 14,
}
METHOD_MODIFIERS = ("static", "final", "abstract", "synchronized", "native", "default", "bridge", "synthetic")
FIELD_MODIFIERS = ("static", "final", "transient", "volatile", "synthetic")
TYPE_MODIFIERS = ("abstract", "final", "static")

#: Primitive type names.
PRIMITIVES = ("void", "boolean", "byte", "char", "short", "int", "long", "float", "double")
EXTERNAL_ARTIFACT, EXTERNAL_NAME = "<external>", "External Types"
#: Annotations that are left out of the hierarchy with the ubiquitous packages.
UBIQUITOUS_PREFIXES = ("java.lang.", "kotlin.")
UBIQUITOUS_TYPES = ("org.jetbrains.annotations.NotNull", "org.jetbrains.annotations.Nullable")

ROOT_KEY = "<root>"
