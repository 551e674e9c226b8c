"""From fact tables to a graph: packages, placeholders, name resolution, rollup, edges.

Facts are rolled up before names are resolved, so resolution and the joins with nodes work on one row for each
(owner, target, kind) instead of one for each fact.  Definers are grouped by name: a target that many owners use meets
its definers in a join whose large side Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import names
from canopy.functions.bits import edge_bits
from canopy.operators.hierarchy import DependencyGraph
from canopy.schema import ANNOTATED_BIT, COUNTED_KINDS, EXTERNAL_ARTIFACT, EXTERNAL_NAME, EXTERNAL_TYPE, EXTENDS_BIT, IMPLEMENTS_BIT, MEMBER_KIND_OF, MODULE, OTHER_BIT, PACKAGE, PRIMITIVES, ROOT_KEY, STRUCTURAL_KINDS, TYPE_KIND_OF


def _mapped(column: Column, table: dict[str, str], what: str) -> Column:
    out = F.raise_error(F.concat(F.lit(f"unknown {what} "), F.coalesce(column, F.lit("null"))))
    for name, kind in table.items():
        out = F.when(column == name, F.lit(kind)).otherwise(out)
    return out


def type_kind(column: Column) -> Column:
    """Node kind of a stored type kind; an unknown one is an error."""
    return _mapped(column, TYPE_KIND_OF, "type kind")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last writer wins: the row of greatest ``order`` for each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def modules(types: DataFrame) -> DataFrame:
    return types.select(F.col("artifact").alias("key")).distinct()


def package_prefixes(types: DataFrame) -> DataFrame:
    """``(artifact, fqn)`` of every package on the way to a type."""
    own = types.select("artifact", names.package_of(F.col("fqn")).alias("p")).where("p <> ''").distinct()
    parts = F.split("p", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return own.select("artifact", F.explode(prefixes).alias("fqn")).distinct()


def rollup(dependencies: DataFrame) -> DataFrame:
    """References ``(artifact, from_type, to_type, kind, type_level, n)``: counted kinds, no self or primitive targets."""
    facts = dependencies.where(F.col("relationship").isin(*COUNTED_KINDS) & (F.col("from_type") != F.col("to_type")) & ~F.col("to_type").isin(*PRIMITIVES))
    level = F.col("from_key") == F.col("from_type")
    return facts.groupBy("artifact", "from_type", "to_type", F.col("relationship").alias("kind"), level.alias("type_level")).agg(F.count(F.lit(1)).alias("n"))


def external_placeholders(references: DataFrame, types: DataFrame, keep: Callable[[Column], Column] = names.has_external_node) -> DataFrame:
    """Referenced names that no artifact defines, as type rows of the external module."""
    fqn = F.col("fqn")
    missing = references.select(F.col("to_type").alias("fqn")).distinct().join(types.select("fqn").distinct(), "fqn", "left_anti").where(keep(fqn))
    return missing.select(F.lit(EXTERNAL_ARTIFACT).alias("artifact"), "fqn", F.lit(EXTERNAL_TYPE).alias("kind"), F.lit(0).alias("modifiers"))


def definers(types: DataFrame) -> DataFrame:
    return types.select(F.col("fqn").alias("to_type"), F.col("artifact").alias("definer")).distinct()


def resolve_owner_first(references: DataFrame, types: DataFrame) -> DataFrame:
    """Adds ``to_artifact``: the owner's own artifact if it defines the target, else the least definer; null if none."""
    defined = definers(types)
    least = defined.groupBy("to_type").agg(F.min("definer").alias("least"))
    own = defined.select("to_type", F.col("definer").alias("artifact"), F.col("definer").alias("own"))
    return references.join(least, "to_type", "left").join(own, ["artifact", "to_type"], "left").withColumn("to_artifact", F.coalesce("own", "least")).drop("own", "least")


def resolve_classpath(references: DataFrame, types: DataFrame, classpath: DataFrame) -> DataFrame:
    """Adds ``to_artifact``: the first entry of the owner's classpath that defines the target, else as owner-first.

    The owner's path comes first: a name that many artifacts define meets only those on the path.
    """
    entries = classpath.select(F.col("artifact_key").alias("artifact"), F.col("dep_key").alias("definer"), "index")
    wanted = references.select("artifact", "to_type").distinct()
    first = wanted.join(entries, "artifact").join(definers(types), ["to_type", "definer"]).groupBy("artifact", "to_type").agg(F.min_by("definer", "index").alias("on_path"))
    return resolve_owner_first(references, types).join(first, ["artifact", "to_type"], "left").withColumn("to_artifact", F.coalesce("on_path", "to_artifact")).drop("on_path")


def reference_edges(references: DataFrame) -> DataFrame:
    """Resolved references as ``(from_key, to_key, kind, type_level, n)`` between different types."""
    own, target = names.type_key(F.col("artifact"), F.col("from_type")), names.type_key(F.col("to_artifact"), F.col("to_type"))
    return references.where("to_artifact IS NOT NULL").select(own.alias("from_key"), target.alias("to_key"), "kind", "type_level", "n").where("from_key <> to_key").groupBy("from_key", "to_key", "kind", "type_level").agg(F.sum("n").alias("n"))


def type_dependencies(reference_rows: DataFrame) -> DataFrame:
    """Edges ``(from_id, to_id, weight, attrs, kinds)`` from rows ``(from_id, to_id, kind, type_level, n)``."""
    kind = F.col("kind")
    annotated = (kind == "annotated_by") & F.col("type_level")
    other = ~kind.isin(*STRUCTURAL_KINDS) | ((kind == "annotated_by") & ~F.col("type_level"))
    by_kind = reference_rows.groupBy("from_id", "to_id", "kind").agg(F.sum("n").alias("n"), F.bool_or(annotated).alias("annotated"), F.bool_or(other).alias("other"))
    return by_kind.groupBy("from_id", "to_id").agg(
        F.sum("n").alias("weight"),
        edge_bits(F.bool_or(kind == "extends"), F.bool_or(kind == "implements"), F.bool_or("annotated"), F.bool_or("other")).alias("attrs"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"),
    )


def type_references(dependencies: DataFrame) -> DataFrame:
    """``(artifact, from_type, to_type, weight, attrs, kinds)``: all facts of an owner about one name in one row."""
    facts = dependencies.where(F.col("relationship").isin(*COUNTED_KINDS) & (F.col("from_type") != F.col("to_type")) & ~F.col("to_type").isin(*PRIMITIVES))
    kind, on_type = F.col("relationship"), F.col("from_key") == F.col("from_type")
    bit = F.when(kind == "extends", 1 << EXTENDS_BIT).when(kind == "implements", 1 << IMPLEMENTS_BIT).when((kind == "annotated_by") & on_type, 1 << ANNOTATED_BIT).otherwise(1 << OTHER_BIT)
    by_kind = facts.groupBy("artifact", "from_type", "to_type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("attrs"))
    kinds = F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n"))))  # one entry for each kind
    return by_kind.groupBy("artifact", "from_type", "to_type").agg(F.sum("n").alias("weight"), F.bit_or("attrs").alias("attrs"), kinds.alias("kinds"))


def resolved_edges(references: DataFrame, types: DataFrame, classpath: DataFrame | None = None, columns: Sequence[str] = ("weight", "attrs", "kinds")) -> DataFrame:
    """Edges ``(from_id, to_id, weight, attrs, kinds)`` of :func:`type_references`, whose owners are ``types(artifact, fqn)``;
    or of other references with other ``columns``.

    What a name means follows from owner and name, so references stay one row a pair and need no further grouping.  Handles are
    computed once for each type; only names of several definers are looked up by their owner too.
    """
    located = types.select("artifact", "fqn").distinct().withColumn("id", names.node_handle(names.type_key(F.col("artifact"), F.col("fqn"))))
    owners = located.select("artifact", F.col("fqn").alias("from_type"), F.col("id").alias("from_id"))
    by_name = located.groupBy(F.col("fqn").alias("to_type")).agg(F.min(F.struct("artifact", "id")).alias("least"), F.count(F.lit(1)).alias("definers"))
    out = references.join(owners, ["artifact", "from_type"]).join(by_name, "to_type")
    several = by_name.where("definers > 1").select("to_type")
    own = located.withColumnRenamed("fqn", "to_type").join(several, "to_type", "left_semi").select("artifact", "to_type", F.col("id").alias("own_id"))
    out = out.join(own, ["artifact", "to_type"], "left").withColumn("to_id", F.coalesce("own_id", "least.id"))
    if classpath is not None:
        entries = classpath.select(F.col("artifact_key").alias("artifact"), F.col("dep_key").alias("definer"), "index")
        # The owner's path comes first: a name that many artifacts define meets only those on the path.
        wanted = out.select("artifact", "to_type").distinct()
        definer = located.select(F.col("fqn").alias("to_type"), F.col("artifact").alias("definer"), F.col("id").alias("path_id"))
        first = wanted.join(entries, "artifact").join(definer, ["to_type", "definer"]).groupBy("artifact", "to_type").agg(F.min_by("path_id", "index").alias("path_id"))
        out = out.join(first, ["artifact", "to_type"], "left").withColumn("to_id", F.coalesce("path_id", "to_id"))
    return out.where("from_id <> to_id").select("from_id", "to_id", *columns)


def graph_nodes(types: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, key, path, kind, name, qualified_name, modifiers)`` with a synthetic root above the modules.

    ``path`` holds the keys from the root down to the node itself.  It follows from artifact and name, so neither the tree
    nor its closure needs a join.
    """
    columns = ["key", "path", "kind", "name", "qualified_name", "modifiers"]
    none, artifact, fqn = F.lit(0), F.col("artifact"), F.col("fqn")
    top = lambda a: F.array(F.lit(ROOT_KEY), a)

    def above(package: Column) -> Column:
        """Keys of the root, the module and every package down to ``package``."""
        parts = F.split(package, r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: names.package_key(artifact, F.array_join(F.slice(parts, 1, n), ".")))
        return F.concat(top(artifact), F.when(package == "", F.array().cast("array<string>")).otherwise(prefixes))

    root = types.sparkSession.range(1).select(F.lit(ROOT_KEY).alias("key"), F.array(F.lit(ROOT_KEY)).alias("path"), F.lit("root").alias("kind"), F.lit("").alias("name"), F.lit("").alias("qualified_name"), none.alias("modifiers"))
    shown = F.when(F.col("key") == EXTERNAL_ARTIFACT, F.lit(EXTERNAL_NAME)).otherwise(F.col("key"))
    tops = modules(types).select("key", top(F.col("key")).alias("path"), F.lit(MODULE).alias("kind"), shown.alias("name"), shown.alias("qualified_name"), none.alias("modifiers"))
    packages = package_prefixes(types).select(names.package_key(artifact, fqn).alias("key"), above(fqn).alias("path"), F.lit(PACKAGE).alias("kind"), names.simple_name(fqn).alias("name"), fqn.alias("qualified_name"), none.alias("modifiers"))
    own_path = F.concat(above(names.package_of(fqn)), F.array(names.type_key(artifact, fqn)))
    own = types.dropDuplicates(["artifact", "fqn"]).select(names.type_key(artifact, fqn).alias("key"), own_path.alias("path"), "kind", names.simple_name(fqn).alias("name"), fqn.alias("qualified_name"), F.coalesce("modifiers", none).alias("modifiers"))
    rows = root.unionByName(tops).unionByName(packages).unionByName(own)
    if members is not None:
        kind = _mapped(F.col("kind"), MEMBER_KIND_OF, "member kind")
        owner = F.col("owner_fqn")
        key = names.member_node_key(artifact, F.col("member_key"))
        path = F.concat(above(names.package_of(owner)), F.array(names.type_key(artifact, owner), key))
        rows = rows.unionByName(members.dropDuplicates(["artifact", "member_key"]).select(key.alias("key"), path.alias("path"), kind.alias("kind"), "name", F.col("member_key").alias("qualified_name"), F.coalesce("modifiers", none).alias("modifiers")))
    return rows.select(names.node_handle(F.col("key")).alias("id"), *columns)


def tree_of(nodes: DataFrame) -> DataFrame:
    above = names.node_handle(F.expr("element_at(path, greatest(size(path) - 1, 1))"))
    return nodes.select(F.col("id").alias("node_id"), F.when(F.size("path") > 1, above).alias("parent_id"))


def closure_of(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("at", "key")).select(names.node_handle(F.col("key")).alias("ancestor"), "descendant", (F.col("n") - 1 - F.col("at")).alias("depth"))


def handle_collisions(nodes: DataFrame) -> DataFrame:
    """Ids that more than one key has; empty for a sound graph."""
    return nodes.groupBy("id").agg(F.countDistinct("key").alias("keys")).where("keys > 1")


def build_graph(types: DataFrame, dependencies: DataFrame, members: DataFrame | None = None, classpath: DataFrame | None = None, placeholders: Callable[[Column], Column] | None = names.has_external_node) -> DependencyGraph:
    """The graph of all facts.  ``types``, ``members`` and ``dependencies`` have the column ``artifact``.

    Edges exist only between nodes; targets that nothing defines become external types if ``placeholders`` takes them.
    """
    known = types.select("artifact", "fqn", type_kind(F.col("kind")).alias("kind"), "modifiers")
    references = type_references(dependencies)
    if placeholders is not None:
        known = known.unionByName(external_placeholders(references, types, placeholders))
    nodes = graph_nodes(known, members)
    # Targets exist by resolution; owners must be types of their artifact.
    return DependencyGraph(nodes.drop("path"), tree_of(nodes), resolved_edges(references, known, classpath), extensions={"paths": nodes}, _cache={"closure": closure_of(nodes)})
