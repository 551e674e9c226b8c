"""Reading and writing the fact tables, plain or in archives, and the build manifest."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators.detail import fact_order
from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.ingest import build_graph
from canopy.schema import FORMAT_KEY, FORMAT_VERSION, STALE_TABLES, TABLES


def read_table(spark: SparkSession, paths: str | Sequence[str], name: str, layout: str = "artifacts") -> DataFrame:
    """A fact table under one or more folders with the column ``artifact``; columns added later read as null.

    ``artifacts``: ``path/artifact=…/name.parquet`` gives the artifact by its folder; a types table holds it itself.
    ``tables``: ``path/name/artifact=…``, as the sinks here write.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    schema = TABLES[name]
    if name not in ("types", "classpath"):
        schema = type(schema)(schema.fields).add("artifact", "string")
    if layout == "tables":
        parts = [spark.read.schema(schema).parquet(f"{root}/{name}") for root in roots]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    files = [f"{root}/*/{name}.parquet" for root in roots]
    return spark.read.schema(schema).option("basePath", roots[0]).parquet(*files) if len(roots) == 1 else spark.read.schema(schema).parquet(*files)


def types_by_name(types: DataFrame, names: Sequence[str]) -> DataFrame:
    return types.where(F.col("fqn").isin(*names))


def members_by_owner(members: DataFrame) -> DataFrame:
    """One row for each owner with its members in order of their keys."""
    fields = [c for c in members.columns if c not in ("owner_fqn", "artifact")]
    return members.groupBy("owner_fqn").agg(F.sort_array(F.collect_list(F.struct("member_key", *[c for c in fields if c != "member_key"]))).alias("members"))


def first_of_artifacts(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the first artifact, by name, that has the key."""
    least = F.min("artifact").over(Window.partitionBy(key))
    return rows.withColumn("__first", least).where("artifact = __first").drop("__first")


def parameters_of(parameters: DataFrame, method_key: str) -> DataFrame:
    own = first_of_artifacts(parameters.where(F.col("method_key") == method_key), "method_key")
    return own.withColumn("annotations", F.split(F.coalesce("annotations", F.lit("")), " ")).orderBy("index")


def dependencies(rows: DataFrame, from_types: Sequence[str] = (), to_types: Sequence[str] = (), kind: str | None = None) -> DataFrame:
    """A conjunctive scan; an empty list does not constrain.  All three predicates reach the files."""
    for column, wanted in (("from_type", from_types), ("to_type", to_types), ("relationship", [kind] if kind else [])):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    return rows


def rollup_scan(rows: DataFrame) -> DataFrame:
    """The four columns (and the artifact) that the rollup needs."""
    return rows.select("artifact", "from_key", "from_type", "to_type", "relationship")


def classpaths(rows: DataFrame) -> DataFrame:
    """``(artifact_key, entries)`` in classpath order."""
    ordered = F.sort_array(F.collect_list(F.struct("index", "dep_key")))
    return rows.groupBy("artifact_key").agg(F.transform(ordered, lambda x: x["dep_key"]).alias("entries"))


def source_artifact(types: DataFrame) -> DataFrame:
    """One row: the only artifact of a table, null if there are several or none."""
    return types.agg(F.when(F.countDistinct("artifact") == 1, F.first("artifact")).alias("artifact"))


def check_format(path: str, key: str = FORMAT_KEY) -> None:
    """Refuses a local folder of files of another format, by the entry ``key`` of their footers."""
    for folder, _, files in os.walk(path):
        for name in files:
            if name.removesuffix(".parquet") in STALE_TABLES:
                raise QueryError("STALE_SNAPSHOT", f"{folder} has tables of an old format", "write the snapshot again")
            if name.endswith(".parquet"):
                meta = pq.read_metadata(os.path.join(folder, name)).metadata or {}
                _refuse_other(int(meta.get(key.encode(), 0)), name)


def _refuse_other(found: int, name: str) -> None:
    if found != FORMAT_VERSION:
        code = "NEWER_SNAPSHOT" if found > FORMAT_VERSION else "STALE_SNAPSHOT"
        raise QueryError(code, f"{name} has format {found}, not {FORMAT_VERSION}", "write the snapshot again")


def check_snapshot(spark: SparkSession, path: str, names: Sequence[str] = ("types", "dependencies")) -> None:
    """Refuses tables that the sinks here didn't write in this format, wherever they lie; footers are read by Spark."""
    for name in names:
        fields = spark.read.parquet(f"{path}/{name}").schema.fields
        _refuse_other(max((int(f.metadata.get(FORMAT_KEY, 0)) for f in fields), default=0), name)


def write_snapshot(path: str, **tables: DataFrame) -> None:
    """Writes the fact tables given by name; ``classpath`` has no artifact."""
    sinks = {"types": write_types, "members": write_members, "parameters": write_parameters, "dependencies": write_dependencies, "classpath": write_classpath}
    for name, rows in tables.items():
        sinks[name](rows, path)


def load_graph(spark: SparkSession, path: str, members: bool = False, classpath: bool = False) -> DependencyGraph:
    """The graph of a snapshot: its format is checked, its tables are read, resolved and hung into the tree."""
    check_snapshot(spark, path)
    read = lambda name: read_table(spark, path, name, "tables")
    return build_graph(read("types"), rollup_scan(read("dependencies")), read("members") if members else None, read("classpath") if classpath else None, placeholders=None)


# --- archives ---------------------------------------------------------------------------------------------------------


def _tables_in(data: bytes, name: str, nested: bool) -> Iterator[pd.DataFrame]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for entry in z.infolist():
            base = entry.filename.rpartition("/")[2]
            if base == f"{name}.parquet":
                yield pq.read_table(io.BytesIO(z.read(entry))).to_pandas()
            elif nested and base.endswith((".zip", ".jar")):
                yield from _tables_in(z.read(entry), name, nested)


def read_archives(spark: SparkSession, paths: str | Sequence[str], name: str, nested: bool = True) -> DataFrame:
    """A fact table out of ZIP archives (and archives inside them), with the ``archive`` it came from.

    One row of ``binaryFile`` is one archive, read in the task that gets it; archives hold one artifact and stay small.
    """
    schema = type(TABLES[name])(TABLES[name].fields).add("archive", "string")
    columns = [f.name for f in TABLES[name].fields]
    ints = [f.name for f in TABLES[name].fields if f.dataType.typeName() == "integer"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                for table in _tables_in(data, name, nested):
                    out = table.reindex(columns=columns)
                    out[ints] = out[ints].astype("Int32")
                    yield out.assign(archive=path)

    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return files.select("path", "content").mapInPandas(run, schema)


def archive_name(artifact: str) -> str:
    """File name of an artifact's archive."""
    stem = artifact.removesuffix(".jar").removesuffix(".zip")
    return "".join("_" if c in ":/\\" else c for c in stem) + ".zip"


def zip_artifact(folder: str, target: str) -> None:
    """A local folder's tables as a stored archive."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(os.listdir(folder)):
            if name.endswith(".parquet"):
                z.write(os.path.join(folder, name), name)


# --- writing ----------------------------------------------------------------------------------------------------------


def _stamped(rows: DataFrame) -> DataFrame:
    """Rows whose first column carries the format in its metadata, which Spark keeps in each file's footer."""
    first = next(c for c in rows.columns if c != "artifact")
    return rows.withMetadata(first, {FORMAT_KEY: FORMAT_VERSION})


def write_types(types: DataFrame, path: str) -> None:
    _stamped(types).repartition("artifact").sortWithinPartitions("artifact", "fqn").write.option("compression", "zstd").partitionBy("artifact").parquet(f"{path}/types")


def write_members(members: DataFrame, path: str) -> None:
    _stamped(members).repartition("artifact").sortWithinPartitions("artifact", "owner_fqn", "member_key").write.option("compression", "zstd").partitionBy("artifact").parquet(f"{path}/members")


def write_parameters(parameters: DataFrame, path: str) -> None:
    _stamped(parameters).repartition("artifact").sortWithinPartitions("artifact", "method_key", "index").write.option("compression", "zstd").partitionBy("artifact").parquet(f"{path}/parameters")


def write_dependencies(facts: DataFrame, path: str) -> None:
    """Facts by artifact in total order, so that a scan for one owner reads few row groups.  A hot artifact is split by
    range of its owners."""
    _stamped(facts).repartitionByRange("artifact", "from_type").sortWithinPartitions("artifact", *fact_order()).write.option("compression", "zstd").partitionBy("artifact").parquet(f"{path}/dependencies")


def write_classpath(rows: DataFrame, path: str) -> None:
    _stamped(rows).sortWithinPartitions("artifact_key", "index").write.option("compression", "zstd").parquet(f"{path}/classpath")


def filed(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Facts with the artifact they are filed under: their own, else the least definer of the owner; orphans drop out."""
    least = types.groupBy(F.col("fqn").alias("from_type")).agg(F.min("artifact").alias("__definer"))
    return facts.join(least, "from_type", "left").withColumn("artifact", F.coalesce("artifact", "__definer")).drop("__definer").where("artifact IS NOT NULL")


def classpath_rows(artifacts: DataFrame) -> DataFrame:
    """Rows ``(artifact_key, name, index, dep_key, internal)`` of ``(artifact_key, name, entries)``: index 0 is itself."""
    own = artifacts.select("artifact_key", "name", F.lit(0).alias("index"), F.col("artifact_key").alias("dep_key"), F.lit(1).alias("internal"))
    rest = artifacts.select("artifact_key", "name", F.posexplode("entries").alias("at", "e")).select("artifact_key", "name", (F.col("at") + 1).alias("index"), F.col("e.dep_key").alias("dep_key"), F.col("e.internal").alias("internal"))
    return own.unionByName(rest)


# --- manifest ---------------------------------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each module of a build manifest: ``gav, name, outputs, classpath``."""
    schema = "modules array<struct<gav: string, name: string, mainOutputDirs: array<string>, testOutputDirs: array<string>, classpath: array<struct<gav: string, internal: boolean, jar: string>>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("modules").alias("m")).select("m.gav", "m.name", F.concat(F.coalesce("m.mainOutputDirs", F.array().cast("array<string>")), F.coalesce("m.testOutputDirs", F.array().cast("array<string>"))).alias("outputs"), "m.classpath")


def remapped(column: str, recorded: str, local: str):
    """A recorded path under another root; other paths stay."""
    path = F.col(column)
    return F.when(F.startswith(path, F.lit(recorded)), F.concat(F.lit(local), F.substr(path, F.lit(len(recorded) + 1)))).otherwise(path)


def merged_manifest(previous: list[dict], current: list[dict], declared: Sequence[str] | None = None) -> list[dict]:
    """Modules by ``gav``: the first of repeated current ones, else the previous one; undeclared ones drop out."""
    out: dict[str, dict] = {}
    for m in [*current, *previous]:
        out.setdefault(m["gav"], m)
    return [m for gav, m in sorted(out.items()) if declared is None or gav in set(declared)]


def write_manifest(path: str, modules: list[dict]) -> bool:
    """Written only on change, by renaming a finished file; whether it was."""
    text = json.dumps({"schemaVersion": 1, "modules": modules}, indent=1, sort_keys=True)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read() == text:
                return False
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)
    return True
