"""Levels of a dependency graph under groups that are pinned to one level, spread, lifted or placed on top.

Each node belongs to the first group that names it.  A pinned group is one node of the graph whose levels are asked for; a
spread one (``span``) keeps its members' own levels.  A level is the longest path down to the core on the condensation, so a
cycle, or what pinning makes one, shares a level.  A lifted group starts at its least level, and everything above it moves
along; placed groups stand above all others, in the order of their places.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators import ordering
from canopy.plans.materialize import stage_table


@dataclass(frozen=True)
class LevelGroup:
    """A group of a layering; the earlier of two groups wins a node."""

    name: str
    span: bool = False
    place: int | None = None
    min_level: int | None = None

    def check(self) -> None:
        if self.place is not None and self.span:
            raise QueryError("INVALID_PARAMETER", f"group {self.name}: only pinned groups are placed", "lift a spread group by min_level")
        if self.place is not None and self.min_level is not None:
            raise QueryError("INVALID_PARAMETER", f"group {self.name}: place or min_level, not both")
        if self.min_level is not None and (not isinstance(self.min_level, int) or self.min_level < 0):
            raise QueryError("INVALID_PARAMETER", f"group {self.name}: min_level is a number from 0")


def longest_paths(steps: DataFrame, floors: DataFrame) -> DataFrame:
    """``(core, level)`` over the acyclic ``steps(a, b)``, a above b: at least the floor of ``floors(core, level)``, and above
    what it depends on.

    Difference constraints: only what rose in a round can raise others in the next, so rounds are as many as steps in a row.
    """
    levels = rose = stage_table(floors)
    while True:
        raised = steps.join(rose.withColumnRenamed("core", "b"), "b").groupBy(F.col("a").alias("core")).agg((F.max("level") + 1).alias("new"))
        rose = stage_table(raised.join(levels, "core").where("new > level").select("core", F.col("new").alias("level")))
        if rose.isEmpty():
            return levels
        levels = stage_table(levels.join(rose.withColumnRenamed("level", "new"), "core", "left").select("core", F.coalesce("new", "level").alias("level")))


def placed_levels(nodes: DataFrame, edges: DataFrame, groups: Sequence[LevelGroup] = (), members: DataFrame | None = None) -> DataFrame:
    """``(id, level, grp, pinned)`` of ``nodes(id)`` under ``edges(from_id, to_id)``; ``members(name, id)`` names groups' nodes.

    Ids are not negative.  ``grp`` is the number of the node's group in the list, or null.
    """
    for g in groups:
        g.check()
    spark = nodes.sparkSession
    listed = spark.createDataFrame([(i, g.name, g.span) for i, g in enumerate(groups)], "grp int, name string, span boolean")
    if members is None:
        members = spark.createDataFrame([], "name string, id long")
    chosen = members.join(F.broadcast(listed), "name").groupBy("id").agg(F.min(F.struct("grp", "span")).alias("g"))  # the document's groups
    keyed = nodes.select("id").distinct().join(chosen, "id", "left").select("id", "g.grp", F.coalesce(~F.col("g.span"), F.lit(False)).alias("pinned"))
    keyed = stage_table(keyed.withColumn("key", F.when(F.col("pinned"), -1 - F.col("grp").cast("long")).otherwise(F.col("id"))))
    key_of = lambda side: keyed.select(F.col("id").alias(side), F.col("key").alias(f"{side}_key"))
    between = edges.select("from_id", "to_id").join(key_of("from_id"), "from_id").join(key_of("to_id"), "to_id").select(F.col("from_id_key").alias("from_id"), F.col("to_id_key").alias("to_id")).where("from_id <> to_id").distinct()
    between = stage_table(between)
    cores = ordering.strong_components(between).select(F.col("id").alias("key"), F.col("component").alias("core"))
    keyed = stage_table(keyed.join(cores, "key", "left").withColumn("core", F.coalesce("core", "key")))
    core_of = keyed.select("key", "core").distinct()
    steps = between.join(core_of.select(F.col("key").alias("from_id"), F.col("core").alias("a")), "from_id").join(core_of.select(F.col("key").alias("to_id"), F.col("core").alias("b")), "to_id")
    steps = stage_table(steps.where("a <> b").select("a", "b").distinct())
    floors = keyed.select("core").distinct().withColumn("level", F.lit(0))
    level = longest_paths(steps, floors)

    if lifted := [(i, g.min_level) for i, g in enumerate(groups) if g.min_level is not None]:
        starts = spark.createDataFrame(lifted, "grp int, least int")
        own = keyed.join(level, "core").join(F.broadcast(starts), "grp")
        lift = own.groupBy("grp").agg((F.first("least") - F.min("level")).alias("lift")).where("lift > 0")
        raised = own.join(F.broadcast(lift), "grp").groupBy("core").agg(F.max(F.col("level") + F.col("lift")).alias("floor"))
        level = longest_paths(steps, floors.join(raised, "core", "left").select("core", F.coalesce("floor", "level").alias("level")))

    rows = keyed.join(level, "core").select("id", "level", "grp", "pinned")
    if placed := sorted((g.place, i) for i, g in enumerate(groups) if g.place is not None):
        rows = stage_table(rows)
        ranks = spark.createDataFrame([(i, rank) for rank, (_, i) in enumerate(placed, 1)], "grp int, rank int")
        top = rows.join(F.broadcast(ranks), "grp", "left_anti").agg(F.coalesce(F.max("level"), F.lit(0)).alias("base")).first()["base"]
        rows = rows.join(F.broadcast(ranks), "grp", "left").select("id", F.coalesce(F.col("rank") + top, "level").alias("level"), "grp", "pinned")
    return rows


#: Classes of edges by the levels of their ends.
DOWN, UP, FLAT, INTERNAL = 0, 1, 2, 3


def violations(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """``edges`` with ``from_level, to_level`` and ``class``: down, up, flat, or flat inside one pinned group."""
    of = lambda side: levels.select(F.col("id").alias(f"{side}_id"), F.col("level").alias(f"{side}_level"), F.when(F.col("pinned"), F.col("grp")).alias(f"{side}_grp"))
    a, b = F.col("from_level"), F.col("to_level")
    kind = F.when(a > b, DOWN).when(a < b, UP).when(F.col("from_grp") == F.col("to_grp"), INTERNAL).otherwise(FLAT)
    return edges.join(of("from"), "from_id").join(of("to"), "to_id").withColumn("class", kind).drop("from_grp", "to_grp")
