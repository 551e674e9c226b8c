"""The driver's tables as fact relations: a trade graph, a sequence graph and a stream of changes.

*Trade graph*: module = region, package = nation, types = customers (classes) and suppliers (interfaces); a fact is a line
of an order, from the customer to the supplier.  *Sequence graph*: module = brand, package = part type within it, types =
parts; a fact leads from one line's part to the next line's in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.hierarchy import DependencyGraph
from canopy.operators.ingest import build_graph
from canopy.plans.materialize import forget_shuffles

#: Relationship of a line by its return flag and status.
LINE_KINDS = {"AF": "extends", "AO": "implements", "NF": "annotated_by", "NO": "calls", "RF": "instantiates", "RO": "casts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind():
    flags = F.concat("l_returnflag", "l_linestatus")
    out = F.lit("calls")
    for k, v in LINE_KINDS.items():
        out = F.when(flags == k, F.lit(v)).otherwise(out)
    return out


def _parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("c_region"), F.concat("n_name", F.lit(".C"), "c_custkey").alias("c_fqn"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("s_region"), F.concat("n_name", F.lit(".S"), "s_suppkey").alias("s_fqn"))
    return customers, suppliers


def trade_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _parties(spark, sf_dir)
    row = lambda df, a, b, kind, m: df.select(F.col(a).alias("artifact"), F.col(b).alias("fqn"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("class_hash"), F.lit(m).alias("modifiers"))
    return row(customers, "c_region", "c_fqn", "CLASS", 1).unionByName(row(suppliers, "s_region", "s_fqn", "INTERFACE", 33))


def trade_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = _parties(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", _kind().alias("relationship"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    facts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    on_type = F.col("relationship").isin("extends", "implements") | ((F.col("relationship") == "annotated_by") & (F.col("l_linenumber") == 1))
    member = F.concat(F.col("c_fqn"), F.lit("#void line"), F.col("l_linenumber"), F.lit("()"))
    return facts.select(
        F.col("c_region").alias("artifact"), F.when(on_type, F.col("c_fqn")).otherwise(member).alias("from_key"), F.col("c_fqn").alias("from_type"), F.col("s_fqn").alias("to_key"), F.col("s_fqn").alias("to_type"), "relationship",
        F.col("l_linenumber").alias("line"), F.lit(None).cast("int").alias("parameter_index"), F.lit(None).cast("string").alias("parameter_name"), "l_orderkey",
    )


_GENERATIONS: dict[tuple, DependencyGraph] = {}


def _generation(spark: SparkSession, key: tuple, build) -> DependencyGraph:
    """A graph is built and written once for each application and input: its generation."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _GENERATIONS:
        _GENERATIONS[key] = build().staged()
        forget_shuffles(spark)
    return _GENERATIONS[key]


def trade_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    return _generation(spark, ("trade", sf_dir), lambda: _trade_graph(spark, sf_dir))


def _trade_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    return build_graph(trade_types(spark, sf_dir), trade_dependencies(spark, sf_dir), placeholders=None)


def sequence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("artifact"), _part_fqn().alias("fqn"), F.lit("CLASS").alias("kind"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("string").alias("class_hash"), F.lit(1).alias("modifiers"))


def _part_fqn():
    return F.concat(F.regexp_replace("p_brand", r"[.#]", "_"), F.lit("_"), F.regexp_replace("p_type", r"[ .]", "_"), F.lit(".P"), "p_partkey")


def sequence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(a, b)``: parts of consecutive lines of one order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    pairs = lines.withColumn("b", F.lead("l_partkey").over(order)).where("b IS NOT NULL")
    return pairs.select(F.col("l_partkey").alias("a"), "b", "l_linenumber")


def sequence_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", _part_fqn().alias("fqn"))
    a, b = part.select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("artifact"), F.col("fqn").alias("from_type")), part.select(F.col("p_partkey").alias("b"), F.col("fqn").alias("to_type"))
    return sequence_pairs(spark, sf_dir).join(a, "a").join(b, "b").select(
        "artifact", F.concat("from_type", F.lit("#m()")).alias("from_key"), "from_type", F.concat("to_type", F.lit("#m()")).alias("to_key"), "to_type", F.lit("calls").alias("relationship"), F.col("l_linenumber").alias("line"),
        F.lit(None).cast("int").alias("parameter_index"), F.lit(None).cast("string").alias("parameter_name"),
    )


def sequence_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    return _generation(spark, ("sequence", sf_dir), lambda: _sequence_graph(spark, sf_dir))


def _sequence_graph(spark: SparkSession, sf_dir: str) -> DependencyGraph:
    return build_graph(sequence_types(spark, sf_dir), sequence_dependencies(spark, sf_dir), placeholders=None)


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(module, kind, ts, event_id)`` from the events."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("module"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


# --- a library of classes: part k extends (by threes, implements) the part of half its number ---------------------------


def _none(kind: str):
    return F.lit(None).cast(kind)


def _class_name(column: str):
    return F.concat(F.regexp_replace("p_brand", r"[.#]", "_"), F.lit(".P"), column)


def library_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("artifact"), _class_name("p_partkey").alias("fqn"), F.lit("CLASS").alias("kind"), _none("string").alias("source_file"), _none("string").alias("class_hash"), F.lit(1).alias("modifiers"))


def library_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k declares ``void mJ()`` where k + J is divisible by three: static by elevens, private by thirteens; and a field
    ``int size`` by fours."""
    key = F.col("p_partkey")
    methods = table(spark, sf_dir, "part").select(F.col("p_brand").alias("artifact"), _class_name("p_partkey").alias("owner_fqn"), key, F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j")).where((key + F.col("j")) % 3 == 0)
    bits = F.when(key % 13 == 0, 4).otherwise(1) + F.when(key % 11 == 0, 8).otherwise(0)
    name = F.concat(F.lit("m"), "j")
    shown = methods.select("artifact", "owner_fqn", F.lit("METHOD").alias("kind"), name.alias("name"), F.concat(F.lit("void "), name, F.lit("()")).alias("signature"), bits.cast("int").alias("modifiers"), (F.col("j") + 1).alias("line_from"))
    fields = table(spark, sf_dir, "part").where(key % 4 == 0).select(F.col("p_brand").alias("artifact"), _class_name("p_partkey").alias("owner_fqn"), F.lit("FIELD").alias("kind"), F.lit("size").alias("name"), F.lit("int size").alias("signature"), F.lit(1).alias("modifiers"), _none("int").alias("line_from"))
    both = shown.unionByName(fields)
    return both.select("artifact", "owner_fqn", F.concat("owner_fqn", F.lit("#"), "signature").alias("member_key"), "kind", "name", "signature", "modifiers", "line_from", _none("int").alias("line_to"), _none("string").alias("bridge_target"))


def library_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supertypes, and calls, reads and writes from a line's part to the next line's in the same order."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("artifact"), _class_name("p_partkey").alias("fqn"))
    above = part.select(F.col("p_partkey").alias("up"), F.col("fqn").alias("to_type"))
    key = F.col("p_partkey")
    hierarchy = part.join(above, F.floor(key / 2) == F.col("up")).select("artifact", F.col("fqn").alias("from_key"), F.col("fqn").alias("from_type"), F.col("to_type").alias("to_key"), "to_type", F.when(key % 3 == 0, "implements").otherwise("extends").alias("relationship"), _none("int").alias("line"))
    # A pair of parts and a line are one of their names, so they are made distinct before they get the names.
    a, b = part.distinct().select(F.col("p_partkey").alias("a"), "artifact", F.col("fqn").alias("from_type")), part.select(F.col("p_partkey").alias("b"), F.col("fqn").alias("to_type")).distinct()
    pairs = sequence_pairs(spark, sf_dir).select("a", "b", F.col("l_linenumber").cast("int").alias("line")).distinct().join(a, "a").join(b, "b")
    method = lambda t, j: F.concat(t, F.lit("#void m"), (j % 4).cast("string"), F.lit("()"))
    line = F.col("line")
    call = F.struct(method(F.col("to_type"), line + 1).alias("to_key"), F.lit("calls").alias("relationship"))
    use = F.struct(F.concat("to_type", F.lit("#int size")).alias("to_key"), F.when(line % 2 == 0, "reads_field").otherwise("writes_field").alias("relationship"))
    said = pairs.withColumn("said", F.explode(F.when(line <= 2, F.array(call, use)).otherwise(F.array(call))))
    uses = said.select("artifact", method(F.col("from_type"), line).alias("from_key"), "from_type", "said.to_key", "to_type", "said.relationship", "line")
    return hierarchy.unionByName(uses).withColumns({"parameter_index": _none("int"), "parameter_name": _none("string")})


def library_store(spark: SparkSession, sf_dir: str):
    """Facts, members and graph of the library, once for each application and input."""
    from canopy.operators.member_engine import DetailStore
    from canopy.plans.materialize import stage_table

    key = (spark.sparkContext.applicationId, "library store", sf_dir)
    if key not in _STORES:
        types, members, facts = (stage_table(f(spark, sf_dir)) for f in (library_types, library_members, library_facts))
        forget_shuffles(spark)
        # Answers need nodes and supertypes; edges of all kinds are computed by who asks for them.
        graph = build_graph(types, facts, members, placeholders=None).staged(edges=False)
        _STORES[key] = DetailStore(graph, types, members, facts)
    return _STORES[key]


_STORES: dict[tuple, object] = {}
