"""Pairs of subtrees by intervals move no more of the edges than they sum."""

from pyspark.sql import functions as F

from canopy.operators import aggregate as agg
from canopy.operators import intervals
from canopy.operators.hierarchy import DependencyGraph


def test_pairs_write_no_edges(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, f"k{i}", "java.class", f"n{i}", f"n{i}", 0) for i in range(40)], "id long, key string, kind string, name string, qualified_name string, modifiers int")
    tree = spark.createDataFrame([(0, None)] + [(i, i // 3) for i in range(1, 40)], "node_id long, parent_id long")
    edges = spark.createDataFrame([(i, j, 1 + i % 3, 1 << (j % 4)) for i in range(40) for j in range(40) if (i * 7 + j) % 5 == 0], "from_id long, to_id long, weight long, attrs int")
    graph = DependencyGraph(nodes, tree, edges.withColumn("kinds", F.create_map(F.lit("calls"), F.col("weight"))))
    written, real = [], intervals.stage_table
    monkeypatch.setattr(intervals, "stage_table", lambda df, *a, **k: written.append(df.columns) or real(df, *a, **k))
    place = intervals.interval_tree(graph)
    got = place.aggregated_pairs([0, 2, 5, 2], [1, 0, 4])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, agg.aggregated_pairs(graph, [0, 2, 5], [1, 0, 4]).collect()))
    assert not any("from_id" in columns for columns in written)  # the edges were written with their kinds before
    assert place.accumulated(2).count() == agg.accumulated(graph, 2).count() and any("from_opens" in columns for columns in written)
