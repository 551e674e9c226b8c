"""Counts of sources in blocks, by near numbers and over cycles, against brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from canopy.operators import reach
from canopy.operators.hierarchy import DependencyGraph
from canopy.plans import materialize


def _graph(spark, edges, n):
    nodes = spark.range(n).select("id", F.lit("java.class").alias("kind"))
    frame = spark.createDataFrame(sorted(edges), "from_id long, to_id long").withColumn("weight", F.lit(1).cast("long"))
    return DependencyGraph(nodes, nodes, frame)


def _brute(edges, sources, most):
    into = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
    counts = Counter()
    for s in sources:
        seen, frontier, depth = set(), {s}, 0
        while frontier and (most is None or depth < most):
            depth += 1
            frontier = {a for v in frontier for a in into.get(v, ())} - sources - seen
            seen |= frontier
        counts.update(seen)
    return counts


def _parts(parts, size):
    """Graphs without edges between them, whose ids are dealt in turns, so that near ids lie in different parts."""
    rng = random.Random(8)
    return {(rng.randrange(size) * parts + p, rng.randrange(size) * parts + p) for p in range(parts) for _ in range(4 * size)}


def test_blocks_and_cycles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(reach, "_WORDS_A_BLOCK", 1)
    monkeypatch.setattr(reach, "_FEW_WORDS", 0)
    rng = random.Random(3)
    acyclic = {(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(700)) if a < b}
    for edges in (_parts(5, 60), acyclic):
        sources = set(range(0, 300, 2))
        for most in (None, 2, 3):
            got = {r["id"]: r["sources"] for r in reach.source_counts(_graph(spark, edges, 300), spark.range(0, 300, 2), max_depth=most).collect()}
            assert got == _brute(edges, sources, most)


def test_words_are_those_of_the_part(spark, monkeypatch):
    """A node of one part has words of its part's sources, and a cycle is one node of the search."""
    monkeypatch.setattr(reach, "_FEW_WORDS", 0)
    rows, real = [], materialize.stage_table

    def stage_table(df, *args, **named):
        out = real(df, *args, **named)
        rows.append(out.count() if "word" in out.columns else 0)
        return out

    monkeypatch.setattr(reach, "stage_table", stage_table)
    edges = _parts(20, 60)
    graph, sources = _graph(spark, edges, 1200), spark.range(0, 1200, 1).where("(id div 20) % 2 = 0")
    for most, bound in ((3, 3000), (None, 1000)):
        rows.clear()
        got = {r["id"]: r["sources"] for r in reach.source_counts(graph, sources, max_depth=most).collect()}
        assert got == _brute(edges, {i for i in range(1200) if i // 20 % 2 == 0}, most)
        assert max(rows) < bound  # 600 nodes times 10 words before
