"""The structure map against brute force on a small tree."""

import random
from itertools import product

import pytest

from canopy.operators import structure
from canopy.operators.hierarchy import DependencyGraph

#: Two roots; under the first a chain of packages, each but the last with a package as its only child.
PARENT = {1: None, 2: None, 3: 1, 4: 3, 5: 4, 6: 4, 7: 2, **{i: 5 + i % 3 for i in range(10, 34)}}


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(15)
    types = range(10, 34)
    edges = {(a, b): rng.randint(1, 9) for a, b in product(types, types) if a != b and (rng.random() < (0.3 if b % 6 < a % 6 else 0.03))} | {(10, 4): 2, (11, 11): 1, (12, 15): 3, (15, 18): 2, (18, 12): 1}
    kind = lambda i: "java.module" if i < 3 else "java.package" if i < 10 else "java.class"
    nodes = spark.createDataFrame([(i, str(i), kind(i), f"n{i}", f"q{i}", 0) for i in PARENT], "id long, key string, kind string, name string, qualified_name string, modifiers int")
    tree = spark.createDataFrame(list(PARENT.items()), "node_id long, parent_id long")
    rows = spark.createDataFrame([(a, b, w, 0) for (a, b), w in edges.items()], "from_id long, to_id long, weight int, attrs int")
    return DependencyGraph(nodes, tree, rows), edges


def _up(i):
    return [*(_up(PARENT[i]) if PARENT[i] is not None else []), i]


def _siblings(edges):
    out = {}
    for (a, b), w in edges.items():
        pairs = [(x, y) for x, y in zip(_up(a), _up(b)) if x != y]  # noqa: B905
        if pairs:
            key = (PARENT[pairs[0][0]], *pairs[0])
            out[key] = out.get(key, 0) + w
    return out


def test_levels_tangles_and_feedback(graph):
    g, edges = graph
    want = _siblings(edges)
    siblings = structure.sibling_edges(g).cache()
    assert {(r["container"], r["from_id"], r["to_id"]): r["weight"] for r in siblings.collect()} == want
    near = {i: {b for (_, a, b) in want if a == i} for i in PARENT}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        return seen

    all_of = {i: reach(i) for i in PARENT}
    core = {i: min(j for j in all_of[i] if i in all_of[j]) for i in PARENT}
    level = lambda i: max((level(j) + 1 for j in all_of[i] if core[j] != core[i]), default=0)
    tangled = structure.tangles(siblings).cache()
    found = {r["id"]: r for r in structure.structure_levels(g, siblings, tangled).collect()}
    assert {i: r["level"] for i, r in found.items()} == {i: level(i) for i in PARENT} and max(r["level"] for r in found.values()) > 1
    sizes = {i: sum(core[j] == core[i] for j in PARENT) for i in PARENT}
    assert {i: r["tangle"] for i, r in found.items()} == {i: core[i] if sizes[i] > 1 else None for i in PARENT} and max(sizes.values()) > 2
    backs = {(r["from_id"], r["to_id"]) for r in structure.feedback_edges(siblings, tangled).collect()}
    assert backs and all(core[a] == core[b] for a, b in backs)
    for i in near:  # without them nothing is in a cycle
        near[i] -= {b for a, b in backs if a == i}
    assert not any(i in reach(j) for i in PARENT for j in near[i])


def test_chains_of_packages_are_one_node(graph):
    g, _ = graph
    f = structure.folded(g)
    nodes = {r["id"]: r["name"] for r in f.nodes.collect()}
    assert nodes[3] == "n3.n4" and set(nodes) == set(PARENT) - {4} and nodes[5] == "n5"
    parents = {r["node_id"]: r["parent_id"] for r in f.tree.collect()}
    assert parents == {i: 3 if p == 4 else p for i, p in PARENT.items() if i != 4}


def test_nothing_depends_on_nothing(graph):
    g, _ = graph
    empty = DependencyGraph(g.nodes, g.tree, g.edges.where("false"))
    rows = structure.structure_levels(empty).collect()
    assert len(rows) == len(PARENT) and {(r["level"], r["tangle"]) for r in rows} == {(0, None)}
