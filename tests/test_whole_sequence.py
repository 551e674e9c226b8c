"""Queries on the whole sequence graph against brute force over all lines."""

from collections import Counter

import duckdb
import pytest

from canopy.plans import registry
from canopy.plans.oracle import sequence, with_


@pytest.fixture(scope="module")
def graph(sf_dir):
    c = duckdb.connect()
    for name in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    edges = c.execute(f"{with_(sequence())} SELECT a, b, weight FROM g").fetchall()
    starts = {x for (x,) in c.execute(f"{with_(sequence())} SELECT fqn FROM pt WHERE p_brand = 'Brand#1'").fetchall()}
    return edges, starts


def _reached(near, starts, closed=frozenset()):
    seen, frontier, d = dict.fromkeys(starts, 0), set(starts), 0
    while frontier:
        d += 1
        frontier = {y for x in frontier for y in near.get(x, ()) if y not in seen and y not in closed}
        seen |= dict.fromkeys(frontier, d)
    return {x: k for x, k in seen.items() if k}


def test_whole_sequence_graph(spark, sf_dir, graph):
    edges, starts = graph
    ahead, back = {}, {}
    for a, b, _ in edges:
        ahead.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    run = lambda name: registry.queries()[name](spark, sf_dir).collect()
    assert {r["node"]: r["distance"] for r in run("affected_by")} == _reached(back, starts)
    assert {r["distance"]: r["n"] for r in run("depends_on_by_distance")} == Counter(_reached(ahead, starts).values())
    sources = Counter(x for s in starts for x in _reached(back, {s}, starts))
    assert {r["node"]: r["sources"] for r in run("source_counts_any_length")} == sources
    nodes = {x for a, b, _ in edges for x in (a, b)}
    forward, behind = ({x: set(_reached(n, {x})) | {x} for x in nodes} for n in (ahead, back))
    groups = {frozenset(forward[x] & behind[x]) for x in nodes}
    assert sorted(r["size"] for r in run("strong_components")) == sorted(len(g) for g in groups if len(g) > 1)
