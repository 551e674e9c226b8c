"""Hierarchy and aggregation on the small graphs of FIXTURES.md."""

import pytest

from canopy.errors import QueryError
from canopy.functions.names import handle_of
from canopy.operators import aggregate as agg
from canopy.operators import ingest, reach, search, views
from canopy.operators.hierarchy import DependencyGraph, dump_tree

NODES = ["root", "a1", "a2", "a3", "b1", "b2", "b3"]
ID = {n: i for i, n in enumerate(NODES)}


@pytest.fixture(scope="module")
def simple(spark):
    nodes = spark.createDataFrame([(i, n, "java.class" if i else "root", n, n, 0) for n, i in ID.items()], "id long, key string, kind string, name string, qualified_name string, modifiers int")
    above = {"a1": "root", "a2": "a1", "a3": "a2", "b1": "root", "b2": "b1", "b3": "b2"}
    tree = spark.createDataFrame([(ID[n], ID[above[n]] if n in above else None) for n in NODES], "node_id long, parent_id long")
    pairs = [("a1", "b1", 2), ("a2", "b2", 1), ("a3", "b3", 1)]
    edges = spark.createDataFrame([(ID[a], ID[b], w, 8, {"calls": w}) for a, b, w in pairs], "from_id long, to_id long, weight int, attrs int, kinds map<string,int>")
    return DependencyGraph(nodes, tree, edges)


def weight(df):
    return sum(r["weight"] for r in df.select("weight").collect())


def test_accumulated(simple):
    out = {n: weight(agg.accumulated(simple, ID[n])) for n in ("root", "a1", "a2", "a3")}
    assert out == {"root": 4, "a1": 4, "a2": 2, "a3": 1}
    assert weight(agg.accumulated(simple, ID["b1"], outgoing=False)) == 4 and weight(agg.accumulated(simple, ID["b2"], outgoing=False)) == 2


def test_aggregated_pairs(simple):
    rows = {(r["source"], r["target"]): r["weight"] for r in agg.aggregated_pairs(simple, [ID["a1"], ID["a2"], ID["a3"]], [ID["b1"], ID["b2"], ID["b3"]]).collect()}
    assert rows[ID["a1"], ID["b1"]] == 4 and rows[ID["a2"], ID["b2"]] == 2 and rows[ID["a1"], ID["b2"]] == 2 and rows[ID["a3"], ID["b3"]] == 1
    with pytest.raises(QueryError):
        agg.aggregated_pairs(simple, range(51), range(50))


def test_navigation(simple):
    assert [r["name"] for r in simple.ancestors_of(ID["a3"]).collect()] == ["a2", "a1", "root"]
    assert [r["line"] for r in dump_tree(simple, ID["root"]).collect()] == ["a1", "  a2", "    a3", "b1", "  b2", "    b3"]
    counts = {r["id"]: r["descendants"] for r in simple.descendant_counts().collect()}
    assert counts[ID["root"]] == 6 and counts[ID["a3"]] == 0
    pairs = simple.nodes.sparkSession.createDataFrame([(ID["a3"], ID["b2"]), (ID["a3"], ID["a1"])], "a long, b long")
    assert {(r["a"], r["b"]): r["ancestor"] for r in simple.lowest_common_ancestor(pairs).collect()} == {(ID["a3"], ID["b2"]): ID["root"], (ID["a3"], ID["a1"]): ID["a1"]}


def test_move_and_refusals(simple):
    moved = simple.moved([ID["a2"]], ID["b1"])
    assert weight(agg.accumulated(moved, ID["b1"])) == 2
    with pytest.raises(QueryError):
        simple.moved([ID["a1"]], ID["a3"])
    with pytest.raises(QueryError):
        simple.without_leaf(ID["a1"])


def test_rollup_and_resolution(spark):
    facts = spark.createDataFrame(
        [("m", "x.A#f()", "x.A", "x.B", "calls"), ("m", "x.A#g()", "x.A", "x.B", "calls"), ("m", "x.A", "x.A", "x.Base", "extends"), ("m", "x.A#f()", "x.A", "int", "casts"), ("m", "x.A#f()", "x.A", "x.A", "calls"), ("m", "x.A#f()", "x.A", "x.E", "raises"), ("m", "x.A#f()", "x.A", "java.lang.String", "calls"), ("m", "x.A#f()", "x.A", "org.lib.T", "calls")],
        "artifact string, from_key string, from_type string, to_type string, relationship string",
    )
    refs = {(r["to_type"], r["kind"], r["type_level"]): r["n"] for r in ingest.rollup(facts).collect()}
    assert refs == {("x.B", "calls", False): 2, ("x.Base", "extends", True): 1, ("java.lang.String", "calls", False): 1, ("org.lib.T", "calls", False): 1}
    types = spark.createDataFrame([("m", "x.A", "CLASS", 0), ("n", "x.B", "CLASS", 0), ("z", "x.B", "CLASS", 0), ("m", "x.Base", "CLASS", 0)], "artifact string, fqn string, kind string, modifiers int")
    g = ingest.build_graph(types, facts)
    keys = {r["key"] for r in g.nodes.collect()}
    assert "type:10:<external>:org.lib.T" in keys and not any("java.lang" in k for k in keys)
    edges = {(r["from_id"], r["to_id"]): (r["weight"], r["attrs"]) for r in g.edges.collect()}
    own = handle_of("type:1:m:x.A")
    assert edges[own, handle_of("type:1:n:x.B")] == (2, 8) and edges[own, handle_of("type:1:m:x.Base")] == (1, 1)
    path = spark.createDataFrame([("m", "m", 0, "m", 1), ("m", "m", 1, "z", 1), ("m", "m", 2, "n", 1)], "artifact_key string, name string, index int, dep_key string, internal int")
    chosen = {r["to_type"]: r["to_artifact"] for r in ingest.resolve_classpath(ingest.rollup(facts), types, path).collect()}
    assert chosen["x.B"] == "z" and chosen["org.lib.T"] is None
    assert ingest.handle_collisions(g.nodes).isEmpty()


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 9, 1), (1, 3, 5), (3, 9, 5)], "from_id long, to_id long, weight int")
    one, nine = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(9,)], "id long")
    best = reach.best_paths(edges, one, nine, 1).collect()
    assert [(r["path"], r["length"], r["weight"]) for r in best] == [([1, 3, 9], 2, 10)]
    found = {r["id"]: r["distance"] for r in reach.breadth_first(edges, nine).collect()}
    assert found == {2: 1, 3: 1, 1: 2}
    layers = [(a * 12 + i, (a + 1) * 12 + j, 1) for a in range(5) for i in range(12) for j in range(12)]
    dense = spark.createDataFrame(layers, "from_id long, to_id long, weight int")
    ends = lambda a: spark.createDataFrame([(a * 12 + i,) for i in range(12)], "id long")
    paths = reach.best_paths(dense, ends(0), ends(5), 20).collect()
    assert len(paths) == 20 and {r["length"] for r in paths} == {5}


def test_search_rank_and_cursor(spark):
    rows = [("handler", "java.package"), ("Handler", "java.class"), ("TextHandler", "java.class"), ("HandlerFactory", "java.class"), ("handle", "java.method")]
    nodes = spark.createDataFrame([(i, n, k, n, f"app.{n}", 0) for i, (n, k) in enumerate(rows)], "id long, key string, kind string, name string, qualified_name string, modifiers int")
    g = DependencyGraph(nodes, None, None)
    found = search.find_nodes(g, "handler").collect()
    assert [r["name"] for r in found] == sorted(["handler", "Handler"]) + ["HandlerFactory", "TextHandler"] and found[0]["total"] == 4
    cursor = search.Cursor("t", "q", "d", 20)
    assert search.Cursor.decode(cursor.encode()) == cursor
    for args, code in ((("x", "q", "d"), "WRONG_TOOL_CURSOR"), (("t", "x", "d"), "STALE_CURSOR_QUERY"), (("t", "q", "x"), "STALE_CURSOR_DATA")):
        with pytest.raises(QueryError) as e:
            cursor.validate(*args)
        assert e.value.code == code


def test_view_document_problems():
    with pytest.raises(QueryError) as e:
        views.parse_view('{"name": "v", "groups": [{"members": ["a{b{c}}"]}], "moves": [{"select": "x", "to": "y"}], "zzz": 1}')
    assert len(e.value.extras["problems"]) >= 3
    view = views.parse_view('{"name": "v", "groups": [{"name": "g", "members": ["a:*", {"match": "b", "kind": "java.module"}]}]}')
    assert view.groups[0].members[1].kind == "java.module"


def test_restructuring_effect(spark):
    weights = spark.createDataFrame([("store", "acme.parquet.R", "store", "acme.core.S", 3), ("store", "acme.core.S", "store", "acme.parquet.R", 5), ("server", "acme.web.W", "store", "acme.core.S", 2)], "from_artifact string, from_fqn string, to_artifact string, to_fqn string, weight int")
    types = spark.createDataFrame([("store", "acme.parquet.R"), ("store", "acme.core.S"), ("server", "acme.web.W")], "artifact string, fqn string")
    place = views.moved_types(types, [views.Move(views.Selector("acme.parquet", "java.package"), "acme.parquet")])
    effect = views.restructuring_effect(weights, place)
    rows = {(r["from_module"], r["to_module"]): (r["before"], r["after"], r["change"]) for r in effect.changes.collect()}
    assert rows == {("acme.parquet", "store"): (None, 3, "added"), ("store", "acme.parquet"): (None, 5, "added")}
    assert effect.new_cycles == [["acme.parquet", "store"]]
