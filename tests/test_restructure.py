"""Restructuring views on a small set of modules: placements, ids, findings and effects."""

import json

import pytest
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions.names import handle_of
from canopy.operators.ingest import build_graph
from canopy.operators.restructure import restructure
from canopy.operators.views import ViewRegistry, parse_view
from canopy.plans.materialize import stage_table

STORE, SERVER, MAPPING, EXTERNAL = "acme:store:1.0", "acme:server:1.0", "acme:mapping:1.0", "External Types"
REFERENCES = {
    (STORE, "com.acme.store.Store"): {"com.acme.store.model.Node": 1, "org.slf4j.Logger": 1},
    (STORE, "com.acme.store.model.Node"): {},
    (STORE, "com.acme.store.model.Edge"): {},
    (STORE, "com.acme.store.parquet.Reader"): {"com.acme.store.model.Node": 2, "com.acme.store.Store": 1},
    (STORE, "com.acme.store.parquet.Reader$Page"): {"com.acme.store.model.Node": 1},
    (STORE, "com.acme.store.parquet.Writer"): {"com.acme.store.model.Edge": 1},
    (STORE, "com.acme.store.detail.Query"): {"com.acme.store.parquet.Reader": 3, "com.acme.store.model.Node": 1},
    (SERVER, "com.acme.server.Service"): {"com.acme.store.Store": 1, "com.acme.store.detail.Query": 2},
    (SERVER, "com.acme.server.Helper"): {},
    (SERVER, "com.acme.server.watch.Watcher"): {"com.acme.server.Helper": 1},
    (MAPPING, "com.acme.mapping.Mapper"): {"com.acme.store.Store": 1},
}


@pytest.fixture(scope="module")
def base(spark):
    types = spark.createDataFrame([(a, f, "CLASS", 0) for a, f in REFERENCES], "artifact string, fqn string, kind string, modifiers int")
    facts = [(a, f"{f}#void m()", f, t, t, "calls") for (a, f), refs in REFERENCES.items() for t, n in refs.items() for _ in range(n)]
    return build_graph(types, spark.createDataFrame(facts, "artifact string, from_key string, from_type string, to_key string, to_type string, relationship string")).staged()


def package(fqn, module=STORE):
    return {"match": fqn, "kind": "java.package", "within": module}


def view(graph, modules, *moves, groups=()):
    text = json.dumps({"name": "v", "restructure": True, "modules": [{"name": m} for m in modules], "moves": [{"select": s, "to": t} for s, t in moves], "groups": list(groups)})
    made = restructure(graph, parse_view(text))
    made.paths = paths(made.graph)
    return made


def paths(graph):
    """Qualified names from the module down, by the node's names and module."""
    rows = graph.closure().join(graph.nodes.select(F.col("id").alias("ancestor"), "qualified_name"), "ancestor").groupBy("descendant").agg(F.sort_array(F.collect_list(F.struct("depth", "qualified_name")), asc=False).alias("p")).collect()
    kinds = {r["id"]: r["kind"] for r in graph.nodes.select("id", "kind").collect()}
    assert {r["descendant"] for r in rows} == set(kinds) and len(graph.tree.select("node_id").collect()) == len(kinds)
    return {r["descendant"]: tuple(x["qualified_name"] for x in r["p"][1:]) for r in rows}


def path_of(made, fqn, module=None):
    own = [p for p in made.paths.values() if p and p[-1] == fqn and (module is None or p[0] == module)]
    assert len(own) == 1, own
    return own[0]


def children(made, fqn, module):
    at = path_of(made, fqn, module)
    return sorted(p[-1] for p in made.paths.values() if p[:-1] == at)


def codes(made):
    return [f.code for f in made.findings]


def changes(made):
    return {(r["from_module"], r["to_module"]): (r["before"], r["after"], r["change"]) for r in made.effect.changes.collect()}


def test_extracted_package(base):
    made = view(base, ["acme.parquet"], (package("com.acme.store.parquet"), "acme.parquet"))
    assert path_of(made, "com.acme.store.parquet") == ("acme.parquet", "com", "com.acme", "com.acme.store", "com.acme.store.parquet")
    assert children(made, "com.acme.store.parquet", "acme.parquet") == ["com.acme.store.parquet.Reader", "com.acme.store.parquet.Reader$Page", "com.acme.store.parquet.Writer"]
    assert "com.acme.store.parquet" not in children(made, "com.acme.store", STORE)
    # Real nodes keep their ids, virtual ones have theirs from the view.
    ids = {p: i for i, p in made.paths.items()}
    assert ids[path_of(made, "com.acme.store.parquet")] == handle_of(f"pkg:{STORE}:com.acme.store.parquet")
    assert made.virtual_modules == {"acme.parquet": handle_of("view:v:module:acme.parquet")} and ids["acme.parquet",] == made.virtual_modules["acme.parquet"]
    assert ids[path_of(made, "com.acme.store", "acme.parquet")] == handle_of("view:v:package:acme.parquet/com.acme.store")
    assert changes(made) == {("acme.parquet", STORE): (None, 5, "added"), (STORE, "acme.parquet"): (None, 3, "added")}
    assert made.effect.cycles == made.effect.new_cycles == [["acme.parquet", STORE]] and made.findings == []
    assert paths(base) != made.paths and path_of(type("B", (), {"paths": paths(base)}), "com.acme.store.parquet")[0] == STORE


def test_dependent_package_moves_along(base):
    made = view(base, ["acme.parquet"], (package("com.acme.store.parquet"), "acme.parquet"), (package("com.acme.store.detail"), "acme.parquet"))
    assert made.effect.cycles == []
    assert changes(made) == {("acme.parquet", STORE): (None, 6, "added"), (SERVER, "acme.parquet"): (None, 2, "added"), (SERVER, STORE): (3, 1, "changed")}
    assert children(made, "com.acme.store", "acme.parquet") == ["com.acme.store.detail", "com.acme.store.parquet"]


def test_later_moves_follow_emptied_packages(base):
    rename, move = (package("com.acme.store"), f"{STORE}/com.acme.legacy"), (package("com.acme.store.parquet"), "x")
    first, second = view(base, ["x"], rename, move), view(base, ["x"], move, rename)
    assert path_of(first, "com.acme.store.parquet.Reader")[0] == "x"
    assert "com.acme.legacy.store.model" in path_of(first, "com.acme.store.model.Node")
    assert not {"VIRTUAL_MODULE_EMPTY", "MOVE_OF_MERGED_PACKAGE"} & set(codes(first))
    for fqn in ("com.acme.store.parquet.Reader", "com.acme.store.parquet.Writer", "com.acme.store.detail.Query"):
        assert path_of(first, fqn)[0] == path_of(second, fqn)[0]
    back = view(base, ["x"], (package("com.acme.store"), "x"), (package("com.acme.store.parquet"), STORE))
    assert path_of(back, "com.acme.store.Store")[0] == "x" and path_of(back, "com.acme.store.parquet.Reader")[0] == STORE
    assert not [f for f in back.findings if f.severity == "error"]


def test_merged_package_is_not_moved_again(base):
    made = view(base, [], ({"match": MAPPING, "kind": "java.module"}, STORE), (package("com.acme", MAPPING), SERVER))
    (finding,) = [f for f in made.findings if f.code == "MOVE_OF_MERGED_PACKAGE"]
    assert finding.where == "moves[1]" and "com.acme" in finding.message
    assert path_of(made, "com.acme.store.Store")[0] == STORE and path_of(made, "com.acme.mapping.Mapper")[0] == STORE


def test_external_types(base):
    made = view(base, ["x"], ({"match": "org.slf4j", "kind": "java.package"}, "x"))
    assert "CANNOT_MOVE" in codes(made) and path_of(made, "org.slf4j.Logger")[0] == EXTERNAL
    other = view(base, [], (package("com.acme.store.parquet"), EXTERNAL))
    (finding,) = [f for f in other.findings if f.code == "UNKNOWN_MOVE_TARGET"]
    assert "not scanned" in finding.message and other.paths == paths(base)


def test_types_move_with_nested_ones(base):
    made = view(base, ["acme.io"], ({"match": "com.acme.store.parquet.Reader", "kind": "types"}, "acme.io"))
    assert path_of(made, "com.acme.store.parquet.Reader") == ("acme.io", "com", "com.acme", "com.acme.store", "com.acme.store.parquet", "com.acme.store.parquet.Reader")
    assert path_of(made, "com.acme.store.parquet.Reader$Page")[:-1] == path_of(made, "com.acme.store.parquet.Reader")[:-1]
    assert children(made, "com.acme.store.parquet", STORE) == ["com.acme.store.parquet.Writer"]
    assert codes(made) == ["SPLIT_PACKAGE"] and all(x in made.findings[0].message for x in ("com.acme.store.parquet", "acme.io", STORE))
    apart = view(base, ["acme.io", "acme.pages"], ({"match": "com.acme.store.parquet.Reader", "kind": "types"}, "acme.io"), ({"match": "com.acme.store.parquet.Reader$Page", "kind": "types"}, "acme.pages"))
    assert path_of(apart, "com.acme.store.parquet.Reader$Page")[0] == "acme.pages" and path_of(apart, "com.acme.store.parquet.Reader")[0] == "acme.io"
    named = view(base, [], ({"match": "com.acme.server.Helper", "kind": "types"}, "acme:server:*/com.acme.server.util"))
    assert path_of(named, "com.acme.server.Helper") == (SERVER, "com", "com.acme", "com.acme.server", "com.acme.server.util", "com.acme.server.Helper")


def test_package_into_package(base):
    made = view(base, [], (package("com.acme.store.detail"), "acme:store:*/com.acme.store.parquet"))
    assert path_of(made, "com.acme.store.detail.Query")[-3:-1] == ("com.acme.store.parquet", "com.acme.store.parquet.detail")
    assert handle_of(f"pkg:{STORE}:com.acme.store.detail") not in made.paths
    own = view(base, [], (package("com.acme.store"), f"{STORE}/com.acme.store.parquet"))
    assert codes(own) == ["MOVE_INTO_OWN_SUBTREE"] and own.paths == paths(base)


def test_merged_module(base):
    made = view(base, [], ("acme:mapping:*", "acme:server:*"))
    assert handle_of(MAPPING) not in made.paths
    assert children(made, SERVER, SERVER) == ["com"] and children(made, "com.acme", SERVER) == ["com.acme.mapping", "com.acme.server"]
    assert changes(made) == {(MAPPING, STORE): (1, None, "removed"), (SERVER, STORE): (3, 4, "changed")} and made.findings == []
    assert codes(view(base, [], ("acme:mapping:*", f"{SERVER}/com.x"))) == ["CANNOT_MOVE"]


def test_empty_modules_and_selections(base):
    made = view(base, ["acme.mapping2"], (package("com.acme.mapping", MAPPING), "acme.mapping2"))
    assert children(made, MAPPING, MAPPING) == [] and codes(made) == ["REAL_MODULE_EMPTY"]
    none = view(base, ["y"], ("nothing.like.this", "y"), (package("com.acme.store"), "acme:**"), (package("com.acme.store"), "y"))
    assert codes(none) == ["MOVE_SELECTS_NOTHING", "NODE_MOVED_TWICE", "AMBIGUOUS_MOVE_TARGET", "VIRTUAL_MODULE_EMPTY"]


def test_collision_leaves_the_base(base, spark):
    key = "view:v:module:x"
    crowded = base.with_local_node(handle_of(key), key, "java.module", "x", handle_of("<root>"))
    made = restructure(crowded, parse_view('{"name": "v", "restructure": true, "modules": [{"name": "x"}], "moves": []}'))
    assert not made.applied and made.graph is crowded and codes(made) == ["VIRTUAL_HANDLE_COLLISION"]


def test_groups_over_moves_and_registry(base):
    text = json.dumps({"name": "v", "restructure": True, "modules": [{"name": "acme.parquet"}], "moves": [{"select": package("com.acme.store.parquet"), "to": "acme.parquet"}], "groups": [{"name": "storage", "members": ["acme:store:*", "acme.parquet"]}]})
    views = ViewRegistry()
    views.define(text)
    got = views.applied(base, "v", "g1")
    held = got.tree.where(F.col("parent_id") == handle_of("view:v:storage")).select(F.col("node_id").alias("id"))
    assert sorted(r["qualified_name"] for r in got.nodes.join(held, "id").collect()) == ["acme.parquet", STORE]
    assert views.applied(base, "v", "g1") is got
    views.define(json.dumps({"name": "w", "restructure": True, "modules": [], "moves": [{"select": "acme:mapping:*", "to": "nowhere"}]}))
    with pytest.raises(QueryError):
        views.applied(base, "w")
