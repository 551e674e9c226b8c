"""Pages, cursors, budgets and paths of listings."""

import pytest
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.operators import listings
from canopy.operators.ingest import build_graph
from canopy.functions.names import handle_of


@pytest.fixture(scope="module")
def graph(spark):
    names = [("a", f"a.T{i}") for i in range(6)] + [("b", f"b.U{i}") for i in range(6)]
    types = spark.createDataFrame([(m, f, "CLASS", 0) for m, f in names], "artifact string, fqn string, kind string, modifiers int")
    uses = [(f"a.T{i}", f"b.U{j}") for i in range(6) for j in range(i + 1)] + [(f"a.T{i}", f"a.T{i + 1}") for i in range(5)]
    facts = [("a", f"{f}#m", f, t, t, "calls") for f, t in uses] + [("a", "a.T0", "a.T0", "b.U0", "b.U0", "extends")]
    return build_graph(types, spark.createDataFrame(facts, "artifact string, from_key string, from_type string, to_key string, to_type string, relationship string")).staged()


def test_pages_follow_one_another(graph):
    listing = listings.dependency_listing(graph, handle_of("a"), handle_of("b"), data_hash="d1")
    seen, cursor = [], None
    while True:
        page = listing.page(8, cursor)
        seen += [(r["from_name"], r["to_name"]) for r in page.rows.collect()]
        assert page.total == 21 and page.returned <= 8
        if (cursor := page.next_cursor) is None:
            break
        last = cursor
    assert seen == sorted((f"a.T{i}", f"b.U{j}") for i in range(6) for j in range(i + 1))
    other = listings.dependency_listing(graph, handle_of("a"), data_hash="d1")
    for code, asked in (("STALE_CURSOR_QUERY", other), ("STALE_CURSOR_DATA", listings.dependency_listing(graph, handle_of("a"), handle_of("b"), data_hash="d2")), ("WRONG_TOOL_CURSOR", listings.dependency_listing(graph, handle_of("a"), handle_of("b"), incoming=True, data_hash="d1"))):
        with pytest.raises(QueryError) as e:
            asked.page(8, last)
        assert e.value.code == code
    with pytest.raises(QueryError):
        listing.page(8, "!!nope!!")
    with pytest.raises(QueryError):
        listings.dependency_listing(graph, 999)


def test_budget(graph):
    listing = listings.dependency_listing(graph, handle_of("a"), handle_of("b"))
    small = listing.page(20, characters=500)
    assert 1 <= small.returned < 20 and small.next_cursor
    with pytest.raises(QueryError) as e:
        listing.page(20, characters=20)
    assert e.value.code == "RESPONSE_TOO_LARGE"


def test_summaries(graph):
    listing = listings.dependency_listing(graph, to_id=handle_of("b"), incoming=True)
    assert [(r["to_name"], r["n"]) for r in listing.top("to_name", 2).collect()] == [("b.U0", 6), ("b.U1", 5)] and listing.top("to_name", 2).first()["others"] == 4
    assert {r["attribute"]: r["edges"] for r in listing.by_attribute().collect()} == {"is_extends": 1, "is_implements": 0, "is_annotated_by": 0, "is_depends_on_other": 21}
    assert {r["kind"]: r["weight"] for r in listing.by_kind().collect()} == {"calls": 21, "extends": 1}


def test_paths_of_what_is_affected(graph):
    at = {r["qualified_name"]: r["id"] for r in graph.nodes.collect()}
    listing, reached = listings.affected_listing(graph, at["b.U5"])
    rows = {r["qualified_name"]: r for r in listings.with_paths(listing.page().rows, reached).collect()}
    assert [rows[f"a.T{i}"]["distance"] for i in range(6)] == [6, 5, 4, 3, 2, 1]
    assert rows["a.T3"]["path"] == [at["b.U5"], at["a.T5"], at["a.T4"], at["a.T3"]]
    assert listings.affected_listing(graph, at["b.U5"], kinds=["java.interface"])[0].total() == 0
    assert {r["module"] for r in listing.rows.select("module").distinct().collect()} == {"a"} and listing.rows.agg(F.max("distance")).first()[0] == 6
