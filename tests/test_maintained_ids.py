"""A maintained graph keeps references by id: handles are computed for types, not for references."""

from canopy.streaming import maintenance


def test_references_are_kept_by_id(spark):
    types = spark.createDataFrame([("a", "p.A", "CLASS", 1), ("b", "p.A", "CLASS", 1), ("b", "p.B", "CLASS", 1)], "artifact string, fqn string, kind string, modifiers int")
    facts = spark.createDataFrame([(a, "p.A", "p.A", "p.B", "p.B", kind, 1) for a in "ab" for kind in ("calls", "calls", "extends")], "artifact string, from_key string, from_type string, to_key string, to_type string, relationship string, line int")
    live = maintenance.start(types, facts)
    assert live.resolved.columns == ["from_id", "to_id", "kind", "type_level", "n"]  # keys before, hashed again for each row
    rows = live.resolved.collect()
    assert len(rows) == 4 and {(r["kind"], r["n"]) for r in rows} == {("calls", 2), ("extends", 1)}
    assert sorted(r["weight"] for r in live.edges.collect()) == [3, 3]
