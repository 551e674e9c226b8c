"""Answers between scopes derive what lies between them, and the same as the whole derivation has there."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.functions.names import handle_of
from canopy.operators import detail
from canopy.operators import member_engine as engine
from canopy.operators.ingest import build_graph
from canopy.plans import materialize

TYPE = "artifact string, fqn string, kind string, modifiers int"
MEMBER = "artifact string, owner_fqn string, member_key string, kind string, name string, signature string, modifiers int, line_from int, line_to int, bridge_target string"
FACT = "artifact string, from_key string, from_type string, to_key string, to_type string, relationship string, line int, parameter_index int, parameter_name string"


def _store(spark, types, members, facts):
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((types, TYPE), (members, MEMBER), (facts, FACT))]
    return engine.DetailStore(build_graph(frames[0], frames[2], frames[1]).staged(), *frames)


def _method(artifact, owner, name, bits=1):
    return (artifact, owner, f"{owner}#void {name}()", "METHOD", name, f"void {name}()", bits, 1, None, None)


def _call(artifact, owner, target, name, line):
    return (artifact, f"{owner}#void m0()", owner, f"{target}#void {name}()", target, "calls", line, None, None)


def _step(artifact, sub, above, kind="extends"):
    return (artifact, sub, sub, above, above, kind, None, None, None)


def _type_id(artifact, fqn):
    return handle_of(f"type:{len(artifact)}:{artifact}:{fqn}")


@pytest.fixture
def written(monkeypatch):
    """Rows of every table that is written."""
    rows, real = [], materialize.stage_table

    def stage_table(df, *args, **named):
        out = real(df, *args, **named)
        rows.append(out.count())
        return out

    for module in (materialize, engine):
        monkeypatch.setattr(module, "stage_table", stage_table)
    return rows


def _many_calls(spark):
    """One base with 60 subtypes that all implement its method, and 40 callers of the base: 2400 dispatched calls."""
    subs, callers = [f"s.S{i}" for i in range(60)], [f"c.C{i}" for i in range(40)]
    types = [("b", "b.Base", "CLASS", 1)] + [("s", x, "CLASS", 1) for x in subs] + [("c", x, "CLASS", 1) for x in callers]
    members = [_method("b", "b.Base", "m1")] + [_method("s", x, "m1") for x in subs] + [_method("c", x, "m0") for x in callers]
    facts = [_step("s", x, "b.Base") for x in subs] + [_call("c", x, "b.Base", "m1", 5) for x in callers]
    return _store(spark, types, members, facts)


def test_an_answer_into_a_scope_writes_what_lies_there(spark, written):
    store = _many_calls(spark)
    answer = engine.detail_dependencies(store, to_id=_type_id("s", "s.S7"), relationship="calls")
    assert {(r["n"], r["others"]) for r in answer.by_source_type().select(F.col("rows").alias("n"), "others").collect()} == {(1, 30)}
    assert answer.rows.count() == 40 and max(written) < 500  # members and nodes; 2400 calls were written before
    assert store.derived().count() == 2400 + 60


def _random_store(spark, seed, tree):
    """Types in three artifacts, some names in two, with random supertypes (cycles among them unless a tree) and calls."""
    rng = random.Random(seed)
    n = 40
    fqns, homes = [f"p{i % 4}.T{i}" for i in range(n)], [rng.sample("xyz", 2 if i % 9 == 0 else 1) for i in range(n)]
    types = [(a, fqns[i], "CLASS", 1) for i in range(n) for a in homes[i]]
    members = [_method(a, fqns[i], f"m{j}", rng.choice([1, 1, 1, 4, 9])) for i in range(n) for a in homes[i] for j in range(3) if rng.random() < 0.4]
    steps = [(i, i // 2) for i in range(1, n)] if tree else [(i, j) for i in range(n) for j in {rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 2]))} if i != j]
    facts = [_step(a, fqns[i], fqns[j], rng.choice(["extends", "implements"])) for i, j in steps for a in homes[i]]
    facts += [_call(rng.choice(homes[i]), fqns[i], rng.choice([*fqns, "far.Away"]), f"m{rng.randrange(3)}", rng.randrange(3)) for i in (rng.randrange(n) for _ in range(120))]
    return _store(spark, types, members, facts)


@pytest.mark.parametrize("seed,tree", [(1, True), (2, False), (3, False)])
def test_scoped_facts_are_those_of_the_whole(spark, seed, tree):
    store = _random_store(spark, seed, tree)
    ids = store.definers().select("id")
    some, others = ids.where("id % 3 = 0"), ids.where("id % 2 = 1")
    plain = lambda rows: sorted(map(tuple, rows.na.fill(-1).collect()))
    for whole, part in ((store.stored(), store.stored_between), (store.derived(), store.derived_between)):
        for source, target in ((some, None), (None, others), (some, others)):
            want = whole
            for side, scope in (("from_id", source), ("to_id", target)):
                want = want if scope is None else want.join(scope.withColumnRenamed("id", side), side, "left_semi").select(whole.columns)
            assert plain(part(source, target)) == plain(want)
        assert whole.count() > 0


def _pairs(steps):
    """``{(sub, super): (depth, by_class)}`` level by level."""
    near = {}
    for a, b, c in steps:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, False) or c
    out = {}
    for s in near:
        frontier, depth, seen = {b: c for b, c in near[s].items() if b != s}, 1, {}
        while frontier:
            seen |= {b: (depth, c) for b, c in frontier.items()}
            depth += 1
            nxt = {}
            for m, c in frontier.items():
                for b, c2 in near.get(m, {}).items():
                    if b != s and b not in seen:
                        nxt[b] = nxt.get(b, False) or (c and c2)
            frontier = nxt
        out |= {(s, b): v for b, v in seen.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_and_declarations_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 50
    steps = sorted({(i, rng.randrange(n) if seed > 1 else i - 1, rng.random() < 0.6) for i in range(1, n) for _ in range(1 + (rng.random() < 0.3))})
    frame = spark.createDataFrame(steps, "sub long, super long, by_class boolean")
    want = _pairs(steps)
    got = lambda rows: {(r["sub"], r["super"]): (r["depth"], r["by_class"]) for r in rows.collect()}
    assert got(detail.pairs_above(frame)) == want
    for starts in ({3, 40}, set(range(0, n, 2))):
        own = spark.createDataFrame([(x,) for x in sorted(starts)], "sub long")
        assert got(detail.pairs_above(frame, own)) == {k: v for k, v in want.items() if k[0] in starts}
        assert got(detail.pairs_below(frame, own.withColumnRenamed("sub", "super"))) == {k: v for k, v in want.items() if k[1] in starts}
    declared = {(i, s) for i in range(n) for s in "uv" if rng.random() < 0.2}
    rows = detail.declared_above(frame, spark.createDataFrame([(i, s) for i in range(n) for s in "uvw"], "sub long, signature string"), spark.createDataFrame(sorted(declared), "super long, signature string")).collect()
    best, wanted = {}, {}
    for r in rows:
        best[r["sub"], r["signature"]] = min(best.get((r["sub"], r["signature"]), (True, 999, 0)), (not r["by_class"], r["depth"], r["super"]))
    for (a, b), (d, c) in want.items():
        for s in "uv":
            if (b, s) in declared:
                wanted[a, s] = min(wanted.get((a, s), (True, 999, 0)), (not c, d, b))
    assert best == wanted
