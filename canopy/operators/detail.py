"""Member-level facts: scoped listings, inherited rows, overrides, load-time calls, entity details."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.errors import QueryError
from canopy.functions import names
from canopy.functions.bits import bit_is_set, field_modifiers, method_modifiers, type_modifiers
from canopy.schema import DEPENDENCY_KINDS, MODIFIER_BITS, REVERSED_KINDS


def fact_order() -> list[Column]:
    """The total order of facts; a missing line or position counts as -1."""
    return [F.col(c) for c in ("from_type", "from_key", "to_type", "to_key", "relationship")] + [F.coalesce("line", F.lit(-1)), F.coalesce("parameter_index", F.lit(-1))]


def detail_rows(facts: DataFrame, from_types: DataFrame | None = None, to_types: DataFrame | None = None, relationship: str | None = None, from_member: str | None = None, to_member: str | None = None, position: int | None = None) -> DataFrame:
    """Facts in a scope, in total order.  Types are tables ``(fqn)``; None does not constrain.

    The reversed kinds are the stored ones with ends and scopes swapped.
    """
    if relationship is not None and relationship not in DEPENDENCY_KINDS:
        raise QueryError("INVALID_RELATIONSHIP", f"unknown relationship {relationship}", "use one of the known kinds", allowed=list(DEPENDENCY_KINDS))
    if relationship in REVERSED_KINDS:
        rows = detail_rows(facts, to_types, from_types, REVERSED_KINDS[relationship], to_member, from_member, position)
        swapped = {"from_key": "to_key", "to_key": "from_key", "from_type": "to_type", "to_type": "from_type"}
        return rows.select(*[(F.lit(relationship) if c == "relationship" else F.col(swapped.get(c, c))).alias(c) for c in rows.columns]).orderBy(*fact_order())
    rows = facts
    if relationship is not None:
        rows = rows.where(F.col("relationship") == relationship)
    for column, wanted in (("from_key", from_member), ("to_key", to_member), ("parameter_index", position)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    for column, types in (("from_type", from_types), ("to_type", to_types)):
        if types is not None:
            rows = rows.join(types.select(F.col("fqn").alias(column)).distinct(), column, "left_semi")
    return rows.orderBy(*fact_order())


def between_known(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Facts both of whose types are defined."""
    known = types.select("fqn").distinct()
    return facts.join(known.withColumnRenamed("fqn", "from_type"), "from_type", "left_semi").join(known.withColumnRenamed("fqn", "to_type"), "to_type", "left_semi")


def supertype_pairs(facts: DataFrame) -> DataFrame:
    """``(sub, super, depth, by_class)`` of all types: nearest depth, and whether superclasses alone lead there."""
    return pairs_above(steps_of(facts))


def steps_of(facts: DataFrame) -> DataFrame:
    """``(sub, super, by_class)``: direct supertypes by name."""
    return facts.where(F.col("relationship").isin("extends", "implements")).select(F.col("from_type").alias("sub"), F.col("to_type").alias("super"), (F.col("relationship") == "extends").alias("by_class"))


def pairs_above(direct: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``(sub, super, depth, by_class)`` over the steps ``direct(sub, super, by_class)``, from ``starts(sub)`` only if given.

    From all types the span doubles: a shortest way longer than the span is one of just that length and a rest that is known,
    so depth costs the logarithm of its rounds.  From a few starts each step joins the pairs found last with the direct ones.
    """
    from canopy.plans.materialize import scratch, stage_table

    with scratch() as keep:
        direct = stage_table(direct.groupBy("sub", "super").agg(F.max("by_class").alias("by_class")).where("sub <> super"))
        if starts is not None:
            starts = stage_table(starts.select("sub").distinct())
            if starts.count() * _MANY_STARTS < direct.count():
                return keep(stage_table(_pairs_from(direct, starts)))
        known = direct.withColumn("depth", F.lit(1))
        span = 1
        while True:
            ends = known.where(F.col("depth") == span).select("sub", F.col("super").alias("mid"), F.col("by_class").alias("c1"))
            if ends.isEmpty():
                break
            on = known.select(F.col("sub").alias("mid"), "super", F.col("depth") + span, F.col("by_class").alias("c2")).toDF("mid", "super", "depth", "c2")
            further = ends.join(on, "mid").where("sub <> super").select("sub", "super", (F.col("c1") & F.col("c2")).alias("by_class"), "depth")
            # The least depth, and of its ways one by superclasses alone if there is any.
            known = stage_table(known.select(further.columns).unionByName(further).groupBy("sub", "super").agg(F.min(F.struct("depth", (~F.col("by_class")).alias("x"))).alias("d")).select("sub", "super", (~F.col("d.x")).alias("by_class"), F.col("d.depth").alias("depth")))
            span *= 2
        known = known if starts is None else known.join(starts, "sub", "left_semi")
        return keep(stage_table(known.select("sub", "super", "depth", "by_class")))


#: Starts are followed step by step where there are this many times as many direct pairs.
_MANY_STARTS = 8


def _pairs_from(direct: DataFrame, starts: DataFrame) -> DataFrame:
    """:func:`pairs_above` step by step, until there are no new pairs."""
    from canopy.plans.materialize import stage_table

    seen = frontier = stage_table(direct.join(starts, "sub", "left_semi").withColumn("depth", F.lit(1)))
    step = direct.select(F.col("sub").alias("mid"), "super", F.col("by_class").alias("c2"))
    for depth in count(2):
        nxt = frontier.select("sub", F.col("super").alias("mid"), "by_class").join(step, "mid").where("sub <> super").groupBy("sub", "super").agg(F.max(F.col("by_class") & F.col("c2")).alias("by_class"))
        frontier = stage_table(nxt.join(seen.select("sub", "super"), ["sub", "super"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 8 == 0:  # else each step would read one more table
            seen = stage_table(seen)
    return seen.select("sub", "super", "depth", "by_class")


def pairs_below(direct: DataFrame, starts: DataFrame) -> DataFrame:
    """:func:`pairs_above` of which ``starts(super)`` are the supertypes."""
    turned = pairs_above(direct.select(F.col("super").alias("sub"), F.col("sub").alias("super"), "by_class"), starts.select(F.col("super").alias("sub")))
    return turned.select(F.col("super").alias("sub"), F.col("sub").alias("super"), "depth", "by_class")


def declared_above(direct: DataFrame, wanted: DataFrame, declared: DataFrame) -> DataFrame:
    """``(sub, signature, super, depth, by_class)``: supertypes that declare what ``wanted(sub, signature)`` asks for, as far up
    as the one meant may be: superclasses alone come first, then the nearest.

    A search ends where a way of superclasses alone meets a declaration, or any way met one and no way of superclasses alone
    is left.  So it costs the types up to the declaration meant, not all above.
    """
    from canopy.plans.materialize import scratch, stage_table

    key = ["sub", "signature"]
    with scratch() as keep:
        step = stage_table(direct.groupBy("sub", "super").agg(F.max("by_class").alias("by_class")).where("sub <> super").select(F.col("sub").alias("at"), "super", F.col("by_class").alias("c2")))
        declared = stage_table(declared.select(F.col("super").alias("at"), "signature").distinct())
        frontier = stage_table(wanted.select(*key).distinct().withColumns({"at": F.col("sub"), "by_class": F.lit(True), "met": F.lit(False)}))
        seen = found = None
        for depth in count(1):
            reached = frontier.join(step, "at").where("sub <> super").groupBy(*key, F.col("super").alias("at")).agg(F.max(F.col("by_class") & F.col("c2")).alias("by_class"), F.max("met").alias("met"))
            if seen is not None:
                reached = reached.join(seen, [*key, "at"], "left_anti")
            reached = stage_table(reached.withColumn("left", F.max("by_class").over(Window.partitionBy(*key))).where("NOT met OR left").drop("left"))
            if reached.isEmpty():
                break
            here = stage_table(reached.join(declared, ["at", "signature"], "left_semi").select(*key, F.col("at").alias("super"), F.lit(depth).alias("depth"), "by_class"))
            found = here if found is None else found.unionByName(here)
            ends = here.groupBy(*key).agg(F.max("by_class").alias("ends"))
            frontier = stage_table(reached.join(ends, key, "left").where("NOT coalesce(ends, false)").select(*key, "at", "by_class", (F.col("met") | F.col("ends").isNotNull()).alias("met")))
            seen = reached.select(*key, "at") if seen is None else seen.join(frontier.select(*key).distinct(), key, "left_semi").unionByName(reached.select(*key, "at"))
            seen = stage_table(seen)
            if depth % 8 == 0:
                found = stage_table(found)
        if found is None:
            found = wanted.select(*key, F.col("sub").alias("super"), F.lit(0).alias("depth"), F.lit(False).alias("by_class")).where(F.lit(False))
        return keep(stage_table(found))


#: Names that a filter sends to every task at most, as hashes of eight bytes.
MOST_SENT = 1_000_000


def among(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``columns`` are a row of ``names``.

    Where names are few (counted), their hashes go to every task, so that only rows which may be among them are moved.
    """
    names = names.select(*columns).distinct()
    if names.limit(MOST_SENT + 1).count() <= MOST_SENT:
        sent = names.select(F.xxhash64(*columns).alias("__hash")).distinct()
        rows = rows.join(F.broadcast(sent), F.xxhash64(*columns) == F.col("__hash"), "left_semi")
    return rows.join(names, list(columns), "left_semi")


def among_types(rows: DataFrame, column: str, types: DataFrame | None) -> DataFrame:
    """Rows whose ``column`` is one of ``types(fqn)``; None does not constrain."""
    return rows if types is None else among(rows, types.select(F.col("fqn").alias(column)), column)


def with_inherited(facts: DataFrame, scope: DataFrame, pairs: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """Facts of ``scope(fqn)`` and of its supertypes outside it (and outside ``target``), the latter ``inherited``."""
    above = pairs.join(scope.select(F.col("fqn").alias("sub")), "sub", "left_semi").select(F.col("super").alias("fqn")).distinct().join(scope.select("fqn"), "fqn", "left_anti")
    if target is not None:
        above = above.join(target.select("fqn"), "fqn", "left_anti")
    scoped = scope.select("fqn", F.lit(False).alias("inherited")).distinct().unionByName(above.withColumn("inherited", F.lit(True)))
    return facts.join(scoped.withColumnRenamed("fqn", "from_type"), "from_type")


def _without(bits: Column, *flags: str) -> Column:
    out = F.lit(True)
    for flag in flags:
        out = out & ~bit_is_set(F.coalesce(bits, F.lit(0)), MODIFIER_BITS[flag])
    return out


def overridable() -> Column:
    return _without(F.col("modifiers"), "static", "private") & ~F.contains("signature", F.lit(" <init>(")) & ~F.contains("signature", F.lit(" <clinit>("))


def _methods(members: DataFrame) -> DataFrame:
    own = members.where(F.col("kind") != "FIELD")
    return own.select("owner_fqn", "member_key", "signature", "modifiers", "line_from", F.coalesce("bridge_target", "member_key").alias("real_key"), names.name_and_parameters(F.col("signature")).alias("call_name"))


def overrides(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``overrides`` facts: a supertype's method of the same signature, or failing that of equal name and parameters."""
    subs = _methods(members).where(overridable()).select(F.col("owner_fqn").alias("sub"), F.col("member_key").alias("from_key"), "signature", "call_name", F.col("line_from").alias("line"))
    supers = _methods(members).where(overridable()).select(F.col("owner_fqn").alias("super"), F.col("signature").alias("s2"), "call_name", "real_key")
    met = subs.join(pairs.select("sub", "super"), "sub").join(supers, ["super", "call_name"])
    exact = F.max((F.col("signature") == F.col("s2")).cast("int")).over(Window.partitionBy("from_key", "super"))
    chosen = met.withColumn("exact", exact).where((F.col("exact") == 0) | (F.col("signature") == F.col("s2")))
    return chosen.select("from_key", F.col("sub").alias("from_type"), F.col("real_key").alias("to_key"), F.col("super").alias("to_type"), F.lit("overrides").alias("relationship"), "line")


def _calls(facts: DataFrame) -> DataFrame:
    return facts.where("relationship = 'calls'").select("from_key", "from_type", "to_type", "line", F.expr("substring(to_key, instr(to_key, '#') + 1)").alias("signature"))


def virtual_calls(calls: DataFrame, members: DataFrame, types: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """``calls`` facts to the implementations in scanned subtypes; not for external owners, constructors and statics.  ``few``
    says that ``pairs`` are those of a scope, so that most calls meet none."""
    from canopy.plans.materialize import stage_table

    found = _methods(members).where(overridable()).select(F.col("owner_fqn").alias("sub"), "signature", "real_key")
    below = stage_table(pairs.select(F.col("super").alias("to_type"), "sub").join(found, "sub").select("to_type", "signature", F.col("sub").alias("impl"), "real_key"))
    if few:
        calls = among(calls, below, "to_type", "signature")
    declared = members.select(F.col("owner_fqn").alias("to_type"), "signature", F.col("modifiers").alias("owner_bits"))
    direct = calls.join(types.select(F.col("fqn").alias("to_type")).distinct(), "to_type", "left_semi").where(~F.contains("signature", F.lit(" <init>("))).join(declared, ["to_type", "signature"], "left").where(_without(F.col("owner_bits"), "static"))
    out = direct.join(below, ["to_type", "signature"]).where("real_key <> from_key")
    return out.select("from_key", "from_type", F.col("real_key").alias("to_key"), F.col("impl").alias("to_type"), F.lit("calls").alias("relationship"), "line")


def inherited_calls(calls: DataFrame, members: DataFrame, types: DataFrame, direct: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``calls`` facts to the declaration that a call of an undeclared method means: superclasses first, then nearest.

    What a call means follows from its target's name, so each name is looked up once, and only calls of names that mean a
    method of ``targets(fqn)`` are met again.
    """
    from canopy.plans.materialize import stage_table

    named = calls.select("to_type", "signature").distinct().join(types.select(F.col("fqn").alias("to_type")).distinct(), "to_type", "left_semi")
    undeclared = named.join(members.select(F.col("owner_fqn").alias("to_type"), "signature"), ["to_type", "signature"], "left_anti")
    found = _methods(members).where(_without(F.col("modifiers"), "private")).select(F.col("owner_fqn").alias("super"), "signature", "real_key")
    met = declared_above(direct, undeclared.select(F.col("to_type").alias("sub"), "signature"), found)
    best = F.min(F.struct((~F.col("by_class")).alias("x"), "depth", "super", "real_key"))
    meant = met.join(found, ["super", "signature"]).groupBy(F.col("sub").alias("to_type"), "signature").agg(best.alias("p")).select("to_type", "signature", F.col("p.real_key").alias("real_key"), F.col("p.super").alias("super"))
    meant = stage_table(among_types(meant, "super", targets))
    chosen = (calls if targets is None else among(calls, meant, "to_type", "signature")).join(meant, ["to_type", "signature"]).where("real_key <> from_key")
    return chosen.select("from_key", "from_type", F.col("real_key").alias("to_key"), F.col("super").alias("to_type"), F.lit("calls").alias("relationship"), "line")


#: Relationships of facts that :func:`derived` finds.
DERIVABLE = ("overrides", "calls")


def derived(facts: DataFrame, members: DataFrame, types: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, kinds: Sequence[str] = DERIVABLE) -> DataFrame:
    """All derived facts that are not stored already, from ``sources(fqn)`` and to ``targets(fqn)`` only where given.

    With a scope only the pairs, calls and stored facts that may meet it are worked on.
    """
    from canopy.plans.materialize import stage_table

    direct = stage_table(steps_of(facts))
    calls = among_types(_calls(facts), "from_type", sources)
    if sources is not None:
        calls = stage_table(calls)
    found = []
    upward = None if targets is None or "calls" not in kinds else pairs_above(direct, targets.select(F.col("fqn").alias("sub")))
    whole = None
    if sources is None and targets is None:
        whole = pairs_above(direct)
    if "overrides" in kinds:
        if sources is not None:
            pairs = among_types(pairs_above(direct, sources.select(F.col("fqn").alias("sub"))), "super", targets)
        else:
            pairs = whole if targets is None else pairs_below(direct, targets.select(F.col("fqn").alias("super")))
        found.append(overrides(members, pairs))
    if "calls" in kinds:
        if upward is not None:
            pairs = upward
        else:
            pairs = whole if sources is None else pairs_below(direct, calls.select(F.col("to_type").alias("super")))
        found.append(virtual_calls(calls, members, types, pairs, few=targets is not None))
        found.append(inherited_calls(calls, members, types, direct, targets))
    rows = reduce(DataFrame.unionByName, found).distinct()
    stored = among_types(facts.where(F.col("relationship").isin(*kinds)).select("from_key", "from_type", "to_key", "relationship"), "from_type", sources)
    if targets is not None:
        stored = among(stored, among_types(_methods(members), "owner_fqn", targets).select(F.col("real_key").alias("to_key")), "to_key")
    return rows.join(stored.select("from_key", "to_key", "relationship"), ["from_key", "to_key", "relationship"], "left_anti")


def relationship_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("relationship").agg(F.count(F.lit(1)).alias("n"))


# --- entities ---------------------------------------------------------------------------------------------------------


def type_details(types: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each type: modifiers, generic, superclass, interfaces, annotations, member counts."""
    on_type = facts.where("from_key = from_type")
    rel = lambda kind: F.sort_array(F.collect_set(F.when(F.col("relationship") == kind, F.col("to_type"))))
    related = on_type.groupBy(F.col("from_type").alias("fqn")).agg(F.min(F.when(F.col("relationship") == "extends", F.col("to_type"))).alias("superclass"), rel("implements").alias("interfaces"), rel("annotated_by").alias("annotations"))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    own = members.groupBy(F.col("owner_fqn").alias("fqn")).agg(of("METHOD").alias("methods"), of("CONSTRUCTOR").alias("constructors"), of("FIELD").alias("fields"))
    bits = F.col("modifiers")
    shown = types.select("artifact", "fqn", "kind", "source_file", type_modifiers(bits).alias("modifiers"), bit_is_set(bits, MODIFIER_BITS["generic"]).alias("generic"))
    return shown.join(related, "fqn", "left").join(own, "fqn", "left").na.fill(0, ["methods", "constructors", "fields"])


def method_details(members: DataFrame, parameters: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each method: modifiers, parameters in order, returned and thrown types, annotations, overridden methods."""
    own = members.where("kind <> 'FIELD'").select("member_key", "owner_fqn", "name", "signature", method_modifiers(F.coalesce("modifiers", F.lit(0))).alias("modifiers"), "line_from", "line_to")
    listed = parameters.groupBy(F.col("method_key").alias("member_key")).agg(F.sort_array(F.collect_list(F.struct("index", "name", "type_fqn", F.split(F.coalesce("annotations", F.lit("")), " ").alias("annotations")))).alias("parameters"))
    rel = lambda kind, column="to_type": F.sort_array(F.collect_set(F.when(F.col("relationship") == kind, F.col(column))))
    related = facts.groupBy(F.col("from_key").alias("member_key")).agg(rel("returns").alias("returns"), rel("throws").alias("throws"), rel("raises").alias("raises"), rel("annotated_by").alias("annotations"), rel("overrides", "to_key").alias("overrides"))
    return own.join(listed, "member_key", "left").join(related, "member_key", "left")


def inherited_accesses(members: DataFrame, facts: DataFrame) -> DataFrame:
    """``(to_key, member_key)``: field references whose type only inherits the field, with the field each means.

    From a type that does not declare the name the search goes up; a type that declares it ends that way, whether or not it is
    the field meant, since it hides what lies above.  So each way costs the types up to the nearest declaration.
    """
    from canopy.plans.materialize import stage_table

    last_word = lambda c: F.substring_index(c, " ", -1)
    fields = members.where("kind = 'FIELD'").select("owner_fqn", "member_key", "signature", last_word("signature").alias("field"))
    declared = stage_table(fields.select(F.col("owner_fqn").alias("at"), "field").distinct())
    used = facts.where(F.col("relationship").isin("reads_field", "writes_field") & F.contains("to_key", F.lit("#"))).select("to_type", "to_key", F.expr("substring(to_key, instr(to_key, '#') + 1)").alias("signature")).distinct()
    frontier = used.select("to_key", "signature", last_word("signature").alias("field"), F.col("to_type").alias("at")).join(declared, ["at", "field"], "left_anti")
    steps = stage_table(facts.where(F.col("relationship").isin("extends", "implements")).select(F.col("from_type").alias("at"), F.col("to_type").alias("up")).distinct())
    frontier = seen = stage_table(frontier)
    met = None
    while not frontier.isEmpty():
        reached = frontier.join(steps, "at").select("to_key", "signature", "field", F.col("up").alias("at")).distinct()
        reached = stage_table(reached.join(seen.select("to_key", "at"), ["to_key", "at"], "left_anti"))
        here = reached.join(declared, ["at", "field"], "left_semi")
        met = here if met is None else met.unionByName(here)
        frontier = stage_table(reached.join(declared, ["at", "field"], "left_anti"))
        seen = stage_table(seen.unionByName(reached))
    if met is None:
        return fields.where(F.lit(False)).select(F.col("member_key").alias("to_key"), "member_key")
    return met.join(fields.select(F.col("owner_fqn").alias("at"), "signature", "member_key"), ["at", "signature"]).select("to_key", "member_key").distinct()


def field_details(members: DataFrame, facts: DataFrame, sample: int = 10) -> DataFrame:
    """One row for each field: modifiers, declared type, constant, and of its readers and writers, those through inheriting
    types included, their number, the first by key and the types with most of them."""
    own = members.where("kind = 'FIELD'")
    bits = F.coalesce("modifiers", F.lit(0))
    shown = own.select("member_key", "owner_fqn", "name", names.declared_type(F.col("signature")).alias("declared_type"), field_modifiers(bits).alias("modifiers"), bit_is_set(bits, MODIFIER_BITS["constant"]).alias("constant"))
    inherited = inherited_accesses(members, facts)
    through = facts.join(inherited, "to_key").withColumn("to_key", F.col("member_key")).select(facts.columns)
    for kind, name in (("reads_field", "readers"), ("writes_field", "writers")):
        use = access_digest(facts.unionByName(through), kind, sample)
        use = use.select(F.col("to_key").alias("member_key"), F.col("accessors").alias(name), F.col("sample").alias(f"{name}_sample"), F.col("by_type").alias(f"{name}_by_type"), F.col("other_types").alias(f"{name}_other_types"))
        shown = shown.join(use, "member_key", "left").na.fill(0, [name, f"{name}_other_types"])
    return shown


def access_digest(facts: DataFrame, kind: str, sample: int = 10) -> DataFrame:
    """``(to_key, accessors, sample, by_type, other_types)``: distinct accessing members of each field, the first of them by
    key, the declaring types ``(type, n)`` with most of them and how many further types there are."""
    distinct = facts.where(F.col("relationship") == kind).groupBy("to_key", "from_key").agg(F.min("from_type").alias("from_type"))
    rank = F.row_number().over(Window.partitionBy("to_key").orderBy("from_key"))
    first = distinct.withColumn("r", rank).where(F.col("r") <= sample).groupBy("to_key").agg(F.sort_array(F.collect_list("from_key")).alias("sample"))
    types = distinct.groupBy("to_key", "from_type").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("to_key").orderBy(F.col("n").desc(), "from_type"))
    of_types = types.withColumn("r", place).groupBy("to_key").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= sample, F.struct("r", F.col("from_type").alias("type"), "n")))), lambda x: F.struct(x["type"], x["n"])).alias("by_type"), F.count_if(F.col("r") > sample).alias("other_types"), F.sum("n").alias("accessors")
    )
    return of_types.join(first, "to_key")


def display_names(rows: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """A page's rows with the display name of one end; what no member defines is external."""
    shown = members.select(F.col("member_key").alias(column), F.concat("owner_fqn", F.lit("."), "name").alias(f"{column}_name"))
    return rows.join(shown, column, "left").withColumn(f"{column}_name", F.coalesce(f"{column}_name", F.concat(F.lit("external.member "), F.col(column))))


def top_accessors(rows: DataFrame, by: Sequence[str], limit: int = 10) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *by).limit(limit)
