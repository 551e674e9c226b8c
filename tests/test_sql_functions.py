"""Functions in SQL equal the Column forms."""

import random

import pytest
from pyspark.sql import functions as F

from canopy.functions import bits, names
from canopy.functions.sql import register_functions


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register_functions(spark)


def test_keys_and_names(spark):
    rows = spark.createDataFrame([("a:b", "x.y.Z"), ("", "Z"), ("m", "é.Ü$1")], "artifact string, fqn string")
    a, f = F.col("artifact"), F.col("fqn")
    want = rows.select(names.node_handle(names.type_key(a, f)).alias("h"), names.package_of(f).alias("p")).collect()
    rows.createOrReplaceTempView("named")
    assert spark.sql("SELECT node_handle(type_key(artifact, fqn)) AS h, package_of(fqn) AS p FROM named").collect() == want


def test_modifiers(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 2, 4, 8, 33, 0x3FFF, 4096 + 16, 64 + 4)], "bits int")
    rows.createOrReplaceTempView("flags")
    for kind, column in (("type", bits.type_modifiers), ("method", bits.method_modifiers), ("field", bits.field_modifiers)):
        want = [r[0] for r in rows.select(column(F.col("bits"))).collect()]
        assert [r[0] for r in spark.sql(f"SELECT decode_modifiers(bits, '{kind}') FROM flags").collect()] == want


def test_patterns(spark):
    rng = random.Random(3)
    patterns = ["a*b", "**", "a.b", "{x,y}.z", "a,b", "p{q*,r**}[1]", "\\d+$", "a{b}c{d,e}"] + ["".join(rng.choice("ab.*,:$(") for _ in range(6)) for _ in range(40)]
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    table.createOrReplaceTempView("patterns")
    got = {r["pattern"]: r["regex"] for r in spark.sql("SELECT pattern, name_pattern_regex(pattern) AS regex FROM patterns").collect()}
    assert got == {p: names.pattern_regex(p) for p in patterns}
    for wrong in ("", "{a{b}}", "{a", "a}"):
        with pytest.raises(ValueError):
            names.pattern_regex(wrong)
        with pytest.raises(Exception, match="malformed pattern"):
            spark.sql(f"SELECT name_pattern_regex('{wrong}')").collect()
