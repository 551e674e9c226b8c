"""Overrides and load-time calls, archives, change streams."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from canopy.errors import QueryError
from canopy.operators import detail
from canopy.schema import FORMAT_KEY
from canopy.sources import tables
from canopy.streaming import changes as ch

MEMBER = "owner_fqn string, member_key string, kind string, name string, signature string, modifiers int, line_from int, line_to int, bridge_target string"
FACT = "from_key string, from_type string, to_key string, to_type string, relationship string, line int, parameter_index int, parameter_name string"


def test_overrides_and_virtual_calls(spark):
    method = lambda owner, sig, bits=1, bridge=None: (owner, f"{owner}#{sig}", "METHOD", sig.split()[1], sig, bits, 1, 2, bridge)
    members = spark.createDataFrame([method("p.Base", "void foo()"), method("p.Sub", "void foo()"), method("p.Base", "void st()", 9), method("p.Sub", "void st()", 9), method("p.Base", "void only()")], MEMBER)
    types = spark.createDataFrame([("p.Base",), ("p.Sub",), ("p.Client",)], "fqn string")
    facts = spark.createDataFrame(
        [("p.Sub", "p.Sub", "p.Base", "p.Base", "extends", None, None, None), ("p.Client#void m()", "p.Client", "p.Base#void foo()", "p.Base", "calls", 5, None, None), ("p.Client#void m()", "p.Client", "p.Base#void st()", "p.Base", "calls", 6, None, None), ("p.Client#void m()", "p.Client", "p.Sub#void only()", "p.Sub", "calls", 7, None, None)],
        FACT,
    )
    rows = {(r["from_key"], r["to_key"], r["relationship"]) for r in detail.derived(facts, members, types).collect()}
    assert rows == {("p.Sub#void foo()", "p.Base#void foo()", "overrides"), ("p.Client#void m()", "p.Sub#void foo()", "calls"), ("p.Client#void m()", "p.Base#void only()", "calls")}
    back = detail.detail_rows(facts.withColumn("relationship", pa_kind(facts)), None, None, "read_by").collect()
    assert {(r["from_key"], r["to_key"]) for r in back} == {("p.Base#void foo()", "p.Client#void m()"), ("p.Base#void st()", "p.Client#void m()"), ("p.Sub#void only()", "p.Client#void m()")}
    with pytest.raises(QueryError):
        detail.detail_rows(facts, relationship="nonsense")


def pa_kind(facts):
    from pyspark.sql import functions as F

    return F.when(F.col("relationship") == "calls", F.lit("reads_field")).otherwise(F.col("relationship"))


def test_archives(spark, tmp_path):
    table = pa.table({"artifact": ["m"], "fqn": ["x.A"], "kind": ["CLASS"], "source_file": [None], "class_hash": [None], "modifiers": pa.array([1], pa.int32())})
    folder = tmp_path / "plain"
    folder.mkdir()
    pq.write_table(table.replace_schema_metadata({FORMAT_KEY: "3"}), folder / "types.parquet")
    tables.check_format(str(folder))
    with pytest.raises(QueryError):
        tables.check_format(str(folder), key="another.key")
    target = tmp_path / tables.archive_name("g:a.jar")
    tables.zip_artifact(str(folder), str(target))
    assert target.name == "g_a.zip"
    outer = tmp_path / "outer.zip"
    import zipfile

    with zipfile.ZipFile(outer, "w") as z:
        z.write(target, "inner.zip")
    assert [r["fqn"] for r in tables.read_archives(spark, str(outer), "types").collect()] == ["x.A"]
    pq.write_table(table.replace_schema_metadata({FORMAT_KEY: "4"}), folder / "types.parquet")
    with pytest.raises(QueryError) as e:
        tables.check_format(str(folder))
    assert e.value.code == "NEWER_SNAPSHOT"


def test_manifest(tmp_path):
    path = str(tmp_path / "m.json")
    merged = tables.merged_manifest([{"gav": "a", "v": 0}, {"gav": "old"}], [{"gav": "a", "v": 1}, {"gav": "a", "v": 2}], ["a"])
    assert merged == [{"gav": "a", "v": 1}]
    assert tables.write_manifest(path, merged) and not tables.write_manifest(path, merged)


def at(*seconds):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in seconds]


def test_activity_delays(spark):
    rows = lambda times: spark.createDataFrame([("m", t) for t in times], "module string, ts timestamp")
    delays = [r["delay"] for r in ch.activity(rows(at(0, 1.5, 3)), 20).orderBy("ts").collect()]
    assert delays == [0, 1, 2]
    assert max(r["delay"] for r in ch.activity(rows(at(*range(15))), 20).collect()) == 10


def test_stream_equals_batch(spark, tmp_path):
    rows = pd.DataFrame({"module": [1, 1, 1, 2, 9], "ts": at(0, 0.1, 5, 2, 100)})
    source = tmp_path / "in"
    source.mkdir()
    pq.write_table(pa.Table.from_pandas(rows.astype({"ts": "datetime64[us]"}), preserve_index=False), source / "a.parquet")
    batch = spark.read.schema("module long, ts timestamp").parquet(str(source))
    want = {tuple(r) for r in ch.settled(batch).collect() if r["module"] != 9}
    stream = spark.readStream.schema("module long, ts timestamp").parquet(str(source))
    query = ch.settled(stream, watermark="1 second").writeStream.format("memory").queryName("settled").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM settled").collect()} == want and len(want) == 3


def test_catalog_and_coalescer():
    catalog = ch.Catalog()
    assert catalog.publish(lambda: "one") == "PUBLISHED"
    pinned = catalog.pinned()
    assert catalog.publish(lambda: 1 / 0) == "CANCELLED" and catalog.pinned() == pinned == (1, "one")
    pending = ch.Coalescer()
    pending.add({"a"})
    pending.add({"b"})
    assert pending.take() == ("rescan", {"a", "b"}) and pending.take() is None
    pending.add({"c"})
    pending.reload()
    pending.done()
    assert pending.take() == ("reload", set())
