"""Bursts that settle by the wall clock: the last one is emitted without a later event, reverted ones are not."""

import time

import pytest

from canopy.streaming import settle


@pytest.fixture()
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    settle.keep_state_in_files(spark)
    source = tmp_path / "in"
    source.mkdir()
    n = [0]

    def put(*rows, columns):
        n[0] += 1
        folder = tmp_path / f"w{n[0]}"
        spark.createDataFrame(list(rows), columns).coalesce(1).write.parquet(str(folder))
        for part in folder.glob("part-*.parquet"):
            part.rename(source / f"{n[0]}-{part.name}")

    yield str(source), put
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def first_batch(query):
    while not any(p["numInputRows"] for p in query.recentProgress):
        assert query.isActive
        time.sleep(0.05)


def wait_for(spark, name, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        rows = spark.sql(f"SELECT * FROM {name}").collect()
        if len(rows) >= n:
            return rows
        time.sleep(0.2)
    return rows


def test_last_burst_needs_no_later_event(spark, stream):
    source, put = stream
    columns = "module string, signature long"
    baseline = spark.createDataFrame([("kept", 1), ("back", 5), ("gone", 9)], columns)
    put(("kept", 1), ("new", 7), ("back", 6), ("gone", None), columns=columns)
    changes = spark.readStream.schema(columns).parquet(source)
    query = settle.module_changes(changes, 6000, baseline).writeStream.format("memory").queryName("module_changes").outputMode("append").start()
    try:
        first_batch(query)
        put(("back", 5), ("new", 8), columns=columns)
        rows = wait_for(spark, "module_changes", 2)
        assert {(r["module"], r["signature"], r["previous"]) for r in rows} == {("new", 8, None), ("gone", None, 9)}
        assert all((r["settled"] - r["started"]).total_seconds() >= 6 for r in rows)
        # What was reported is the baseline of the next burst.
        put(("new", 8), ("kept", 2), columns=columns)
        rows = wait_for(spark, "module_changes", 3)
        assert {(r["module"], r["signature"], r["previous"]) for r in rows[2:]} == {("kept", 2, 1)}
    finally:
        query.stop()


def test_files_settle_together(spark, stream):
    source, put = stream
    columns = "path string, signature long"
    baseline = spark.createDataFrame([("a", 1), ("b", 2)], columns)
    put(("a", 10), ("b", 20), columns=columns)
    query = settle.build_file_changes(spark.readStream.schema(columns).parquet(source), 6000, baseline).writeStream.format("memory").queryName("file_changes").outputMode("append").start()
    try:
        first_batch(query)
        put(("b", 2), ("c", 3), columns=columns)
        rows = wait_for(spark, "file_changes", 2)
        assert {(r["path"], r["signature"], r["previous"]) for r in rows} == {("a", 10, 1), ("c", 3, None)}
        assert len({r["settled"] for r in rows}) == 1
    finally:
        query.stop()
