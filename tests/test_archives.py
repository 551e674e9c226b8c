"""Archives as a data source: stored, deflated and nested entries, pushed filters, and what is refused."""

import io
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from canopy.errors import QueryError
from canopy.sources import archives


def table_bytes(names):
    body = io.BytesIO()
    pq.write_table(pa.table({"artifact": ["m"] * len(names), "fqn": names, "kind": ["CLASS"] * len(names), "modifiers": pa.array([1] * len(names), pa.int32())}), body)
    return body.getvalue()


def zipped(parts, how=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_reads_entries_in_place(spark, tmp_path):
    inner = zipped({"x/types.parquet": table_bytes(["in.A"])}, zipfile.ZIP_DEFLATED)
    (tmp_path / "a.zip").write_bytes(zipped({"types.parquet": table_bytes(["a.A", "a.B"]), "members.parquet": b"no table", "deep/b.jar": inner}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.zip").write_bytes(zipped({"types.parquet": table_bytes(["c.C"]), "d.zip": inner}, zipfile.ZIP_DEFLATED))
    (tmp_path / "note.txt").write_text("not an archive")
    rows = archives.read_archive_tables(spark, str(tmp_path), "types")
    assert sorted(r["fqn"] for r in rows.collect()) == ["a.A", "a.B", "c.C", "in.A", "in.A"]
    assert rows.schema["source_file"].nullable and {r["source_file"] for r in rows.collect()} == {None}
    assert sorted(r["fqn"] for r in archives.read_archive_tables(spark, f"{tmp_path}/a.zip", "types", nested=False).collect()) == ["a.A", "a.B"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["fqn"] for r in archives.read_archive_tables(spark, f"file://{tmp_path}", "types").where("fqn IN ('c.C', 'nowhere')").collect()] == ["c.C"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


def test_directory_is_read_by_range():
    data = zipped({"big.bin": b"\0" * 5_000_000, "types.parquet": table_bytes(["a"])})
    file = Counted(data)
    found = archives.entries(archives.Window(file, 0, len(data)))
    assert [e.name for e in found] == ["big.bin", "types.parquet"] and file.got < 300_000
    body = archives.content(archives.Window(io.BytesIO(data), 0, len(data)), found[1])
    assert pq.read_table(pa.PythonFile(body, mode="r"))["fqn"].to_pylist() == ["a"]


def test_refused():
    whole = lambda data: archives.entries(archives.Window(io.BytesIO(data), 0, len(data)))
    with pytest.raises(QueryError, match="no ZIP"):
        whole(b"PK nothing here")
    data = bytearray(zipped({"types.parquet": b"x"}))
    at = data.rfind(b"PK\5\6")
    data[at + 10 : at + 12] = b"\xff\xff"
    with pytest.raises(QueryError, match="ZIP64"):
        whole(bytes(data))
    with pytest.raises(QueryError, match="compression"):
        whole(zipped({"types.parquet": b"x" * 100}, zipfile.ZIP_BZIP2))
    short = archives.Entry("e", False, 0, 3, 10)
    with pytest.raises(QueryError, match="truncated"):
        archives.content(archives.Window(io.BytesIO(b"\x03\x00\x00"), 0, 3), short)


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"g:{i % 3}", f"p.T{i}", "CLASS", None, None, i) for i in range(200)], "artifact string, fqn string, kind string, source_file string, class_hash string, modifiers int")
    written = archives.write_archives(rows, "types", str(tmp_path / "out")).collect()
    assert sum(r["rows"] for r in written) == 200 and all("g_" in r["archive"] for r in written)
    got = archives.read_archive_tables(spark, str(tmp_path / "out"), "types").drop("archive")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
