"""ZIP archives of fact tables as a data source: ``spark.read.format("canopy_archive")``.

Options: ``path`` (a file, a folder or several joined by commas; any file system that Arrow opens), ``table`` (a name of
:data:`canopy.schema.TABLES`), ``nested`` (``true`` to look into archives inside archives, the default),
``pushdown`` (``true`` only where the session has ``spark.sql.python.filterPushdown.enabled``).

Partitions are planned from the archives' central directories, which lie at their ends and are read by range: one partition
for each entry that holds the table.  A stored entry is read in place, its Parquet footer and the column chunks asked for
only; a deflated one is inflated in its task.  ZIP64 archives are refused.  Equality and membership filters on columns go down
to the entry's row groups where the session pushes filters into Python sources.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StringType, StructType

from canopy.errors import QueryError
from canopy.schema import TABLES

FORMAT = "canopy_archive"
_ENDINGS = (".zip", ".jar")
_END = struct.Struct("<4s4H2LH")
_LOCAL = struct.Struct("<4s5H3L2H")


class Window(io.RawIOBase):
    """A part of a file as a file."""

    def __init__(self, file, start: int, size: int) -> None:
        super().__init__()
        self._file, self._start, self._size, self._at = file, start, size, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def size(self) -> int:
        return self._size

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence])
        return self._at

    def read(self, size: int = -1) -> bytes:
        left = max(0, self._size - self._at)
        n = left if size is None or size < 0 else min(size, left)
        self._file.seek(self._start + self._at)
        data = self._file.read(n)
        self._at += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


@dataclass(frozen=True)
class Entry:
    """Where an entry's data lies in its archive."""

    name: str
    stored: bool
    start: int
    packed: int
    size: int


def entries(file: Window) -> list[Entry]:
    """Entries of an archive, from its central directory alone and their local headers."""
    tail_size = min(file.size(), _END.size + 0xFFFF)
    file.seek(file.size() - tail_size)
    tail = file.read(tail_size)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) - at < _END.size:
        raise QueryError("BAD_ARCHIVE", "no end of a central directory: this is no ZIP archive")
    _, _, _, _, count, size, offset, _ = _END.unpack_from(tail, at)
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        raise QueryError("BAD_ARCHIVE", "ZIP64 archives are not supported")
    out = []
    file.seek(0)
    with zipfile.ZipFile(file) as directory:
        for info in directory.infolist():
            if info.is_dir():
                continue
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise QueryError("BAD_ARCHIVE", f"{info.filename} has the compression method {info.compress_type}")
            # Name and extra lengths of the local header may differ from those of the directory.
            file.seek(info.header_offset)
            head = _LOCAL.unpack(file.read(_LOCAL.size))
            if head[0] != b"PK\3\4":
                raise QueryError("BAD_ARCHIVE", f"{info.filename} has no local header")
            out.append(Entry(info.filename, info.compress_type == zipfile.ZIP_STORED, info.header_offset + _LOCAL.size + head[9] + head[10], info.compress_size, info.file_size))
    return out


def content(file: Window, entry: Entry) -> Window:
    """An entry as a file: in place if stored, else inflated."""
    if entry.stored:
        return Window(file, entry.start, entry.size)
    file.seek(entry.start)
    data = zlib.decompressobj(-15).decompress(file.read(entry.packed), entry.size)
    if len(data) != entry.size:
        raise QueryError("BAD_ARCHIVE", f"{entry.name} is truncated")
    return Window(io.BytesIO(data), 0, len(data))


@dataclass
class _Table(InputPartition):
    """An entry of an archive, by the way through nested archives."""

    archive: str
    way: tuple[Entry, ...]


def _open(path: str) -> Window:
    system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    file = system.open_input_file(inner)
    return Window(file, 0, file.size())


def _archives(paths: Iterable[str]) -> Iterator[str]:
    """Archives by name; folders are listed."""
    for path in paths:
        system, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise QueryError("NOT_FOUND", f"{path} does not exist")
        if info.type == pafs.FileType.File:
            yield path
        else:
            yield from sorted(prefix + x.path for x in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(_ENDINGS))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.table = options.get("table", "")
        self.nested = options.get("nested", "true").lower() == "true"
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.columns = [f for f in schema.fieldNames() if f != "archive"]
        self.wanted: list[tuple[str, str, object]] = []

    def partitions(self) -> list[_Table]:
        def found(file: Window, way: tuple[Entry, ...]) -> Iterator[tuple[Entry, ...]]:
            for entry in entries(file):
                base = entry.name.rpartition("/")[2]
                if base == f"{self.table}.parquet":
                    yield (*way, entry)
                elif self.nested and base.endswith(_ENDINGS):
                    yield from found(content(file, entry), (*way, entry))

        return [_Table(archive, way) for archive in _archives(self.paths) for way in found(_open(archive), ())]

    def read(self, partition: _Table) -> Iterator[pa.RecordBatch]:
        file = _open(partition.archive)
        for entry in partition.way:
            file = content(file, entry)
        source = pa.PythonFile(file, mode="r")
        there = pq.ParquetFile(source)
        names = set(there.schema_arrow.names)
        choice = None
        for column, _, values in self.wanted:
            if column in names:
                one = ds.field(column).isin([v for v in values if v is not None])
                choice = one if choice is None else choice & one
        table = pq.read_table(source, columns=[c for c in self.columns if c in names], filters=choice)
        kinds = {f.name: (pa.string() if isinstance(f.dataType, StringType) else pa.int32()) for f in TABLES[self.table].fields}
        for batch in table.to_batches(max_chunksize=65_536):
            columns = [batch.column(c).cast(kinds[c]) if c in batch.schema.names else pa.nulls(batch.num_rows, kinds[c]) for c in self.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([partition.archive] * batch.num_rows, pa.string())], names=[*self.columns, "archive"])


class _FilteringReader(_Reader):
    """The reader of sessions that push filters into Python sources; others don't accept one that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what row groups can be chosen by; Spark evaluates all filters again."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.wanted.append((f.attribute[0], "in", list(f.value) if isinstance(f, In) else [f.value]))
            yield f


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        table = self.options.get("table", "")
        if table not in TABLES:
            raise QueryError("INVALID_PARAMETER", f"table must be one of {sorted(TABLES)}")
        fields = StructType()
        for f in TABLES[table].fields:
            fields = fields.add(f.name, f.dataType, True)
        return fields.add("archive", "string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown") == "true" else _Reader)(schema, dict(self.options))


def read_archive_tables(spark: SparkSession, path: str, table: str, nested: bool = True) -> DataFrame:
    """A fact table out of archives, with the ``archive`` of each row."""
    spark.dataSource.register(ArchiveSource)
    pushdown = str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()
    return spark.read.format(FORMAT).option("pushdown", pushdown).option("table", table).option("nested", str(nested).lower()).load(path)


def write_archives(rows: DataFrame, table: str, target: str) -> DataFrame:
    """Fact rows with their ``artifact`` as archives of one stored table in the folder ``target``: ``(archive, rows)``.

    Rows are sorted by artifact, so a task writes one archive after another; an artifact whose rows lie in several tasks has
    an archive for each.  A task holds the rows of one archive part at a time.
    """
    columns = [f.name for f in TABLES[table].fields if f.name in rows.columns]
    at = columns.index("artifact") if "artifact" in columns else None
    ordered = rows.select(*columns, *([] if at is not None else ["artifact"])).repartitionByRange("artifact").sortWithinPartitions("artifact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, inner = pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (pafs.LocalFileSystem(), target)
        system.create_dir(inner, recursive=True)
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("artifact")).to_pylist()
            low = 0
            for high in range(1, len(names) + 1):
                if high < len(names) and names[high] == names[low]:
                    continue
                part = pa.Table.from_batches([batch.slice(low, high - low)])
                if at is None:
                    part = part.drop_columns(["artifact"])
                body, whole = io.BytesIO(), io.BytesIO()
                pq.write_table(part, body, compression="zstd")
                with zipfile.ZipFile(whole, "w", zipfile.ZIP_STORED) as z:
                    z.writestr(f"{table}.parquet", body.getvalue())
                stem = "".join("_" if c in ":/\\" else c for c in names[low])
                name = f"{inner}/{stem}-{uuid.uuid4().hex[:12]}.zip"
                with system.open_output_stream(name) as out:
                    out.write(whole.getvalue())
                yield pa.RecordBatch.from_pydict({"archive": [name], "rows": [high - low]})
                low = high

    return ordered.mapInArrow(run, "archive string, rows long")
