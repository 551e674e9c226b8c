"""Removal of passages that repeat across documents, by difference-cover anchors.

A word goes if some window of ``window`` consecutive words covers it whose word sequence also starts in a document of a
smaller id.  Comparing every window with every other would move one row for each word of the corpus.  Instead:

1. *Anchors.*  With a difference cover D of the period v, any two positions have a common offset below v at which both
   fall on D.  So hashing runs of ``window - v + 1`` words at the positions in D modulo v only (a fifth of all) is
   enough: two equal windows share an anchor at equal offsets.  Anchors are made distinct where they are read, dealt out
   by hash, and those that occur twice or more are kept.
2. *Extension.*  The repeated anchors, as a Bloom filter of bounded size, go to all tasks.  A second reading of the
   texts extends every repeated anchor to the windows that contain it and hashes those in full.  A false positive of
   the filter only adds windows; it cannot change the result.  Windows are resolved where they are read as far as
   possible: of the equal windows in a task only the one in the smallest document goes on, so that a passage shared by
   a third of all documents sends one row for each task.
3. *Resolution.*  Windows meet by hash; all but those of the smallest document are removed.  Removed positions return
   to their documents.

Everything that moves is packed: a row is what one task sends to another.  Windows are compared by 96 bits of two
independent rolling hashes, so among 1e13 windows a false match is not to be expected.

Defined results: a null text has no words; a null id counts as larger than every id; rows that repeat an id are judged
one by one and don't remove each other; an empty table gives an empty result; columns to keep are named by the caller,
and names beginning with ``_sd_`` are reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.words import OTHER_BASE, Rolling, WordMemo, batches_of, bounded_batches, hashed, mixed, route_keys, slices, trimmed, utf8
from canopy.plans.materialize import parallelism, stage_table

#: Difference covers, each with its period; every difference modulo the period occurs.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Most bytes of the filter that is sent to all tasks.
FILTER_BYTES = 64 << 20
_HASHES, _WINDOWS = 2_000_000, 500_000
_SLICE = 2 << 20
_LAST_ID = np.iinfo(np.int64).max
_MIX = np.uint64(0x9FB21C651E98DF25)


def period_for(window: int) -> int:
    """The longest period that leaves anchors of two fifths of the window."""
    return max((v for v in COVERS if window - v + 1 >= max(1, 2 * window // 5)), default=min(COVERS))


class _Reader:
    """Word hashes and anchors of slices of documents."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.period = period_for(window)
        self.length = window - self.period + 1
        self.cover = np.isin(np.arange(self.period), COVERS[self.period])
        self.memo, self.rolling, self.other = WordMemo(), Rolling(), Rolling(OTHER_BASE)

    def windows(self, h, prefix, begin):
        """Hashes of whole windows, and 32 bits of a second hash."""
        second = self.other.windows(self.other.prefix(mixed(h)), begin, self.window)
        return self.rolling.windows(prefix, begin, self.window), (second >> np.uint64(32)).astype(np.uint32)

    def read(self, words: list[list[bytes]]):
        h, starts = hashed(words, self.memo)
        sizes = np.diff(starts)
        place = np.arange(len(h)) - np.repeat(starts[:-1], sizes)
        left = np.repeat(sizes, sizes) - place
        return h, self.rolling.prefix(h), starts, sizes, place, left

    def anchors(self, prefix, sizes, place, left):
        at = np.flatnonzero(self.cover[place % self.period] & (left >= self.length) & (np.repeat(sizes, sizes) >= self.window))
        return at, self.rolling.windows(prefix, at, self.length)


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by destination, and where each destination's rows start."""
    to = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(parts + 1))


_ANCHORS = pa.schema([("route", pa.int32()), ("once", pa.binary()), ("often", pa.binary())])


def _send_anchors(window: int, keys: list[int]):
    parts = len(keys)

    def flush(buffer: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not buffer:
            return
        unique, count = np.unique(np.concatenate(buffer), return_counts=True)
        order, cuts = _dealt(unique, parts)
        unique, often = unique[order], (count > 1)[order]
        rows = {"route": [], "once": [], "often": []}
        for k in range(parts):
            own, flag = unique[cuts[k] : cuts[k + 1]], often[cuts[k] : cuts[k + 1]]
            if len(own):
                rows["route"].append(keys[k])
                rows["once"].append(own[~flag].tobytes())
                rows["often"].append(own[flag].tobytes())
        yield from batches_of(rows, _ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, buffer, held = _Reader(window), [], 0
        for batch in batches:
            texts = utf8(batch.column(0))
            for low, high in slices(texts, _SLICE):
                _, prefix, _, sizes, place, left = reader.read([x.split() for x in texts[low:high]])
                _, h = reader.anchors(prefix, sizes, place, left)
                buffer.append(h)
                held += len(h)
                if held >= _HASHES:
                    yield from flush(buffer)
                    buffer, held = [], 0
        yield from flush(buffer)

    return run


def _filter_segments(parts: int, filter_bytes: int):
    """Bits of the repeated anchors of each destination: at most its share of ``filter_bytes``."""
    most = max(64, filter_bytes * 8 // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, often = [], []
        for batch in batches:
            once += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            often += [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
        if not once:
            return
        repeated = np.unique(np.concatenate(often))
        unique, count = np.unique(np.concatenate([*once, repeated]), return_counts=True)
        repeated = np.union1d(unique[count > 1], repeated)
        if not len(repeated):
            return
        bits = 1 << min(int(most).bit_length() - 1, max(6, int(16 * len(repeated) - 1).bit_length()))
        table = np.zeros(bits, bool)
        for probe in _probes(repeated, np.uint64(bits - 1)):
            table[probe] = True
        yield pa.RecordBatch.from_arrays([pa.array([int(repeated[0] % np.uint64(parts))], pa.int32()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    return run


def _probes(h: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(20)) & mask, ((h * _MIX) >> np.uint64(24)) & mask


class _Filter:
    """All segments as one array of bytes."""

    def __init__(self, parts: int, segments: list[tuple[int, bytes]]) -> None:
        self.parts = np.uint64(parts)
        self.base, self.mask = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
        at, blocks = 8, [bytes(8)]  # destinations without repeated anchors look into eight empty bytes
        for part, bits in segments:
            self.base[part], self.mask[part] = at * 8, len(bits) * 8 - 1
            blocks.append(bits)
            at += len(bits)
        self.bytes = np.frombuffer(b"".join(blocks), np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        part = (h % self.parts).astype(np.int64)
        out = np.ones(len(h), bool)
        for probe in _probes(h, self.mask[part]):
            bit = self.base[part] + probe.astype(np.int64)
            out &= (self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return out


def _pack_windows(h, check, doc, uid, place) -> bytes:
    """Hashes, places and runs of (id, row) in reading order; runs are short to store."""
    new = np.flatnonzero(np.r_[True, uid[1:] != uid[:-1]])
    head = np.array([len(h), len(new)], np.int64)
    return b"".join(x.tobytes() for x in (head, h, doc[new], uid[new], np.diff(np.r_[new, len(h)]), place.astype(np.int32), check))


def _unpack_windows(data: bytes):
    n, m = np.frombuffer(data, np.int64, 2)
    at, out = 16, []
    for kind, k in ((np.uint64, n), (np.int64, m), (np.int64, m), (np.int64, m), (np.int32, n), (np.uint32, n)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    return out[0], out[5], np.repeat(out[1], out[3]), np.repeat(out[2], out[3]), out[4]


def _later(h, check, doc) -> np.ndarray:
    """Which windows have an equal one in a document of a smaller id."""
    order = np.lexsort((doc, check, h))
    h, check, own = h[order], check[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])]
    out = np.empty(len(h), bool)
    out[order] = own > own[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return out


def _pack_places(uid, place) -> bytes:
    return np.array([len(uid)], np.int64).tobytes() + uid.astype(np.int64).tobytes() + place.astype(np.int32).tobytes()


def _unpack_places(data: bytes):
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.int32, n, 8 + 8 * n)


def _places_by_row(uid, place, keys: list[int]) -> Iterator[tuple[int, bytes]]:
    """Removed windows as one parcel for each destination of rows."""
    order = np.lexsort((place, uid))
    uid, place = uid[order], place[order]
    to = uid % len(keys)
    for k in np.unique(to):
        yield keys[k], _pack_places(uid[to == k], place[to == k])


#: Kinds of rows of the second reading: removed places, windows to resolve, documents to finish, finished documents.
_PLACES, _TO_RESOLVE, _OPEN, _DONE = range(4)


def _fields(extra: pa.Schema) -> pa.Schema:
    own = [("_sd_kind", pa.int32()), ("_sd_route", pa.int32()), ("_sd_uid", pa.int64()), ("_sd_data", pa.binary()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
    return pa.schema([pa.field(*x) for x in own] + [extra.field(i) for i in range(len(extra))])


def _read_windows(window: int, keys: list[int], found, extra: pa.Schema, with_text: bool):
    schema, parts = _fields(extra), len(keys)

    def empty() -> dict[str, list]:
        return {f.name: [] for f in schema}

    def parcel(rows: dict[str, list], kind: int, route: int, data: bytes) -> None:
        for f in schema:
            rows[f.name].append(None)
        rows["_sd_kind"][-1], rows["_sd_route"][-1], rows["_sd_data"][-1] = kind, route, data

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        h, check, doc, uid, place = (np.concatenate(x) for x in zip(*held, strict=True))
        gone = _later(h, check, doc)
        rows = empty()
        for route, data in _places_by_row(uid[gone], place[gone], keys):
            parcel(rows, _PLACES, route, data)
        h, check, doc, uid, place = (x[~gone] for x in (h, check, doc, uid, place))
        order, cuts = _dealt(h, parts)
        for k in range(parts):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own):
                parcel(rows, _TO_RESOLVE, keys[k], _pack_windows(h[own], check[own], doc[own], uid[own], place[own]))
        yield from batches_of(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, flt, squeeze = _Reader(window), found.value, zstandard.ZstdCompressor(1)
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        held, n_held = [], 0
        for batch in batches:
            texts = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for low, high in slices(texts, _SLICE):
                words = [x.split() for x in texts[low:high]]
                own_words, prefix, starts, sizes, place, left = reader.read(words)
                at, h = reader.anchors(prefix, sizes, place, left)
                at = at[flt.has(h)]
                n = len(place)
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, np.maximum(at - (window - reader.length), at - place[at]), 1)
                np.add.at(edge, at + 1, -1)
                begin = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (left >= window))
                of = np.searchsorted(starts, begin, side="right") - 1
                flagged = np.zeros(high - low, bool)
                flagged[of] = True
                numbers = np.array([_LAST_ID if x is None else x for x in ids[low:high]], np.int64)
                if len(begin):
                    held.append((*reader.windows(own_words, prefix, begin), numbers[of], uid + of, place[begin].astype(np.int32)))
                    n_held += len(begin)
                rows = empty()
                for i, own in enumerate(words):
                    rows["_sd_kind"].append(_OPEN if flagged[i] else _DONE)
                    rows["_sd_route"].append(keys[(uid + i) % parts] if flagged[i] else None)
                    rows["_sd_uid"].append(uid + i)
                    rows["_sd_data"].append(squeeze.compress(texts[low + i]) if flagged[i] else None)
                    rows["doc_id"].append(ids[low + i])
                    rows["n_words"].append(len(own))
                    rows["n_removed"].append(None if flagged[i] else 0)
                    rows["kept_sha256"].append(None if flagged[i] else hashlib.sha256(b" ".join(own)).hexdigest())
                    rows["kept_text"].append(texts[low + i].decode() if with_text and not flagged[i] else None)
                for f in extra:
                    rows[f.name] = batch.column(f.name).slice(low, high - low).to_pylist()
                yield from batches_of(rows, schema)
                uid += high - low
                if n_held >= _WINDOWS:
                    yield from flush(held)
                    held, n_held = [], 0
        yield from flush(held)

    return run


_RESOLVED = pa.schema([("_sd_kind", pa.int32()), ("_sd_route", pa.int32()), ("_sd_data", pa.binary())])


def _resolve(keys: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpack_windows(x) for batch in batches for x in batch.column(0).to_pylist()]
        if not got:
            return
        h, check, doc, uid, place = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.flatnonzero(_later(h, check, doc))
        rows = {"_sd_kind": [], "_sd_route": [], "_sd_data": []}
        for route, data in _places_by_row(uid[order], place[order], keys):
            rows["_sd_kind"].append(_PLACES)
            rows["_sd_route"].append(route)
            rows["_sd_data"].append(data)
        yield from batches_of(rows, _RESOLVED)

    return run


def _finish(window: int, extra: pa.Schema, with_text: bool):
    out = pa.schema([x for x in _fields(extra) if not x.name.startswith("_sd_")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, places, opened, open_ = [], [], None, zstandard.ZstdDecompressor()
        for batch in batches:
            kinds = batch.column("_sd_kind").to_pylist()
            rows = {f.name: [] for f in out}
            for i, (kind, data) in enumerate(zip(kinds, batch.column("_sd_data").to_pylist(), strict=True)):
                if kind == _PLACES:
                    uid, place = _unpack_places(data)
                    uids.append(uid)
                    places.append(place)
                    continue
                if opened is None:
                    uid = np.concatenate(uids) if uids else np.empty(0, np.int64)
                    place = np.concatenate(places) if places else np.empty(0, np.int32)
                    order = np.argsort(uid, kind="stable")
                    opened, place = uid[order], place[order]
                row = batch.column("_sd_uid")[i].as_py()
                text = open_.decompress(data)
                words = text.split()
                low, high = np.searchsorted(opened, [row, row + 1])
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, place[low:high], 1)
                np.add.at(edge, place[low:high] + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                joined = b" ".join(kept)
                for name in rows:
                    rows[name].append(batch.column(name)[i].as_py())
                rows["n_removed"][-1] = len(words) - len(kept)
                rows["kept_sha256"][-1] = hashlib.sha256(joined).hexdigest()
                rows["kept_text"][-1] = (joined if len(kept) < len(words) else text).decode() if with_text else None
            if rows["doc_id"]:
                yield from batches_of(rows, out)

    return run


def remove_repeats(documents: DataFrame, window: int = 50, keep: Sequence[str] = (), with_text: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words
    joined by one space), ``kept_text`` and the columns ``keep``.

    ``kept_text`` is null unless ``with_text``; it is the text itself where nothing goes, else the kept words joined by
    one space.  Two readings of the texts; between them moves 8 bytes for each distinct anchor of a task, after them
    about 17 bytes for each window of a repeated region and the compressed texts of the documents concerned.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if window < min(COVERS) + 1:
        raise ValueError(f"window must be at least {min(COVERS) + 1}")
    spark = documents.sparkSession
    bounded_batches(spark)
    parts = parallelism(spark)
    keys = route_keys(parts)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    extra = to_arrow_schema(documents.select(*keep).schema)

    anchors = texts.select("text").mapInArrow(trimmed(_send_anchors(window, keys)), "route int, once binary, often binary")
    segments = anchors.repartition(parts, "route").select("route", "once", "often").mapInArrow(trimmed(_filter_segments(parts, filter_bytes)), "part int, bits binary")
    found = spark.sparkContext.broadcast(_Filter(parts, [tuple(x) for x in segments.collect()]))

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + kept
    read = stage_table(texts.mapInArrow(trimmed(_read_windows(window, keys, found, extra, with_text)), "_sd_kind int, _sd_route int, _sd_uid long, _sd_data binary, " + result))
    resolved = read.where(f"_sd_kind = {_TO_RESOLVE}").select("_sd_data", "_sd_route").repartition(parts, "_sd_route").mapInArrow(trimmed(_resolve(keys)), "_sd_kind int, _sd_route int, _sd_data binary")
    to_finish = read.where(f"_sd_kind in ({_PLACES}, {_OPEN})").unionByName(resolved, allowMissingColumns=True)
    finished = to_finish.repartition(parts, "_sd_route").sortWithinPartitions("_sd_kind").mapInArrow(trimmed(_finish(window, extra, with_text)), result)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *keep]
    return read.where(f"_sd_kind = {_DONE}").select(names).unionByName(finished.select(names))
