"""A Merkle manifest of a dataset: a tree for each source, a tree of the sources' roots, and a proof for every row.

A leaf is the SHA-256 of a row's values; leaves of a source ascend by id.  Every three consecutive nodes of a level (the last
run may have fewer) become the hash of their digests as hexadecimal text, until one node remains.  Roots of sources, ordered
by source, make a tree of their own.

Trees are cut into aligned blocks of ``3 ** HEIGHT`` nodes.  A block's root is one row of the level above, which is cut into
blocks again: a source of any size is spread over many tasks and after a few levels one row is left.  Proofs go the other
way.  The walk through a block emits the authentication path of one leaf after another: for each height it keeps the current
run of siblings, while a treehash stack computes the next run in time; in every step the stacks share ``height`` readings
of a leaf, the stack with the lowest node first, so at most a few digests for each height are held besides the block's leaves.
The path above the block is the same for all its leaves and arrives as one row that is appended.

Values never move, only ids and digests.  Nothing is collected to the driver but the largest number of nodes.

Defined results: a null value is written ``-``; null ids come first in their source and are never tampered with; rows that
repeat an id are ordered by their digests, and whole copies are leaves of their own; a null source is a source (the first);
an empty table gives an empty result; columns other than the five are left alone and may have any name.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.plans.materialize import scratch, stage_table

ARITY, HEIGHT = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(nodes: list[bytes]) -> bytes:
    """Digest of up to ``ARITY`` digests."""
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


class Treehash:
    """A stack that turns leaves read one after another into the nodes of one height."""

    def __init__(self, leaves: list[bytes], height: int, first: int, last: int) -> None:
        """Nodes of ``height`` over the leaves ``first`` to ``last`` (exclusive; ``first`` begins a node)."""
        self.leaves, self.height, self.at, self.end = leaves, height, first, max(first, min(last, len(leaves)))
        self.stack: list[tuple[int, bytes]] = []
        self.nodes: list[bytes] = []

    @property
    def done(self) -> bool:
        return self.at >= self.end

    @property
    def tail(self) -> int:
        """Height of the lowest node it holds."""
        return self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        """Read one leaf and join all runs it completes; after the last leaf, shorter ones too."""
        self._push(0, self.leaves[self.at])
        self.at += 1
        while self.at >= self.end and self.stack:
            low = self.stack[-1][0]
            run = [x for h, x in self.stack if h == low]
            del self.stack[-len(run) :]
            self._push(low + 1, parent(run))

    def _push(self, height: int, node: bytes) -> None:
        if height == self.height:
            self.nodes.append(node)
            return
        run = [x for h, x in self.stack[1 - ARITY :] if h == height]
        if len(run) == ARITY - 1:
            del self.stack[1 - ARITY :]
            self._push(height + 1, parent([*run, node]))
        else:
            self.stack.append((height, node))

    def finish(self) -> list[bytes]:
        while not self.done:
            self.step()
        return self.nodes


def height_of(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def block_root(leaves: list[bytes], height: int) -> bytes:
    return Treehash(leaves, height, 0, len(leaves)).finish()[0]


class Traversal:
    """Authentication paths of the leaves of one tree, one after another.  ``held`` is the most digests held at once."""

    def __init__(self, leaves: list[bytes], height: int) -> None:
        self.leaves, self.height = leaves, height
        self.runs = [Treehash(leaves, h, 0, ARITY ** (h + 1)).finish() for h in range(height)]
        self.ahead = [self._next(h, 0) for h in range(height)]
        for x in self.ahead[:-1]:
            x.finish()
        self.held = self._held()
        self.late = 0

    def _next(self, h: int, run: int) -> Treehash:
        width = ARITY ** (h + 1)
        return Treehash(self.leaves, h, (run + 1) * width, (run + 2) * width)

    def _held(self) -> int:
        return sum(map(len, self.runs)) + sum(len(x.stack) + len(x.nodes) for x in self.ahead)

    def __iter__(self) -> Iterator[list[tuple[int, list[bytes]]]]:
        """For each leaf and height the place within the run and the run's other nodes."""
        for i in range(len(self.leaves)):
            path = []
            for h, run in enumerate(self.runs):
                place = i // ARITY**h % ARITY
                path.append((place, run[:place] + run[place + 1 :]))
            yield path
            for h in range(self.height):
                width = ARITY ** (h + 1)
                if (i + 1) % width:
                    break
                self.late += not self.ahead[h].done
                self.runs[h] = self.ahead[h].finish()
                self.ahead[h] = self._next(h, (i + 1) // width)
            for _ in range(self.height):
                open_ones = [x for x in self.ahead if not x.done]
                if not open_ones:
                    break
                min(open_ones, key=lambda x: x.tail).step()
            self.held = max(self.held, self._held())


def packed_path(path: list[tuple[int, list[bytes]]]) -> bytes:
    """Two bytes and the digests for each height."""
    return b"".join(struct.pack("BB", place, len(others)) + b"".join(others) for place, others in path)


def unpacked_path(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        yield place, [path[at + 32 * k : at + 32 * k + 32] for k in range(n)]
        at += 32 * n


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and the nodes of its path give."""
    for place, others in unpacked_path(path):
        leaf = parent([*others[:place], leaf, *others[place:]])
    return leaf


def siblings_digest(path: bytes) -> str:
    return sha256("".join(x.hex() for _, others in unpacked_path(path) for x in others).encode()).hexdigest()


def encoded(*values: Column) -> Column:
    """Each value as its number of UTF-8 bytes, a colon and itself, or ``-`` if null."""
    told = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in told])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` (from 0) in the order inside their group (not null), and the group's size ``n``.

    Ranges of the global order are counted, and counts of earlier ranges added: no group needs to fit into a task.
    """
    ranged = stage_table(rows.repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(group)
    before = F.sum("__rows").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    starts = counts.select(group, "__part", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(own).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    placed = ranged.withColumn("__inside", inside).join(starts, [group, "__part"])
    return placed.select(*[c for c in ranged.columns if c != "__part"], (F.col("__before") + F.col("__inside") - 1).alias("pos"), "n")


_ROOTS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.binary())])
_ABOVE = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
_SQL_ABOVE = "grp string, pos long, path binary, subroot binary, root binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows of one block, a bounded number."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["grp"], row["block"]) != key:
                if rows:
                    yield rows
                key, rows = (row["grp"], row["block"]), []
            rows.append(row)
    if rows:
        yield rows


def _in_blocks(nodes: DataFrame, size: int, *more: DataFrame) -> DataFrame:
    """Rows of a block one after another by place; ``more`` has further rows, with their block."""
    rows = nodes.withColumn("block", F.expr(f"pos div {size}"))
    for other in more:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """One row for each block: its root as a node of the level above."""
    size = ARITY**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            n = rows[0]["n"]
            root = block_root([x["node"] for x in rows], height_of(n) if n <= size else height)
            yield pa.RecordBatch.from_pydict({"grp": [rows[0]["grp"]], "pos": [rows[0]["block"]], "n": [-(-n // size)], "node": [root]}, _ROOTS)

    return _in_blocks(nodes.select("grp", "pos", "n", "node"), size).mapInArrow(run, "grp string, pos long, n long, node binary")


def _walks(nodes: DataFrame, above: DataFrame, height: int) -> tuple[DataFrame, Callable]:
    """Rows of every block behind the row of the path above it, and a reader of them: rows, their paths and the row above."""
    size = ARITY**height

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[bytes], dict]]:
        for first, *rows in _blocks(batches):
            n = rows[0]["n"]
            walk = Traversal([x["node"] for x in rows], height_of(n) if n <= size else height)
            yield rows, [packed_path(p) + first["path"] for p in walk], first

    return _in_blocks(nodes, size, above.withColumn("block", F.col("pos")).withColumn("pos", F.lit(-1).cast("long"))), walks


def levels(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The given ``nodes(grp, pos, n, node)`` and the block roots of every level above, staged, up to one node for each group.

    Groups that reach one node early stay one node in the levels above.
    """
    out = [nodes]
    while True:
        out.append(stage_table(_roots(out[-1], height), narrow=True))
        if not (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
            return out


def paths_above(tree: list[DataFrame], tops: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``grp, pos, path, subroot, root`` above every block of a tree's lowest level; ``tops`` has these for each group's root."""
    above = tops
    for level in tree[-2:0:-1]:
        rows, walks = _walks(level, above, height)

        def run(batches: Iterator[pa.RecordBatch], walks=walks) -> Iterator[pa.RecordBatch]:
            for own, paths, first in walks(batches):
                n = len(own)
                yield pa.RecordBatch.from_pydict({"grp": [first["grp"]] * n, "pos": [x["pos"] for x in own], "path": paths, "subroot": [first["subroot"]] * n, "root": [first["root"]] * n}, _ABOVE)

        above = stage_table(rows.mapInArrow(run, _SQL_ABOVE), narrow=True)
    return above


def proofs(tree: list[DataFrame], tops: DataFrame, height: int, with_path: bool) -> DataFrame:
    """For each row of the lowest level, which has ``key`` and ``seen`` too: what its path proves."""
    rows, walks = _walks(tree[0], paths_above(tree, tops, height), height)
    kind = tree[0].schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_batch = next(batches, None)
        if first_batch is None:
            return
        key_type = first_batch.schema.field("key").type
        for own, paths, first in walks(chain([first_batch], batches)):
            n = len(own)
            ends = [folded(x["seen"] or x["node"], p) for x, p in zip(own, paths, strict=True)]
            columns = [
                pa.array([x["key"] for x in own], key_type), pa.array([x["node"].hex() for x in own]), pa.array([first["subroot"].hex()] * n), pa.array([first["root"].hex()] * n),
                pa.array(paths if with_path else [None] * n, pa.binary()), pa.array(map(siblings_digest, paths), pa.string(), size=n), pa.array([x.hex() for x in ends]), pa.array([x == first["root"] for x in ends]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof binary, proof_sha256 string, folded_root string, verified boolean")


def manifest(rows: DataFrame, group: Column, key: Column, leaf: Column, seen: Column, height: int = HEIGHT, with_path: bool = True) -> DataFrame:
    """For each row ``key, leaf, subroot, root, proof`` (the path packed), ``proof_sha256``, ``folded_root`` and ``verified``.

    Rows of a group are ordered by ``key``.  ``seen`` is the leaf as a reader computes it now (null: as it was): it is folded
    with the path of the leaf that was.
    """
    told = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))  # nulls sort first
    slim = rows.select(told.alias("grp"), key.alias("key"), F.unhex(leaf).alias("node"), F.unhex(seen).alias("seen"))
    with scratch() as keep:
        leaves = stage_table(numbered(stage_table(slim), "grp", ["key", "node", "seen"]))
        tree = levels(leaves, height)
        names = stage_table(numbered(tree[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), "grp", ["name"]), narrow=True)
        top = levels(names.select("grp", "pos", "n", "node"), height)
        whole = top[-1].select("grp", "pos", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"))
        # A name's own path lies in its block of the top tree, which the walk through one more level gives.
        sub_paths = paths_above([top[0], *top], whole, height).select("grp", "pos", "path", "root")
        tops = names.join(sub_paths, ["grp", "pos"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")
        return keep(stage_table(proofs([leaves, *tree[1:]], stage_table(tops, narrow=True), height, with_path)))


def document_manifest(documents: DataFrame) -> DataFrame:
    """The manifest of all documents by source; every second document by its checksum is read without its line ends."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in COLUMNS)
    told = lambda t: F.sha2(encoded(doc_id, source, lang, n_chars, t), 256)
    tampered = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    seen = F.when(tampered & text.contains("\n"), told(F.translate(text, "\n", "")))
    return manifest(documents, source, doc_id, told(text), seen, with_path=False).withColumnRenamed("key", "doc_id").drop("proof")
