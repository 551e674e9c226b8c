"""Near-duplicate documents by MinHash and an LSH forest.

A document's set is that of its distinct word shingles.  Documents with equal sets form a class at once; the forest works
on one representative of each class, so thousands of exact copies cost one row.

*Forest.*  A signature of ``64`` minima is read in 16 orders.  In each order all representatives are sorted globally
(range-partitioned, so a dense region spreads over tasks).  Neighbours in an order are those with the longest common
prefix: where signatures are sparse, four equal leading minima end the search; where they are dense, only neighbours that
agree much deeper stand next to each other, so the depth adapts to the region.  A row becomes a candidate with its
``NEIGHBOURS`` predecessors and with the first row of its region (equal first four minima): the latter ties dense regions
together with one row each.  A pair of similarity 0.8 shares a region in some order with probability 1-(1-0.8^4)^16 = 0.9998.

*All pairs of regions.*  Where a region has more rows than neighbours and these are still in different components, all its
pairs across components are tried.  In regions of up to ``DIRECT`` rows a task compares the sketches (four bits of each
minimum) of all rows and ties those that agree often enough for the similarity, by a spanning forest: sharing a region ties
nothing by itself.  Rows of larger regions go through a prefix-filter join on their full sets, rarest shingles first; its
long lists are compared by sketches too (only lists above ``LISTED`` rows tie all their rows), and short ones give candidates.
Tied rows form families, whose blocks meet two by two: a task compares all rows of two blocks and sends out a spanning forest
of the links it finds, so no pair is listed.  Shingle frequencies of a bounded sample only choose the order of the filter, so
they don't bear on what is found.

*Confirmation.*  Candidates whose signatures agree too seldom (four standard deviations below the threshold) go; the rest
are confirmed on the full sets.  Texts of concerned documents move compressed, about once for each edge that is tried.  Edges that
can't change the components are left out: first one edge of each document, then one of each pair of components, then
every candidate that still crosses components.

Defined results: a null or empty text has no shingles and no links; fewer words than a shingle make one shingle of the
whole text; a null id has no links, a null component and is kept; rows that repeat an id are one vertex with the links of
all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.components import connected_components
from canopy.llm.words import Rolling, WordMemo, bounded_batches, hashed, mixed, slices, trimmed, utf8
from canopy.plans.materialize import parallelism, release, scratch, stage_table

MINIMA, ORDERS, PREFIX, DEPTH, NEIGHBOURS = 64, 16, 4, 8, 3
#: Most bytes of the filter of document ids that is sent to all tasks.
FILTER_BYTES = 32 << 20
#: Rows up to which a region is a family; documents whose shingles are counted for the order of the prefix filter.
DIRECT, _COUNTED = 128, 20_000
#: Rows of a shingle's list that are compared by sketches in one task.
LISTED = 4096
#: Rows up to which all pairs of a shingle's list are listed; rows and shingles of a block of a family.
_SHORT, _BLOCK_ROWS, _BLOCK_SHINGLES = 16, 1024, 1_000_000
#: Children whose texts meet one parent's in one group.
_BRANCH = 128
_SEED = 20240229
_SLICE = 1 << 20


class Shingles:
    """Distinct shingle hashes of documents: sorted within each, one document after another."""

    def __init__(self, words: int) -> None:
        self.words, self.memo, self.rolling = words, WordMemo(), Rolling()

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h, starts = hashed([x.lower().split() for x in texts], self.memo)
        sizes = np.diff(starts)
        prefix = self.rolling.prefix(h)
        counts = np.where(sizes == 0, 0, np.maximum(sizes - self.words + 1, 1))
        own = np.repeat(np.arange(len(texts)), counts)
        begin = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[:-1], counts)
        x = self.rolling.windows(prefix, begin, np.minimum(np.repeat(sizes, counts), self.words))
        cuts = np.zeros(len(texts) + 1, np.int64)
        kept = []
        low = 0
        for i, n in enumerate(counts.tolist()):
            unique = np.unique(x[low : low + n])
            kept.append(unique)
            cuts[i + 1] = cuts[i] + len(unique)
            low += n
        return (np.concatenate(kept) if kept else np.empty(0, np.uint64)), cuts


def _signatures(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("sig", pa.binary())])
    rng = np.random.default_rng(_SEED)
    turn = rng.integers(0, 1 << 63, MINIMA, np.uint64)
    by = rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            for low, high in slices(texts, _SLICE):
                x, cuts = shingles.sets(texts[low:high])
                some = np.flatnonzero(np.diff(cuts))
                sig = np.zeros((high - low, MINIMA), np.uint16)
                if len(some):
                    buffer = np.empty_like(x)
                    for k in range(MINIMA):
                        np.bitwise_xor(x, turn[k], out=buffer)
                        np.multiply(buffer, by[k], out=buffer)
                        sig[some, k] = (np.minimum.reduceat(buffer, cuts[some]) >> np.uint64(24)).astype(np.uint16)
                digests = [xxhash.xxh3_128_digest(x[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                empty = np.diff(cuts) == 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(np.diff(cuts)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([None if e else s.tobytes() for e, s in zip(empty, sig, strict=True)], pa.binary())],
                    schema=schema,
                )

    return run


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("tail", pa.bool_()), ("tree", pa.int32()), ("key", pa.binary())])


def _pairs_in_order(part, tree: np.ndarray, key: np.ndarray, ids: np.ndarray, fresh: int, leader):
    """Candidate pairs of sorted rows, the first ``fresh`` of which were seen before; and the last region's leader."""
    a, b = [], []
    same = np.zeros(len(ids), bool)
    same[1:] = (tree[1:] == tree[:-1]) & (key[1:, :PREFIX] == key[:-1, :PREFIX]).all(axis=1)
    region = np.cumsum(~same)  # equal numbers: one region
    for d in range(1, NEIGHBOURS + 1):
        at = np.arange(max(d, fresh), len(ids))
        at = at[region[at] == region[at - d]]
        a.append(ids[at])
        b.append(ids[at - d])
    first = np.flatnonzero(~same)
    head = ids[first]
    if leader is not None and leader[0] == tree[0] and (leader[1] == key[0, :PREFIX]).all():
        head = head.copy()
        head[0] = leader[2]
    at = np.arange(fresh, len(ids))
    a.append(ids[at])
    b.append(head[region[at] - 1])
    a, b = np.concatenate(a), np.concatenate(b)
    last = (tree[-1], key[-1, :PREFIX].copy(), head[-1])
    low, high = np.minimum(a, b), np.maximum(a, b)
    return low[low != high], high[low != high], last


def _scan_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside a range of the sorted orders, and the rows at either end, for :func:`_across`."""
    from pyspark import TaskContext

    task = TaskContext.get()
    part = task.partitionId() if task else 0
    held = leader = None
    seen = 0

    def ends(tree, key, ids, at, tail):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.nulls(n, pa.int64()), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), pa.array([tail] * n), pa.array(tree), pa.array([k.tobytes() for k in key], pa.binary())], schema=_PAIRS
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).to_numpy().astype(np.int32)
        key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, DEPTH)
        ids = batch.column(2).to_numpy()
        if seen < NEIGHBOURS:
            k = min(NEIGHBOURS - seen, len(ids))
            yield ends(tree[:k], key[:k], ids[:k], seen, False)
        seen += len(ids)
        fresh = 0
        if held is not None:
            fresh = len(held[2])
            tree, key, ids = np.concatenate([held[0], tree]), np.concatenate([held[1], key]), np.concatenate([held[2], ids])
        a, b, leader = _pairs_in_order(part, tree, key, ids, fresh, leader)
        held = tree[-NEIGHBOURS:], key[-NEIGHBOURS:], ids[-NEIGHBOURS:]
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        if n := len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_PAIRS)
    if held is not None:
        yield ends(*held, seen - len(held[2]), True)


def _across(ends: list) -> list[tuple[int, int]]:
    """Pairs whose rows lie in different ranges, from the few rows at the ends of each range."""
    rows = sorted({(r["part"], r["place"], r["tree"], r["key"], r["a"]) for r in ends})
    out = set()
    for i, (part, _, tree, key, x) in enumerate(rows):
        for other, _, tree_, key_, y in rows[max(0, i - NEIGHBOURS) : i]:
            if other != part and tree == tree_ and key[: 2 * PREFIX] == key_[: 2 * PREFIX] and x != y:
                out.add((min(x, y), max(x, y)))
    return sorted(out)


def _candidates(reps: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of representatives that are neighbours in some order."""
    spark = reps.sparkSession
    twice = F.concat("sig", "sig")
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring(twice, 1 + 2 * PREFIX * t, 2 * DEPTH).alias("key")) for t in range(ORDERS)])).alias("o")
    rows = reps.select("id", keys).select("o.tree", "o.key", "id")
    ordered = rows.repartitionByRange(parallelism(spark), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = stage_table(ordered.mapInArrow(trimmed(_scan_orders), "a long, b long, part int, place int, tail boolean, tree int, key binary"), dealt=True)
    stitched = spark.createDataFrame(_across(found.where("part is not null").collect()), "a long, b long")  # 2 * NEIGHBOURS rows of each partition
    return found.where("part is null").select("a", "b").unionByName(stitched).distinct()


def least_agreement(percent: int, bits: int = 16) -> int:
    """Minima of so many bits in which two documents of the similarity agree at least: four standard deviations below what is
    expected, where different minima agree by chance too."""
    share = percent / 100
    share += (1 - share) / (1 << bits) if bits < 16 else 0
    return int(np.floor(MINIMA * share - 4 * np.sqrt(MINIMA * share * (1 - share))))


def _agreeing(candidates: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity and whose signatures don't speak against it, with ``agree``."""
    least = least_agreement(percent)
    left = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    sized = candidates.join(left, "a").join(right, "b").where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, MINIMA) for k in (2, 3))
                agree = (x == y).sum(axis=1).astype(np.int32)
                keep = agree >= least
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(agree[keep])], names=["a", "b", "agree"])

    return sized.select("a", "b", "sa", "sb").mapInArrow(trimmed(run), "a long, b long, agree int")


def _id_filter(spark, ids: DataFrame, n: int, filter_bytes: int):
    """A Bloom filter of ids, of at most ``filter_bytes``: a broadcast array of bits."""
    bits = 1 << min(int(filter_bytes * 8).bit_length() - 1, max(10, int(16 * n).bit_length()))
    pieces = max(1, bits >> 20)
    width = bits // pieces

    def probes(x: np.ndarray):
        h = mixed(x.astype(np.uint64))
        own = (h % np.uint64(pieces)).astype(np.int64) * width
        return [own + ((h >> np.uint64(s)) & np.uint64(width - 1)).astype(np.int64) for s in (20, 42)]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            own = batch.column(1).to_numpy()
            for piece in np.unique(own).tolist():
                table = tables.setdefault(piece, np.zeros(width, bool))
                for p in probes(x[own == piece]):
                    table[p % width] = True
        for piece, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([np.packbits(table, bitorder="little").tobytes()], pa.binary())], names=["piece", "bits"])

    def pieces_of(batches):
        for batch in batches:
            x = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((mixed(x.astype(np.uint64)) % np.uint64(pieces)).astype(np.int64))], names=["id", "piece"])

    whole = np.zeros((pieces, width // 8), np.uint8)
    filled = ids.mapInArrow(trimmed(pieces_of), "id long, piece long").repartition(parallelism(spark), "piece").mapInArrow(trimmed(fill), "piece long, bits binary")
    for row in filled.collect():  # filter_bytes at most
        whole[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(whole.reshape(-1))

    def has(x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p in probes(x):
            out &= (sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return out

    return has


def _texts_of(documents: DataFrame, ids: DataFrame, n: int, filter_bytes: int) -> DataFrame:
    """``(id, data)``: compressed texts of at least the documents of ``ids``; the filter spares the others a shuffle."""
    has = _id_filter(documents.sparkSession, ids, n, filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            keep = pa.array(has(batch.column(0).to_numpy())) if batch.num_rows else pa.array([], pa.bool_())
            batch = batch.filter(keep)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(x) for x in utf8(batch.column(1))], pa.binary())], names=["id", "data"])

    return stage_table(documents.select("doc_id", "text").mapInArrow(trimmed(run), "id long, data binary"), dealt=True)


def split_by_id(rows: DataFrame, key: str, ids: DataFrame, n: int, filter_bytes: int = FILTER_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` (a long) is surely not among the ``n`` distinct ids of the one-column table ``ids``, and the rest."""
    has = _id_filter(rows.sparkSession, ids, max(n, 1), filter_bytes)

    @F.arrow_udf("boolean")
    def found(x: pa.Array) -> pa.Array:
        return pa.array(has(x.to_numpy(zero_copy_only=False)))

    hit = F.col(key).isNotNull() & found(F.coalesce(F.col(key), F.lit(0)).cast("long"))
    return rows.where(~hit), rows.where(hit)


def _confirmed(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of staged edges ``(a, b)``, b the parent, those that hold on the full sets.  A parent's text goes to each ``_BRANCH``
    children."""
    spark = edges.sparkSession
    edges = edges.select("a", "b")
    fans = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / _BRANCH).cast("int").alias("branches"))
    branches = fans.select("b", F.explode(F.sequence(F.lit(0), F.col("branches") - 1)).alias("branch"))
    parents = branches.join(texts.withColumnRenamed("id", "b"), "b").select("b", "branch", F.lit(None).cast("long").alias("a"), "data")
    branch = F.coalesce(F.pmod(F.xxhash64("a"), "branches"), F.lit(0)).cast("int")
    edges = edges.join(fans.where("branches > 1"), "b", "left").select("a", "b", branch.alias("branch"))
    children = edges.join(texts.withColumnRenamed("id", "a"), "a").select("b", "branch", "a", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(words), zstandard.ZstdDecompressor()
        at, bases = None, []
        for batch in batches:
            good_a, good_b = [], []
            for b, branch, a, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = shingles.sets([open_.decompress(data)])[0]
                if (b, branch) != at:
                    at, bases = (b, branch), []
                if a is None:
                    bases.append(own)
                    continue
                for base in bases:  # more than one only where an id is repeated
                    both = len(np.intersect1d(base, own, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(own) - both):
                        good_a.append(a)
                        good_b.append(b)
            if good_a:
                yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], names=["a", "b"])

    together = parents.unionByName(children).repartition(parallelism(spark), "b", "branch").sortWithinPartitions("b", "branch", F.col("a").asc_nulls_first())
    return stage_table(together.select("b", "branch", "a", "data").mapInArrow(trimmed(run), "a long, b long"), dealt=True)


def _crossing(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges between different components, with these as ``ca`` and ``cb``."""
    a = components.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = components.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    named = edges.join(a, "a", "left").join(b, "b", "left").withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return named.where("ca <> cb")


def _regions(reps: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(region, id, component, n)`` of all orders, and ``(region, size, first)`` where components differ and pairs were left
    out."""
    twice = F.concat("sig", "sig")
    named = reps.join(components, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("n_shingles").alias("n"), twice.alias("twice"))
    region = F.explode(F.array(*[F.xxhash64(F.lit(t), F.substring("twice", 1 + 2 * PREFIX * t, 2 * PREFIX)) for t in range(ORDERS)])).alias("region")
    rows = named.select(region, "id", "component", "n")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first"))
    return rows, stage_table(sizes.where(f"size > {NEIGHBOURS + 1} AND low <> high").select("region", "size", "first"), narrow=True)


def _sketches(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, sketch)`` of the rows of ``ids(id)``: four bits of each minimum, so equal minima have equal bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = (np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, MINIMA) & 15).astype(np.uint8)
                packed = low[:, ::2] << 4 | low[:, 1::2]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["id", "sketch"])

    return reps.join(ids, "id", "left_semi").select("id", "sig").mapInArrow(trimmed(run), "id long, sketch binary")


def _ties(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``(id, component, n, first)`` for rows of ``groups(key, id, component, n)``, which are of bounded size, that may reach
    the similarity with a row of another component in their group: a spanning forest of these pairs."""
    least = least_agreement(percent, 4)

    def tied(rows: list) -> list[tuple[int, int, int, int]]:
        ids, components, n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        packed = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), MINIMA // 2)
        bits = np.concatenate([packed >> 4, packed & 15], axis=1)
        above = np.arange(len(rows))

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        out = []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            j = j[(components[j] != components[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            for k in j[(bits[j] == bits[i]).sum(axis=1) >= least].tolist():
                a, b = root(i), root(k)
                if a != b:
                    above[max(a, b)] = min(a, b)
                    out += [(int(ids[x]), int(components[x]), int(n[x]), int(ids[i])) for x in (i, k)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def told() -> Iterator[pa.RecordBatch]:
            if found := tied(rows) if len({r[1] for r in rows}) > 1 else None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["id", "component", "n", "first"])

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    yield from told()
                    key, rows = own, []
                rows.append(row)
        yield from told()

    spark = groups.sparkSession
    together = groups.join(sketches, "id").select("key", "id", "component", "n", "sketch").repartition(parallelism(spark), "key").sortWithinPartitions("key")
    return together.mapInArrow(trimmed(run), "id long, component long, n long, first long").distinct()


def _shingle_counts(texts: DataFrame, n: int, words: int) -> np.ndarray:
    """How often shingles occur in about ``_COUNTED`` of ``n`` texts, by the low 20 bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(words), zstandard.ZstdDecompressor()
        counts = np.zeros(1 << 20, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                np.add.at(counts, (shingles.sets([open_.decompress(data)])[0] & np.uint64((1 << 20) - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype(np.uint32).tobytes()], pa.binary())], names=["counts"])

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // _COUNTED))) == 0).select("data").coalesce(4)
    total = np.zeros(1 << 20, np.uint32)
    for row in some.mapInArrow(trimmed(run), "counts binary").collect():  # four rows of 4 MB
        total += np.frombuffer(row["counts"], np.uint32)
    return total


def _prefix_pairs(dense: DataFrame, texts: DataFrame, n: int, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``dense(id, component)`` the rows that share a shingle of their prefixes: as pairs ``(a, b)`` across components where
    few do, and else as ``(key, id, component, n, first, size)``, with the first of a long list.

    In whatever order shingles are taken, sets of n shingles that reach the similarity share one of the first
    n - ceil(n * percent / 100) + 1.
    """
    own = texts.join(dense, "id").select("id", "component", "data")
    sent = dense.sparkSession.sparkContext.broadcast(_shingle_counts(own, n, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(words), zstandard.ZstdDecompressor()
        for batch in batches:
            ids, components = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            heads, sizes = [], []
            for data in batch.column(2).to_pylist():
                x = shingles.sets([open_.decompress(data)])[0]
                by = np.lexsort((x, sent.value[(x & np.uint64((1 << 20) - 1)).astype(np.int64)]))
                heads.append(x[by[: len(x) + (-len(x) * percent) // 100 + 1]])
                sizes.append(len(x))
            lengths = [len(h) for h in heads]
            if sum(lengths):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(heads).view(np.int64)), *(pa.array(np.repeat(np.asarray(c, np.int64), lengths)) for c in (ids, components, sizes))], names=["shingle", "id", "component", "n"]
                )

    postings = stage_table(own.mapInArrow(trimmed(run), "shingle long, id long, component long, n long"))
    lists = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("first")).where("low <> high")
    lists = stage_table(lists.select("shingle", "size", "first"))
    few = stage_table(postings.join(lists.where(F.col("size") <= _SHORT).select("shingle"), "shingle"))
    left, right = (few.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n")]) for side in ("a", "b"))
    near = left.join(right, "shingle").where(F.expr(f"component_a <> component_b AND id_a < id_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    pairs = near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    long = postings.join(lists.where(F.col("size") > _SHORT).select("shingle", "first", "size"), "shingle").select(F.col("shingle").alias("key"), "id", "component", "n", "first", "size")
    return pairs, long


def _family_links(tied: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Families ``(id, family)`` of rows that ``tied(id, component, n, first)`` ties together, and links ``(a, b)`` inside them,
    enough to unite what all their links unite.

    A family is dealt into blocks, large components into blocks of their own; every two blocks that hold different
    components meet in a task, which compares all their rows and sends out a spanning forest of the links it finds.
    """
    spark = tied.sparkSession
    families = stage_table(connected_components(tied.select(F.col("id").alias("a"), F.col("first").alias("b"))), narrow=True)
    rows = tied.select("id", "component", "n").distinct().join(families.withColumnRenamed("component", "family"), "id", "left").withColumn("family", F.coalesce("family", "id"))
    rows = stage_table(rows, narrow=True)
    most = lambda n, total: F.greatest(F.ceil(F.col(n) / _BLOCK_ROWS), F.ceil(F.col(total) / _BLOCK_SHINGLES))
    owned = rows.groupBy("family", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).withColumn("parts", most("k", "total"))
    pool = owned.where("parts = 1").groupBy("family").agg(F.sum("k").alias("k"), F.sum("total").alias("total")).select("family", most("k", "total").alias("pool"))
    placed = rows.join(owned.select("family", "component", "parts"), ["family", "component"]).join(pool, "family", "left")
    large = F.col("parts") > 1
    placed = placed.select(
        "family",
        F.when(large, F.xxhash64("component", F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(F.xxhash64(F.lit("pool"), "family", F.pmod(F.xxhash64("component"), F.col("pool")))).alias("block"),
        F.when(large, F.col("component")).alias("tag"),
        "id",
        "component",
    )
    placed = stage_table(placed, narrow=True)
    blocks = stage_table(placed.select("family", "block", "tag").distinct(), narrow=True)
    x, y = blocks.select("family", F.col("block").alias("x"), F.col("tag").alias("tx")), blocks.select("family", F.col("block").alias("y"), F.col("tag").alias("ty"))
    meetings = x.join(y, "family").where("x <= y AND NOT coalesce(tx = ty, false)").select("x", "y")
    packed = placed.select("block", "id", "component").join(texts, "id").select("block", "id", "component", "data").repartition(parallelism(spark), "block").sortWithinPartitions("block")
    packed = stage_table(packed.mapInArrow(trimmed(_pack_blocks), "block long, rows binary"), dealt=True)
    met = meetings.join(packed.withColumnRenamed("block", "x").withColumnRenamed("rows", "left"), "x").join(packed.withColumnRenamed("block", "y").withColumnRenamed("rows", "right"), "y")
    links = stage_table(met.select("x", "y", "left", "right").mapInArrow(trimmed(_compare_blocks(words, percent)), "a long, b long").distinct(), narrow=True)
    return rows.select("id", "family"), links


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: ids, components and texts, compressed together as they are much alike."""
    squeeze, open_ = zstandard.ZstdCompressor(3), zstandard.ZstdDecompressor()
    at, held = None, []

    def packed() -> pa.RecordBatch:
        ids, components, texts = zip(*held, strict=True)
        body = np.array([len(held)], np.int64).tobytes() + np.array([ids, components, [len(t) for t in texts]], np.int64).tobytes() + b"".join(texts)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([squeeze.compress(body)], pa.binary())], names=["block", "rows"])

    for batch in batches:
        for block, i, component, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if held and block != at:
                yield packed()
                held.clear()
            at = block
            held.append((i, component, open_.decompress(data)))
    if held:
        yield packed()


def _compare_blocks(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, open_ = Shingles(words), zstandard.ZstdDecompressor()

        def read(data: bytes):
            body = open_.decompress(data)
            n = int(np.frombuffer(body, np.int64, 1)[0])
            ids, components, lengths = np.frombuffer(body, np.int64, 3 * n, 8).reshape(3, n)
            ends = 8 + 24 * n + np.cumsum(lengths)
            x, cuts = shingles.sets([body[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)])
            return ids, components, x, np.diff(cuts)

        last, kept = None, None
        for batch in batches:
            for x, y, left, right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if x != last:
                    last, kept = x, read(left)
                a = kept
                b = a if x == y else read(right)
                both = common_counts(a[2], a[3], b[2], b[3])
                linked = 100 * both >= percent * (a[3][:, None] + b[3][None, :] - both)
                linked &= a[1][:, None] != b[1][None, :]
                found = _forest(a, b, *np.nonzero(np.triu(linked, 1) if x == y else linked))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def common_counts(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``x`` with every set of ``y``; sets of sizes ``nx``, ``ny`` follow one another."""
    values, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    ax, ay = at[: len(x)], at[len(x) :]
    rx, ry = np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)
    cx, cy = np.bincount(ax, minlength=len(values)), np.bincount(ay, minlength=len(values))
    often = (cx * 16 > len(nx)) & (cy * 16 > len(ny))
    columns = np.cumsum(often) - 1
    left, right = np.zeros((len(nx), int(often.sum())), np.float32), np.zeros((len(ny), int(often.sum())), np.float32)
    left[rx[often[ax]], columns[ax[often[ax]]]] = 1
    right[ry[often[ay]], columns[ay[often[ay]]]] = 1
    out = np.rint(left @ right.T).astype(np.int32)
    # The other shingles: rows of x meet the list of rows of y.
    by = np.argsort(ay, kind="stable")
    lists, start = ry[by], np.searchsorted(ay[by], np.arange(len(values) + 1))
    rest = np.flatnonzero(~often[ax] & (cy[ax] > 0))
    flat = out.reshape(-1)
    for low in range(0, len(rest), 50_000):
        some = rest[low : low + 50_000]
        count = cy[ax[some]]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[ax[some]], count)
        cells, add = np.unique(np.repeat(rx[some], count) * len(ny) + lists[place], return_counts=True)
        flat[cells] += add.astype(np.int32)
    return out


def _forest(a, b, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between rows ``i`` of ``a`` and ``j`` of ``b``, those that join components not joined before."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    out = []
    for ida, idb, ca, cb in zip(a[0][i].tolist(), b[0][j].tolist(), a[1][i].tolist(), b[1][j].tolist(), strict=True):
        ca, cb = root(ca), root(cb)
        if ca != cb:
            above[max(ca, cb)] = min(ca, cb)
            out.append((ida, idb))
    return out


def _region_pairs(reps: DataFrame, documents: DataFrame, components: DataFrame, words: int, percent: int, filter_bytes: int) -> tuple[DataFrame | None, DataFrame | None]:
    """For every pair across components whose rows share a region that the neighbours don't cover: a candidate, or links
    that unite what it would; None where there is none."""
    rows, mixed = _regions(reps, components)
    if mixed.isEmpty():
        return None, None
    rows = stage_table(rows.join(mixed, "region"), dealt=True)
    members = stage_table(rows.select("id").distinct(), narrow=True)
    texts = _texts_of(documents, members, members.count(), filter_bytes)
    sketches, pairs = stage_table(_sketches(reps, members), narrow=True), None
    tied = _ties(rows.where(F.col("size") <= DIRECT).select(F.col("region").alias("key"), "id", "component", "n"), sketches, percent)
    dense = stage_table(rows.where(F.col("size") > DIRECT).select("id", "component").distinct(), narrow=True)
    if n := dense.count():
        pairs, long = _prefix_pairs(dense, texts, n, words, percent)
        listed = _ties(long.where(F.col("size") <= LISTED).select("key", "id", "component", "n"), sketches, percent)
        tied = tied.unionByName(listed).unionByName(long.where(F.col("size") > LISTED).select("id", "component", "n", "first")).distinct()
    families, links = _family_links(stage_table(tied, dealt=True), texts, words, percent)
    if pairs is not None:  # all pairs inside families are done
        own = lambda c: families.select(F.col("id").alias(c), F.col("family").alias(f"f{c}"))
        pairs = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where("NOT coalesce(fa = fb, false)").select("a", "b")
    return pairs, links


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links, which join whole components: those are united, then renamed."""
    between = _crossing(links, components).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    renamed = connected_components(between)
    old = components.join(renamed.select(F.col("id").alias("component"), F.col("component").alias("new")), "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    return stage_table(old.unionByName(renamed), narrow=True)


def _united(edges: DataFrame, tried: DataFrame, components: DataFrame, held: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Components after all of ``edges(a, b, agree)`` that cross them were confirmed or refused, and the edges tried.

    Components only grow, so what doesn't cross them at first isn't looked at again.
    """
    edges = stage_table(_crossing(edges.join(tried, ["a", "b"], "left_anti"), components), narrow=True)
    for last in (False, True):
        if last:
            crossing = _crossing(edges.select("a", "b").join(crossing, ["a", "b"], "left_anti"), components)
        else:
            crossing = edges.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("agree", "a", "b")).alias("p")).select("p.a", "p.b")
        crossing = stage_table(crossing.select("a", "b"), narrow=True)
        if crossing.isEmpty():
            break
        more = _confirmed(crossing, held, words, percent)
        tried = tried.unionByName(crossing)
        if not more.isEmpty():
            components = _joined(components, more)
    return components, tried


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` for each row of ``documents``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles, words
    being lower-cased in A-Z.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage_table(texts.mapInArrow(trimmed(_signatures(words)), "doc_id long, n_shingles long, d0 long, d1 long, sig binary"), dealt=True)
    with scratch() as keep:
        usable = signed.where("doc_id is not null and n_shingles > 0")
        classes = stage_table(usable.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), narrow=True)
        reps = stage_table(
            usable.join(classes.select("d0", "d1", F.col("rep").alias("doc_id")), ["d0", "d1", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "sig").dropDuplicates(["id", "n_shingles", "sig"]),
            dealt=True,
        )
        shared = keep(stage_table(classes.where("size > 1").select("d0", "d1", "rep"), narrow=True))
        components = keep(stage_table(_components_of(reps, texts, words, percent, filter_bytes), narrow=True))
    named = signed.select("doc_id", "n_shingles", "d0", "d1").join(shared, ["d0", "d1"], "left")
    # A text without shingles shares the digest of the empty set with others, but no class.
    named = named.withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = named.join(components.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components_of(reps: DataFrame, texts: DataFrame, words: int, percent: int, filter_bytes: int) -> DataFrame:
    """``(id, component)`` of the representatives ``reps(id, n_shingles, sig)`` that are not smallest in their component."""
    spark = reps.sparkSession
    edges = stage_table(_agreeing(_candidates(reps), reps, percent).groupBy("a", "b").agg(F.max("agree").alias("agree")), narrow=True)
    n_edges = edges.count()
    if not n_edges:
        return spark.createDataFrame([], "id long, component long")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = _texts_of(texts, ends, 2 * n_edges, filter_bytes)
    likely = F.col("agree") >= int(MINIMA * (0.5 + percent / 200))
    # Every document asks the partner of least hash among its likely ones, else the one that agrees most: in a dense
    # region all ask the same few.
    directed = edges.select("a", "b", "agree").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    ask = F.when(likely, F.struct(F.lit(0).alias("x"), F.xxhash64("b").alias("y"), F.col("b"))).otherwise(F.struct((F.lit(1) + MINIMA - F.col("agree")).alias("x"), F.xxhash64("b").alias("y"), F.col("b")))
    asked = stage_table(directed.groupBy("a").agg(F.min(ask).alias("p")).select("a", F.col("p.b").alias("b")), narrow=True)
    links = _confirmed(asked, held, words, percent)
    tried = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    components = stage_table(connected_components(links), narrow=True)
    components, tried = _united(edges, tried, components, held, words, percent)
    release(held)
    pairs, links = _region_pairs(reps, texts, components, words, percent, filter_bytes)
    if links is not None and not links.isEmpty():
        components = _joined(components, links)
    if pairs is None:
        return components
    edges = stage_table(_agreeing(pairs.join(tried, ["a", "b"], "left_anti"), reps, percent).groupBy("a", "b").agg(F.max("agree").alias("agree")), narrow=True)
    if n_edges := edges.count():
        held = _texts_of(texts, edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * n_edges, filter_bytes)
        components, _ = _united(edges, tried, components, held, words, percent)
    return components
