"""Contiguous shards of nearly equal bytes from global prefix sums (DataFrame functions only).

Rows are range-partitioned in a total order.  One row of totals per partition is enough to know where every partition
starts globally; inside a partition a running sum does the rest.  The row whose midpoint lies in the k-th of ``n_shards``
equal byte intervals goes to shard k, so shards are contiguous in the order and differ from the target by less than one
row at either end.

Defined results: a null size counts as ``null_size``; repeated rows and repeated ids are kept, each with its own slot,
in the order of the scan; nulls in the order columns come first; an empty table gives an empty result; columns of the
input pass through unless they have the name of a computed one (then the computed one replaces it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.plans.materialize import stage_table

_PART, _UID, _RUN, _ROW = "__part", "__uid", "__run", "__row"


def balanced_shards(rows: DataFrame, size: Column, order: Sequence[str], n_shards: int, null_size: int = 0, narrow: bool = False) -> DataFrame:
    """``rows`` with ``size``, ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 inside the shard).

    Two narrow shuffles: one by range of the order columns, one that brings each numbered range together.  What is
    broadcast is one row per range and one per shard, so it is bounded by the number of partitions.  ``narrow`` is for
    rows of ids and the like: the ranges stay as they are, but a few tasks write them (see :func:`stage_table`).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    keyed = rows.withColumn("size", F.coalesce(size.cast("long"), F.lit(null_size).cast("long"))).withColumn(_UID, F.monotonically_increasing_id())
    ranged = stage_table(keyed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order], F.col(_UID)).withColumn(_PART, F.spark_partition_id()), narrow=narrow)

    totals = ranged.groupBy(_PART).agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        _PART,
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__bytes").over(whole).alias("__all_bytes"),
    )

    inside = Window.partitionBy(_PART).orderBy(*[F.col(c).asc_nulls_first() for c in order], F.col(_UID))
    running = ranged.repartitionByRange(_PART).withColumn(_RUN, F.sum("size").over(inside)).withColumn(_ROW, F.row_number().over(inside))
    placed = running.join(F.broadcast(starts), _PART)
    twice_mid = 2 * (F.col("__bytes_before") + F.col(_RUN)) - F.col("size")
    shard = F.expr("least(:last, twice * :shards div (2 * greatest(all_bytes, 1)))".replace(":last", str(n_shards - 1)).replace(":shards", str(n_shards)).replace("all_bytes", "__all_bytes").replace("twice", "__twice"))
    placed = stage_table(
        placed.withColumn("__twice", twice_mid)
        .withColumn("shard", shard.cast("int"))
        .withColumn(_ROW, F.col("__rows_before") + F.col(_ROW) - 1)
        .drop("__twice", _RUN, _PART, _UID, "__bytes_before", "__rows_before", "__all_bytes"),
        narrow=narrow,
    )
    first = placed.groupBy("shard").agg(F.min(_ROW).alias("__first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col(_ROW) - F.col("__first")).drop(_ROW, "__first")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shards of ``documents`` in ``doc_id`` order; a document's size is its UTF-8 bytes plus 1, a null text has none.

    The text itself is dropped before the first shuffle: only id, size and checksum move.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select("doc_id", F.crc32(text.cast("binary")).alias("text_crc32"), (F.octet_length(text) + 1).cast("long").alias("size"))
    out = balanced_shards(slim, F.col("size"), ["doc_id"], n_shards, narrow=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
