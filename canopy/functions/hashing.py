"""Fingerprints of graphs and requests."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    """URL-safe base64 of the first 12 bytes of a SHA-256."""
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(text, 256), 1, 24))), "+/=", "-_")


def combine_hashes(*parts: Column) -> Column:
    return short_hash(F.concat_ws(":", *parts))


def query_hash(parameters: dict) -> str:
    """Hash of a request: nulls dropped, keys sorted, the order of lists kept."""
    text = json.dumps({k: v for k, v in sorted(parameters.items()) if v is not None}, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    return base64.urlsafe_b64encode(hashlib.sha256(text.encode()).digest()[:12]).decode().rstrip("=")


def row_sum(*columns: str) -> Column:
    """Aggregate: the sum of 48 bits of each row's MD5, the same in any order of rows; equal rows don't cancel out."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).cast("binary")), 1, 12), 16, 10)
    return F.coalesce(F.sum(bits.cast("decimal(20,0)")), F.lit(0)).cast("string")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(nodes, edges, data_hash)`` that does not depend on the order of rows."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), row_sum("id", "kind").alias("a"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), row_sum("from_id", "to_id", "weight").alias("b"))
    return n.crossJoin(e).select("nodes", "edges", short_hash(F.concat_ws(":", "nodes", "edges", "a", "b")).alias("data_hash"))
