"""Documents to packed training sequences: quality rules, near-dedup, substring dedup, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row of ``docs``; all but the last return the columns of
``docs``.  ``run`` writes what a stage kept as a Parquet table in the shared folder and hands the next one a scan of it.

Columns that ``docs`` has besides ``doc_id, text, lang, source, n_chars`` pass through, whatever their names.  Null texts
fail the quality rules; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import near_dedup, packing, quality_rules, secrets, substring
from canopy.plans.materialize import release, scratch, stage_table

ORACLE_SQL = None

_OWN = "__doc_"


def _shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """The columns an operator works on, and all columns of ``docs`` under names that clash with none of its own."""
    return docs.select(*used, *[F.col(f"`{c}`").alias(_OWN + c) for c in docs.columns if c != "text"]), [_OWN + c for c in docs.columns if c != "text"]


def _restored(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with the text an operator returned and its number of characters."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[(new[c] if new.get(c) is not None else F.col(f"`{_OWN}{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the robust outlier test keep."""
    names = {c: c if c in ("text", "lang", "source") else _OWN + c for c in docs.columns}
    kept = quality_rules.kept_rows(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), list(names.values()))
    return kept.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


_KEY = "__key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key: the id; but of rows that repeat an id with other texts, all but one text have a key of their own,
    above 2**62.  Of rows that repeat both id and text one stays.  Null ids stay as they are."""
    plain = docs.withColumn(_KEY, F.col("doc_id").cast("long"))
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    repeated = stage_table(ids, narrow=True)
    if not (n := repeated.count()):
        return plain
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    sure, maybe = near_dedup.split_by_id(plain, _KEY, repeated, n)
    least = stage_table(maybe.select(_KEY, digest.alias("__digest")).join(repeated.withColumnRenamed("doc_id", _KEY), _KEY).groupBy(_KEY).agg(F.min("__digest").alias("__least")), narrow=True)
    other = F.xxhash64(F.col(_KEY), digest).bitwiseAND((1 << 62) - 1) + (1 << 62)
    named = maybe.join(least, _KEY, "left").withColumn("__new", F.when(F.col("__least").isNull() | (digest == F.col("__least")), F.col(_KEY)).otherwise(other))
    once = named.where("__least IS NOT NULL").dropDuplicates(["__new"]).unionByName(named.where("__least IS NULL"))
    return sure.unionByName(once.select(*docs.columns, F.col("__new").alias(_KEY)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on 5-word shingles: that of the smallest id.

    Rows that repeat an id with different texts are judged each by its own text.  Texts of what stays aren't shuffled.
    """
    keyed = _keyed(docs)
    with scratch() as keep:
        verdicts = near_dedup.near_duplicates(keyed.select(F.col(_KEY).alias("doc_id"), "text"), words=5, percent=80)
        dropped = keep(stage_table(verdicts.where("NOT kept").select(F.col("doc_id").alias(_KEY)).distinct(), narrow=True))
    sure, maybe = near_dedup.split_by_id(keyed, _KEY, dropped, dropped.count())
    return sure.unionByName(maybe.join(dropped, _KEY, "left_anti").select(sure.columns)).select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of a smaller id has too."""
    rows, keep = _shielded(docs, "doc_id", "text")
    return _restored(substring.remove_repeats(rows, keep=keep, with_text=True), docs, "kept_text")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets redacted."""
    rows, keep = _shielded(docs, "doc_id", "text")
    return _restored(secrets.scan(rows, keep=keep, with_text=True), docs, "redacted")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("secret_scans", secret_scans), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            following = keep(stage_table(stage(spark, docs, sf_dir)))
        release(docs)
        docs = following
    return STAGES[-1][1](spark, docs, sf_dir)
