"""Cutting lineage through tables in the folder all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only when that setting is absent from a local
session (tests, local runs) a temporary folder is made and set as the session's checkpoint folder; a session on a cluster
must name a folder.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Path of each staged table, with its session and the thread that staged it.
_STAGED: dict[str, tuple[SparkSession, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="canopy-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def stage_table(df: DataFrame, narrow: bool = False, dealt: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of what was written.

    ``narrow`` is for tables of ids or groups, some hundredth of the input: an eighth of the usual tasks makes them and a
    fourth of these writes them, so that they don't become many tiny files.  ``dealt`` is for tables up to a tenth of the
    input that take work: all tasks make them, and an eighth as many write them.

    The result does not depend on any executor's local disk, so it survives lost executors, and its lineage is one scan.
    Staged tables are removed by :func:`scratch` or :func:`release`, at the latest when the driver's Python exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/canopy-{uuid.uuid4().hex}"
    makers, writers = max(1, parallelism(spark) // 8), max(1, parallelism(spark) // 32)
    made = df.coalesce(makers) if narrow else df.repartition(makers) if dealt else df
    (made.repartition(writers) if narrow and writers < makers else made).write.parquet(path)
    _STAGED[path] = (spark, threading.get_ident())
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_staged_path"] = path
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Have shuffle files removed that no table needs any more.

    Spark removes them when the driver collects the plans they belong to, which one with much free memory puts off for long;
    so it is asked to after large tables were written.
    """
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged in the block by this thread are deleted at its end, except those given to the function it yields.

    What leaves the block must read none of the others.
    """
    before, kept = set(_STAGED), set()

    def keep(staged: DataFrame) -> DataFrame:
        kept.add(staged.__dict__["_staged_path"])
        return staged

    try:
        yield keep
    finally:
        mine = threading.get_ident()
        _delete([p for p, (_, thread) in _STAGED.items() if thread == mine and p not in before and p not in kept])


def release(*staged: DataFrame) -> None:
    """Delete tables that :func:`stage_table` returned and that nothing reads any more."""
    _delete([p for p in (x.__dict__.get("_staged_path") for x in staged) if p in _STAGED])


def release_staged() -> None:
    """Delete every table staged so far."""
    _delete(list(_STAGED))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _delete(paths: list[str]) -> None:
    for path in paths:
        spark, _ = _STAGED.pop(path)
        try:
            delete_path(spark, path)
        except Exception:  # the JVM is gone at exit: nothing can be deleted any more
            return


atexit.register(release_staged)


def parallelism(spark: SparkSession) -> int:
    """Partitions a shuffle of the session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
