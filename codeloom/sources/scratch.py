"""Intermediate results in the folder that all executors share.

Lineage is cut by a written table or a reliable checkpoint, so a lost executor
costs the tasks it ran and nothing that other tasks had finished. The folder is
``spark.checkpoint.dir``; only where that is unset, as in local tests, a
temporary folder of this machine takes its place.

``scope`` deletes what a loop or job wrote, but for what it keeps.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: The folders written so far in each open scope.
OPEN: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder, which is also the context's checkpoint folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="codeloom-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there should be given to ``doom``."""
    return f"{scratch_dir(spark)}/codeloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def doom(spark: SparkSession, path: str) -> None:
    """Let a written path be deleted when the driver's JVM ends, or with the open scope."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if OPEN:
        OPEN[-1].append(path)


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    The files go when the driver's JVM ends, or before that with ``discard`` or at the end
    of a ``scope``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    doom(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def checkpoint(df: DataFrame) -> DataFrame:
    """A stored, eager copy for small frames inside loops; as ``materialise``, it is deleted with its scope."""
    return materialise(df, "round")


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table.scratch_path)


@contextmanager
def scope(spark: SparkSession, *keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Delete at the end what was written inside, but for the tables appended to the list it gives."""
    kept: list[DataFrame] = list(keep)
    OPEN.append([])
    try:
        yield kept
    finally:
        written = OPEN.pop()
        stay = {t.scratch_path for t in kept}
        for path in written:
            if path not in stay:
                delete(spark, path)
            elif OPEN:
                OPEN[-1].append(path)


def scoped(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of a first DataFrame whose stored rounds are deleted when it ends, all but its stored result."""
    @wraps(run)
    def stored(first: DataFrame, *args: object, **options: object) -> DataFrame:
        with scope(first.sparkSession) as kept:
            result = materialise(run(first, *args, **options), run.__name__)
            kept.append(result)
        return result

    return stored
