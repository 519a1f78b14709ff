"""Keeping the state of a source tree up to date from a stream of files.

A file stream can't see deletions: each micro-batch inserts or updates the files that it
brings, and ``deleted`` compares the state with a full listing now and then. The state
is a Parquet table for each micro-batch, of which the latest row of a path counts, so a
batch that is run again writes the same rows to the same place. Every so many batches
the state is written as one table, and the batches that it holds are deleted.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.sources.scratch import delete

STATE = "path string, hash string, status string"


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def compacted_upto(spark: SparkSession, folder: str) -> int:
    """The last batch that the compacted state holds, or -1."""
    last = rows_of(spark, f"{folder}/compacted", "upto long").agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(path, hash): the latest of each path, of batches before the given one."""
    upto = compacted_upto(spark, folder)
    base = rows_of(spark, f"{folder}/compacted", "path string, hash string, upto long").filter(F.col("upto") == upto).select("path", "hash", F.col("upto").alias("batch"))
    rows = rows_of(spark, f"{folder}/batches", f"{STATE}, batch long").filter(F.col("batch") > upto).select("path", "hash", "batch")
    rows = base.unionByName(rows)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"))


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the state of the batches up to one as a table, then delete what it replaces."""
    old = compacted_upto(spark, folder)
    if upto <= old:
        return
    held = [r["batch"] for r in rows_of(spark, f"{folder}/batches", f"{STATE}, batch long").select("batch").distinct().filter(F.col("batch") <= upto).collect()]
    state(spark, folder, upto + 1).coalesce(max(1, spark.sparkContext.defaultParallelism)).write.mode("overwrite").parquet(f"{folder}/compacted/upto={upto}")
    for path in [f"batches/batch={i}" for i in held] + ([f"compacted/upto={old}"] if old >= 0 else []):
        delete(spark, f"{folder}/{path}")


def upsert(batch: DataFrame, batch_id: int, folder: str, every: int = 100) -> None:
    """Write what is new or changed against the state before this batch; each ``every``-th batch compacts those before it."""
    spark = batch.sparkSession
    if batch_id and batch_id % every == 0:
        compact(spark, folder, batch_id - 1)
    before = state(spark, folder, batch_id)
    new = batch.groupBy("path").agg(F.max_by("content", "modified").alias("content")).select("path", F.sha2("content", 256).alias("hash"))
    old = before.withColumnRenamed("hash", "old")
    changed = new.join(old, "path", "left").withColumn("status", F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("hash"), "changed")).filter("status is not null")
    changed.select("path", "hash", "status").write.mode("overwrite").parquet(f"{folder}/batches/batch={batch_id}")


def watch(spark: SparkSession, source: str, folder: str, checkpoints: str, every: int = 100) -> StreamingQuery:
    """Follow Parquet files of (path, content, modified) that appear in ``source``; ends when all that is there is done."""
    schema = "path string, content string, modified timestamp"
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, i: upsert(df, i, folder, every)).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()


def deleted(spark: SparkSession, folder: str, listing: DataFrame) -> DataFrame:
    """Paths of the state that a full listing (path) lacks."""
    return state(spark, folder).join(listing.select("path"), "path", "left_anti").select("path")
