"""A stored index of nodes by their names: trigrams for texts inside names, sorted ranges for prefixes.

Nodes are stored in ranges of their qualified names, sorted. Postings (trigram, id, range)
of names and qualified names in lower case are stored by a hash bucket of the trigram, and
counted; they are dealt out in ranges, so a gram of many nodes is many tasks'. A search reads the counts of its own trigrams, the postings of the rarest few, and
of the nodes only those ranges that have a candidate; every candidate is then compared
with the whole text, so the index decides what is read, not what is found. A prefix reads
the files and row groups whose range can hold it. Texts below three characters have no
trigram and are looked up by a scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.graph import SourceGraph

#: Characters of a gram, hash buckets of postings, and grams of a search that are read.
GRAM, BUCKETS, READ = 3, 64, 3
#: Nodes and postings that a task sorts, about.
NODE_ROWS, POSTING_ROWS = 1 << 18, 1 << 20
POSTINGS, COUNTS = "id long, part int, gram string, bucket int", "gram string, n long, bucket int"


def grams_of(text: Column) -> Column:
    """The distinct grams of a text in lower case; none below a gram's length."""
    low = F.lower(text)
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, GRAM))
    return F.when(F.length(low) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build(g: SourceGraph, path: str, ranges: int | None = None) -> None:
    """Store the index of a graph's nodes at ``path``, where nothing may be stored yet; by default with a range for each core, and more where nodes are many.

    Ranges and postings are dealt by their number, so what a task sorts doesn't grow with the graph.
    """
    spark = g.nodes.sparkSession
    cores = spark.sparkContext.defaultParallelism
    ranges = ranges or max(cores, -(-g.nodes.count() // NODE_ROWS))
    placed = g.nodes.repartitionByRange(ranges, "qualified_name", "id").withColumn("part", F.spark_partition_id())
    placed.sortWithinPartitions("part", "qualified_name", "id").write.partitionBy("part").parquet(f"{path}/nodes")
    spark.createDataFrame([(placed.schema.json(),)], "value string").coalesce(1).write.text(f"{path}/schema")
    nodes = stored_nodes(spark, path)
    listed = nodes.select("id", "part", F.explode(F.array_union(grams_of(F.col("name")), grams_of(F.col("qualified_name")))).alias("gram")).withColumn("bucket", bucket_of(F.col("gram")))
    gaps = F.greatest(F.length("name") - (GRAM - 1), F.lit(0)) + F.greatest(F.length("qualified_name") - (GRAM - 1), F.lit(0))
    most = nodes.agg(F.sum(gaps)).first()[0] or 0
    listed.repartitionByRange(max(cores, -(-most // POSTING_ROWS)), "bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/nodes")


def rarest(spark: SparkSession, path: str, query: str) -> list[tuple[str, int]] | None:
    """The rarest grams of a text with their buckets, READ at most; None if one of its grams is nowhere."""
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(grams_of(F.col("q"))).alias("gram")).withColumn("bucket", bucket_of(F.col("gram"))).collect()
    wanted, buckets = [r["gram"] for r in asked], sorted({r["bucket"] for r in asked})
    known = spark.read.schema(COUNTS).parquet(f"{path}/counts").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted)).collect()
    if len(known) < len(wanted):
        return None
    return [(r["gram"], r["bucket"]) for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:READ]]


def candidates(spark: SparkSession, path: str, grams: list[tuple[str, int]]) -> DataFrame:
    """(id, part) of the nodes that have all of the grams."""
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings").filter(F.col("bucket").isin(sorted({b for _, b in grams})) & F.col("gram").isin([t for t, _ in grams]))
    return postings.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("id", "part")


def search_nodes(spark: SparkSession, path: str, query: str, exclude_tests: bool = False) -> DataFrame:
    """Nodes whose name or qualified name has the text, in any case: what a scan finds."""
    nodes = stored_nodes(spark, path)
    has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    if len(query.lower()) >= GRAM:
        grams = rarest(spark, path, query.lower())
        met = candidates(spark, path, grams) if grams else None
        parts = [r["part"] for r in met.select("part").distinct().collect()] if met is not None else []
        nodes = nodes.filter(F.col("part").isin(parts)) if parts else nodes.limit(0)
        if met is not None:
            nodes = nodes.join(met.select("id"), "id", "left_semi")
    found = nodes.filter(has(F.col("name")) | has(F.col("qualified_name"))).drop("part")
    return found.filter(~F.col("is_test")) if exclude_tests else found


def nodes_in_package(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Nodes whose qualified name starts with the text; the filter reaches the sorted files' statistics."""
    return stored_nodes(spark, path).filter(F.col("qualified_name").startswith(prefix)).drop("part")
