"""Connected components of an undirected graph, by alternating star contractions.

Each round links every node's larger neighbours to the smallest node it knows
(large star), then its smaller neighbours likewise (small star). The edges end as
stars around the least node of each component. A node of any degree is aggregated
before its shuffle, and its edges are spread by the skew-aware join. A round is dealt
by the number of its edges: few edges need few tasks and files, whatever number of
partitions the session has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.scratch import checkpoint, scoped

#: Edges of a round that a task takes, about, where the session's partitions hold fewer.
EDGE_ROWS = 1 << 16


@scoped
def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); the root is the least node that it reaches.

    Self-loops and repeated edges change nothing, but a node that has only
    self-loops isn't in the result. Edges with a null end are no edges.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    stars = checkpoint(edges.dropna(subset=["a", "b"]).filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = state(stars)
    for _ in range(max_rounds):
        tasks = max(cores, -(-before[0] // EDGE_ROWS))
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).coalesce(tasks).distinct()
        large = checkpoint(large.coalesce(tasks))
        lower = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(lower, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = checkpoint(pairs.unionByName(lower.select("hi", F.col("m").alias("lo"))).coalesce(tasks).distinct().coalesce(tasks))
        now = state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components have not settled within {max_rounds} rounds")
    nodes = stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct().coalesce(tasks))


def state(edges: DataFrame) -> tuple:
    """The number of the edges and the sum of their hashes, which a round that changes nothing leaves as they are."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
