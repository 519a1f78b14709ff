"""A code graph as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.schema import EDGES, NODES

#: Rows that a task of a join sorts, about, where the session's partitions would hold more.
JOIN_ROWS = 1 << 18


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows in so many partitions by key; as they are without a number."""
    return rows if tasks is None else rows.repartition(tasks, *keys)


@dataclass(frozen=True)
class SourceGraph:
    """``nodes`` and ``edges`` as in ``codeloom.schema``; columns that a query doesn't use may be missing."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of_rows(spark: SparkSession, nodes: Iterable[dict[str, Any]], edges: Iterable[dict[str, Any]]) -> SourceGraph:
        return SourceGraph(spark.createDataFrame([tuple(n[f] for f in NODES.names) for n in nodes], NODES), spark.createDataFrame([tuple(e[f] for f in EDGES.names) for e in edges], EDGES))

    def adj(self, *kinds: str) -> DataFrame:
        """(src, dst, edge_id) of resolved edges of the given kinds, or of all; parallel edges stay."""
        edges = self.edges.filter(F.col("to_state") == "Resolved")
        if kinds:
            edges = edges.filter(F.col("kind").isin(*kinds))
        return edges.select("src", F.col("to_id").alias("dst"), F.col("id").alias("edge_id"))

    def tasks(self, *kinds: str) -> int | None:
        """Tasks for joins of all nodes with edges of these kinds, by their number; None where the session's partitions suffice."""
        rows = self.nodes.count() + self.adj(*kinds).count()
        tasks = -(-rows // JOIN_ROWS)
        return tasks if tasks > int(self.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None

    def name_index(self) -> DataFrame:
        """(qualified_name, id): of nodes that share a name, the one of highest id."""
        return self.nodes.groupBy("qualified_name").agg(F.max("id").alias("id"))

    def parents(self) -> DataFrame:
        """(id, parent): the source of the last Contains edge into each node."""
        return self.adj("Contains").groupBy(F.col("dst").alias("id")).agg(F.max_by("src", "edge_id").alias("parent"))

    def describe(self, ids: DataFrame, on: str = "id") -> DataFrame:
        """Kind and qualified name of the nodes that a result names."""
        return ids.join(self.nodes.select(F.col("id").alias(on), "kind", "name", "qualified_name"), on)

    def validate(self) -> DataFrame:
        """Edges that break the invariants: a source or resolved target without a node, or a target in the wrong column."""
        ids = self.nodes.select("id")
        is_resolved = F.col("to_state") == "Resolved"
        shape = self.edges.filter(F.when(is_resolved, F.col("to_id").isNull() | F.col("to_name").isNotNull()).otherwise(F.col("to_id").isNotNull() | F.col("to_name").isNull()))
        no_source = self.edges.join(ids, F.col("src") == ids["id"], "left_anti")
        no_target = self.edges.filter(is_resolved).join(ids, F.col("to_id") == ids["id"], "left_anti")
        return shape.select("id", F.lit("target").alias("problem")).unionByName(no_source.select("id", F.lit("source").alias("problem"))).unionByName(no_target.select("id", F.lit("dangling").alias("problem")))

    def views(self, prefix: str = "") -> None:
        """Name both tables for Spark SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
