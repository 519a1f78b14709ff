"""What nodes reach: calls, types, imports, impact. Each takes many roots (column root) and gives (root, id, depth)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.operators.closure import chains, closure, nearest_ancestors, shortest_paths
from codeloom.operators.neighbours import methods_throwing
from codeloom.schema import IMPACT_KINDS


def reversed_adj(g: SourceGraph, *kinds: str) -> DataFrame:
    return g.adj(*kinds).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id")


def downstream_calls(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return closure(g.adj("Calls"), roots, depth)


def upstream_callers(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return closure(reversed_adj(g, "Calls"), roots, depth)


def call_path(g: SourceGraph, pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, path) of pairs that calls connect."""
    return shortest_paths(g.adj("Calls"), pairs)


def all_subclasses(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return closure(reversed_adj(g, "Extends"), roots, depth)


def interface_hierarchy(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return all_subclasses(g, roots, depth)


def superclass_chain(g: SourceGraph, roots: DataFrame, kind: str = "Extends") -> DataFrame:
    """(root, position, id): each node's first Extends target, and on from there."""
    step = g.adj(kind).groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "edge_id").alias("next"))
    return chains(step, roots)


def import_closure(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return closure(g.adj("Imports"), roots, depth)


def async_call_chain(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    return closure(g.adj("Awaits"), roots, depth)


def reachable_from(g: SourceGraph, ids: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth) of what any of the ids reaches by Calls or Instantiates, the ids with it."""
    seeds = ids.select(F.lit(0).alias("root"), "id")
    return closure(g.adj("Calls", "Instantiates"), seeds, depth, include_seeds=True).select("id", "depth")


def dead_code(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """Nodes of any kind that none of the ids reaches."""
    return g.nodes.join(reachable_from(g, ids), "id", "left_anti")


def change_impact(g: SourceGraph, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """What uses a node, over eight kinds of edges backwards."""
    return closure(reversed_adj(g, *IMPACT_KINDS), roots, depth)


def exception_propagation(g: SourceGraph, exception: str) -> DataFrame:
    """Methods that throw it, and all their callers."""
    seeds = methods_throwing(g, exception).select(F.lit(0).alias("root"), "id")
    return closure(reversed_adj(g, "Calls"), seeds, include_seeds=True).select("id", "depth")


def package_of(g: SourceGraph) -> DataFrame:
    """(id, package_id) of nodes that are or lie in a Package; the others have no row."""
    return nearest_ancestors(g.nodes.select("id", "kind"), g.parents(), "kind = 'Package'").withColumnRenamed("ancestor", "package_id")
