"""One-hop neighbours, for many ids at once.

``ids`` has one column, id. Each result has a row for every edge (parallel edges
repeat): id is the node asked for, other its neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph, dealt
from codeloom.schema import FIELD_KINDS


def outgoing(g: SourceGraph, ids: DataFrame, *kinds: str) -> DataFrame:
    return g.adj(*kinds).select(F.col("src").alias("id"), F.col("dst").alias("other"), "edge_id").join(ids.select("id").distinct(), "id", "left_semi")


def incoming(g: SourceGraph, ids: DataFrame, *kinds: str) -> DataFrame:
    return g.adj(*kinds).select(F.col("dst").alias("id"), F.col("src").alias("other"), "edge_id").join(ids.select("id").distinct(), "id", "left_semi")


def direct_callees(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, "Calls")


def direct_callers(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Calls")


def implementors(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Implements")


def overriders(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Overrides")


def what_overrides(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """The target of each node's first Overrides edge."""
    return outgoing(g, ids, "Overrides").groupBy("id").agg(F.min_by("other", "edge_id").alias("other"))


def readers_of(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Reads")


def writers_of(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Writes")


def fields_read_by(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, "Reads")


def fields_written_by(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, "Writes")


def direct_imports(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, "Imports")


def direct_importers(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Imports")


def instantiators(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return incoming(g, ids, "Instantiates")


def types_instantiated_by(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, "Instantiates")


def closure_captures(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return outgoing(g, ids, "Captures")


def parent_of(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """The source of the last Contains edge into each node."""
    return g.parents().join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("parent").alias("other"))


def children(g: SourceGraph, ids: DataFrame, keep: Column, *kinds: str) -> DataFrame:
    """Targets of the given edge kinds (Contains, if none is given) that a condition on the target's columns keeps.

    Targets come first, as they leave few edges. Both joins are dealt by the number of nodes
    and edges, so that what a task sorts doesn't grow with the graph.
    """
    kinds = kinds or ("Contains",)
    tasks = g.tasks(*kinds)
    edges = g.adj(*kinds).select(F.col("src").alias("id"), F.col("dst").alias("other"), "edge_id")
    targets = g.nodes.filter(keep).select(F.col("id").alias("other"))
    found = dealt(edges, tasks, "other").join(dealt(targets, tasks, "other"), "other", "left_semi")
    wanted = dealt(ids.select("id"), tasks, "id").distinct()
    return dealt(found, tasks, "id").join(wanted, "id", "left_semi").select("id", "other", "edge_id")


def methods_of(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return children(g, ids, F.col("kind") == "Method")


def fields_of(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return children(g, ids, F.col("kind").isin(*FIELD_KINDS))


def parameters_of(g: SourceGraph, ids: DataFrame, compat: bool = False) -> DataFrame:
    """Parameters behind HasParameter or Contains; ``compat`` follows Contains alone, which extracted graphs lack."""
    return children(g, ids, F.col("kind") == "Parameter", *(("Contains",) if compat else ("HasParameter", "Contains")))


def public_api(g: SourceGraph, ids: DataFrame) -> DataFrame:
    return children(g, ids, F.col("visibility") == "Public")


def coupling_between(g: SourceGraph, pairs: DataFrame) -> DataFrame:
    """(a, b, edge_id, kind) of edges of any kind from either node of a pair to the other."""
    edges = g.edges.filter("to_state = 'Resolved'").select("src", "to_id", F.col("id").alias("edge_id"), "kind")
    wanted = pairs.select("a", "b").distinct()
    there = edges.join(wanted, (F.col("src") == F.col("a")) & (F.col("to_id") == F.col("b")))
    back = edges.join(wanted.filter("a <> b"), (F.col("src") == F.col("b")) & (F.col("to_id") == F.col("a")))
    return there.unionByName(back).select("a", "b", "edge_id", "kind")


def methods_throwing(g: SourceGraph, exception: str) -> DataFrame:
    """One row for each Throws edge: to a node of that name or qualified name, or to a text that is it or ends in it as a segment."""
    throws = g.edges.filter("kind = 'Throws'")
    named = g.nodes.filter((F.col("name") == exception) | (F.col("qualified_name") == exception)).select(F.col("id").alias("to_id"))
    resolved = throws.filter("to_state = 'Resolved'").join(named, "to_id", "left_semi")
    text = throws.filter("to_state <> 'Resolved'").filter((F.col("to_name") == exception) | F.col("to_name").endswith(f".{exception}") | F.col("to_name").endswith(f"::{exception}"))
    return resolved.select(F.col("src").alias("id"), F.col("id").alias("edge_id")).unionByName(text.select(F.col("src").alias("id"), F.col("id").alias("edge_id")))


def dependencies(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """(id, edge_id, kind, target) of all outgoing edges; names of targets without a node are marked."""
    edges = g.edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    names = g.nodes.select(F.col("id").alias("to_id"), "qualified_name")
    target = F.when(F.col("to_state") == "Resolved", F.coalesce("qualified_name", F.concat(F.lit("#"), "to_id"))).otherwise(F.concat(F.lower("to_state"), F.lit(":"), "to_name"))
    return edges.join(names, "to_id", "left").select(F.col("src").alias("id"), F.col("id").alias("edge_id"), "kind", target.alias("target"))


def dependents(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """(id, edge_id, kind, source) of all resolved incoming edges."""
    edges = g.edges.filter("to_state = 'Resolved'").join(ids.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    names = g.nodes.select(F.col("id").alias("src"), "qualified_name")
    return edges.join(names, "src").select(F.col("to_id").alias("id"), F.col("id").alias("edge_id"), "kind", F.col("qualified_name").alias("source"))
