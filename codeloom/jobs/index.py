"""Keeping a stored graph up to date with a source tree: one job from files to graph."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.jobs.extract import extract
from codeloom.jobs.ingest import EXTENSIONS, commit_descriptions, description_tasks, hash_diff, mark_tests, remove_files, resolve, walk
from codeloom.sources.graph_store import read_graph, write_changes, write_graph
from codeloom.sources.scratch import materialise


#: From files (path, content, ext, hash) and a first id to their graph, a File node for each.
Extractor = Callable[[DataFrame, int], SourceGraph]


class Indexed(NamedTuple):
    """The graph as it is now, what became of each file (path, status), and what is to be described in new and changed files."""

    graph: SourceGraph
    files: DataFrame
    tasks: DataFrame


def empty_graph(spark: SparkSession) -> SourceGraph:
    return SourceGraph.of_rows(spark, [], [])


def update(stored: SourceGraph, files: DataFrame, rebuild: bool = False, extractors: dict[str, Extractor] | None = None, descriptions: DataFrame | None = None, flags: DataFrame | None = None) -> Indexed:
    """Bring a graph up to files (path, content): walk, compare hashes, remove, extract, resolve, mark tests, merge.

    Only files that are new or changed are read in full. Nodes of the others keep their ids;
    new ones go on from the highest. Edges into removed nodes, and those that led outside,
    are looked up again, so the result has the nodes and edges that a rebuild has. Given
    descriptions and flags (of qualified names) are merged at the end. ``extractors`` are for
    further extensions, or in place of those that are built in.
    """
    spark = files.sparkSession
    if rebuild:
        stored = empty_graph(spark)
    extractors = extractors or {}
    sources = walk(files, tuple(dict.fromkeys((*EXTENSIONS, *extractors))))
    known = stored.nodes.filter("kind = 'File'").select(F.col("qualified_name").alias("path"), "hash")
    diff = materialise(hash_diff(known, sources.select("path", "hash")), "file-status")
    kept = remove_files(stored, diff.filter("status in ('deleted', 'changed')").select("path"))
    fresh = sources.join(diff.filter("status in ('added', 'changed')").select("path"), "path", "left_semi")
    last = max(stored.nodes.agg(F.max("id")).first()[0] or 0, stored.edges.agg(F.max("id")).first()[0] or 0)
    new = extract(fresh.filter(~F.col("ext").isin(*extractors)) if extractors else fresh, last + 1)
    nodes, edges = kept.nodes.unionByName(new.nodes), kept.edges.unionByName(new.edges)
    for ext, extractor in extractors.items():
        last = max(last, nodes.agg(F.max("id")).first()[0] or 0, edges.agg(F.max("id")).first()[0] or 0)
        own = extractor(fresh.filter(F.col("ext") == ext), last + 1)
        nodes, edges = nodes.unionByName(own.nodes), edges.unionByName(own.edges)
    whole = resolve(SourceGraph(nodes, edges))
    nodes = mark_tests(whole.nodes)
    if descriptions is not None or flags is not None:
        none = lambda column: spark.createDataFrame([], f"qualified_name string, {column}")
        nodes = commit_descriptions(nodes, none("description string") if descriptions is None else descriptions, none("is_test boolean") if flags is None else flags)
    graph = SourceGraph(materialise(nodes, "nodes"), materialise(whole.edges, "edges"))
    tasks = description_tasks(fresh.select("path", "content"), graph.nodes)
    return Indexed(graph, diff, tasks)


def index_tree(spark: SparkSession, files: DataFrame, path: str, rebuild: bool = False) -> Indexed:
    """``update`` of the graph stored at ``path``, whose changes become its next version; a graph that was never stored counts as empty.

    A run that breaks leaves the former version; another writer that was first makes it fail.
    """
    done = update(read_graph(spark, path), files, rebuild)
    (write_graph if rebuild else write_changes)(done.graph, path)
    return done
