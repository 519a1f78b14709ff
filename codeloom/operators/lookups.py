"""Filters and projections of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.schema import NODE_KINDS


def node(g: SourceGraph, id: int) -> DataFrame:
    return g.nodes.filter(F.col("id") == id)


def find_by_qualified(g: SourceGraph, name: str) -> DataFrame:
    """The node that the name means: of several, the one of highest id."""
    return g.nodes.filter(F.col("qualified_name") == name).orderBy(F.desc("id")).limit(1)


def nodes_of_kind(g: SourceGraph, kind: str) -> DataFrame:
    if kind not in NODE_KINDS:
        raise ValueError(f"unknown node kind {kind!r}")
    return g.nodes.filter(F.col("kind") == kind)


def nodes_of_kind_no_tests(g: SourceGraph, kind: str) -> DataFrame:
    return nodes_of_kind(g, kind).filter(~F.col("is_test"))


def test_nodes_of_kind(g: SourceGraph, kind: str) -> DataFrame:
    return nodes_of_kind(g, kind).filter("is_test")


def classes(g: SourceGraph) -> DataFrame:
    return nodes_of_kind(g, "Class")


def interfaces(g: SourceGraph) -> DataFrame:
    return nodes_of_kind(g, "Interface")


def traits(g: SourceGraph) -> DataFrame:
    return nodes_of_kind(g, "Trait")


def enums(g: SourceGraph) -> DataFrame:
    return nodes_of_kind(g, "Enum")


def functions(g: SourceGraph) -> DataFrame:
    return nodes_of_kind(g, "Function")


def classes_no_tests(g: SourceGraph) -> DataFrame:
    return nodes_of_kind_no_tests(g, "Class")


def interfaces_no_tests(g: SourceGraph) -> DataFrame:
    return nodes_of_kind_no_tests(g, "Interface")


def traits_no_tests(g: SourceGraph) -> DataFrame:
    return nodes_of_kind_no_tests(g, "Trait")


def enums_no_tests(g: SourceGraph) -> DataFrame:
    return nodes_of_kind_no_tests(g, "Enum")


def functions_no_tests(g: SourceGraph) -> DataFrame:
    return nodes_of_kind_no_tests(g, "Function")


def nodes_in_file(g: SourceGraph, file: str) -> DataFrame:
    return g.nodes.filter(F.col("file") == file)


def nodes_in_package(g: SourceGraph, prefix: str) -> DataFrame:
    """Nodes whose qualified name starts with the text; segments don't matter."""
    return g.nodes.filter(F.col("qualified_name").startswith(prefix))


def nodes_with_attribute(g: SourceGraph, attribute: str) -> DataFrame:
    return g.nodes.filter(F.array_contains("attributes", attribute))


def external_dependencies(g: SourceGraph) -> DataFrame:
    return nodes_of_kind(g, "ExternalPackage")


def search_nodes(g: SourceGraph, query: str, exclude_tests: bool = False) -> DataFrame:
    """Nodes whose name or qualified name has the text, in any case."""
    has = lambda c: F.contains(F.lower(c), F.lit(query.lower()))
    found = g.nodes.filter(has(F.col("name")) | has(F.col("qualified_name")))
    return found.filter(~F.col("is_test")) if exclude_tests else found


def list_files(g: SourceGraph) -> DataFrame:
    """(file, node_count)."""
    return g.nodes.filter("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("node_count"))


def page(rows: DataFrame, order: list[str | Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in the given order; a top-k plan, not a full sort."""
    return rows.orderBy(*order).offset(offset).limit(limit)


#: What a summary and the details of a node show.
SUMMARY_FIELDS = ("id", "kind", "name", "qualified_name", "file", "visibility", "is_test", "description")
DETAIL_FIELDS = (*SUMMARY_FIELDS, "language", "is_async", "is_abstract", "is_constructor", "type_annotation", "generic_params", "generic_bounds", "attributes")


def node_summary(nodes: DataFrame) -> DataFrame:
    return nodes.select(*(c for c in SUMMARY_FIELDS if c in nodes.columns))


def node_details(nodes: DataFrame) -> DataFrame:
    """The summary, flags, types and attributes, and the first and last line."""
    fields = [F.col(c) for c in DETAIL_FIELDS if c in nodes.columns]
    lines = [F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line")] if "span" in nodes.columns else []
    return nodes.select(*fields, *lines)
