"""Graph queries by name with JSON arguments and JSON answers, page by page.

An answer is a DataFrame of one row with the column answer. Only the rows from
``offset`` on, ``limit`` at most (by default 50 of a page), are gathered for it, in a
fixed order, so a longer list is read in several calls. A plain list is whole: one of
more than 10,000 rows is answered with an error unless the call says which part it wants,
and ``found`` gives all its rows as a DataFrame, however many.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import source_lines
from codeloom.graph import SourceGraph
from codeloom.operators import lookups as lk
from codeloom.operators import metrics as mt
from codeloom.operators import neighbours as nb
from codeloom.operators import reach as rc
from codeloom.schema import NODE_KINDS

#: Rows of an answer: of a page, and of a plain list, which fails beyond that.
DEFAULT_LIMIT, ARRAY_LIMIT = 50, 10_000


class Tool(NamedTuple):
    run: Callable[[SourceGraph, dict[str, Any]], DataFrame]
    required: tuple[str, ...]
    shape: str  # page, array or object
    key: str | None = None  # an object's key for its rows


TOOLS: dict[str, Tool] = {}


def tool(name: str, shape: str = "page", *required: str, key: str | None = None) -> Callable:
    def keep(run: Callable) -> Callable:
        TOOLS[name] = Tool(run, required, shape, key)
        return run

    return keep


def arguments(text: str | None) -> dict[str, Any]:
    """The arguments; text that isn't a JSON object counts as none."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def whole(args: dict[str, Any], name: str, default: int | None) -> int | None:
    """A natural number, or the default for anything else."""
    value = args.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


def error(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(json.dumps({"error": text}),)], "answer string")


def mistake(g: SourceGraph, name: str, args: dict[str, Any]) -> str | None:
    """What is wrong with a call, if anything."""
    if name not in TOOLS:
        return f"unknown tool: {name}"
    required = TOOLS[name].required
    for field in required:
        if args.get(field) is None:
            return f"missing '{field}' parameter"
    for field in required:
        if field.startswith(("qualified_name", "from", "to")) and node_id(g, args[field]) is None:
            return f"node not found: {args[field]}"
    if name == "find_nodes_by_kind" and args["kind"] not in NODE_KINDS:
        return f"unknown node kind: {args['kind']}"
    return None


def found(g: SourceGraph, name: str, args_json: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """All rows of a tool's answer, to be filtered, joined or written; a call with a mistake raises ValueError."""
    args = arguments(args_json)
    if wrong := mistake(g, name, args):
        raise ValueError(wrong)
    return TOOLS[name].run(g, args | {"files": files})


def call(g: SourceGraph, name: str, args_json: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """Run a tool. Errors (unknown tool or node, missing argument, a plain list beyond its bound) are answers too."""
    args = arguments(args_json)
    if wrong := mistake(g, name, args):
        return error(g.nodes.sparkSession, wrong)
    one = TOOLS[name]
    rows = one.run(g, args | {"files": files})
    if one.shape == "page":
        return envelope(rows, whole(args, "offset", 0), whole(args, "limit", DEFAULT_LIMIT))
    if one.shape == "array" or one.key:
        limit = whole(args, "limit", None)
        items = gathered(lk.page(rows, rows.columns, whole(args, "offset", 0), ARRAY_LIMIT + 1 if limit is None else limit))
        answer = F.to_json(F.struct(F.col("items").alias(one.key)) if one.key else "items")
        beyond = F.lit(json.dumps({"error": f"more than {ARRAY_LIMIT} rows: ask for parts of them by offset and limit"}))
        return items.select((answer if limit is not None else F.when(F.size("items") > ARRAY_LIMIT, beyond).otherwise(answer)).alias("answer"))
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("answer"))


def gathered(rows: DataFrame) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("items"))


def envelope(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """items, total, offset, returned and has_more of one page, in the order of the rows' columns."""
    order = [F.desc("incoming"), "id"] if "incoming" in rows.columns else rows.columns
    page = lk.page(rows, order, offset, limit)
    placed = page.agg(F.collect_list(F.struct(*rows.columns)).alias("items"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    returned = F.size("items")
    return placed.join(total).select(F.to_json(F.struct("items", "total", F.lit(offset).alias("offset"), returned.alias("returned"), (F.lit(offset) + returned < F.col("total")).alias("has_more"))).alias("answer"))


def node_id(g: SourceGraph, name: str) -> int | None:
    row = g.nodes.filter(F.col("qualified_name") == name).agg(F.max("id")).first()
    return row[0]


def one_id(g: SourceGraph, name: str, column: str = "id") -> DataFrame:
    return g.nodes.filter(F.col("qualified_name") == name).agg(F.max("id").alias(column))


def summaries(g: SourceGraph, ids: DataFrame, column: str = "other") -> DataFrame:
    return lk.node_summary(ids.select(F.col(column).alias("id")).join(g.nodes, "id"))


def details(g: SourceGraph, ids: DataFrame, column: str = "other") -> DataFrame:
    return lk.node_details(ids.select(F.col(column).alias("id")).join(g.nodes, "id"))


NAME = "qualified_name"

tool("list_files")(lambda g, a: lk.list_files(g))
tool("get_file_summary", "page", "file")(lambda g, a: lk.node_summary(lk.nodes_in_file(g, a["file"])))
tool("get_node_details", "object", NAME)(lambda g, a: lk.node_details(lk.find_by_qualified(g, a[NAME])))
tool("get_dependencies", "page", NAME)(lambda g, a: nb.dependencies(g, one_id(g, a[NAME])).select("edge_id", "kind", "target"))
tool("get_dependents", "page", NAME)(lambda g, a: nb.dependents(g, one_id(g, a[NAME])).select("edge_id", "kind", "source"))
tool("find_nodes_by_kind", "page", "kind")(lambda g, a: lk.node_summary(lk.nodes_of_kind_no_tests(g, a["kind"]) if a.get("exclude_tests") is True else lk.nodes_of_kind(g, a["kind"])))
tool("search_nodes", "page", "query")(lambda g, a: lk.node_summary(lk.search_nodes(g, a["query"], a.get("exclude_tests") is True)))
tool("get_package_dependencies")(lambda g, a: mt.package_dependency_graph(g))
tool("get_hotspots")(lambda g, a: mt.in_degrees(g))
tool("get_entry_points")(lambda g, a: lk.node_summary(mt.entry_points(g)))
tool("get_nodes_in_package", "page", "package_prefix")(lambda g, a: lk.node_summary(lk.nodes_in_package(g, a["package_prefix"])))
tool("get_nodes_with_attribute", "page", "attribute")(lambda g, a: lk.node_summary(lk.nodes_with_attribute(g, a["attribute"])))
tool("get_methods_throwing", "page", "exception_name")(lambda g, a: summaries(g, nb.methods_throwing(g, a["exception_name"]), "id"))
tool("get_exception_propagation", "array", "exception_name")(lambda g, a: summaries(g, rc.exception_propagation(g, a["exception_name"]), "id"))
tool("get_external_dependencies", "array")(lambda g, a: lk.node_summary(lk.external_dependencies(g)))
tool("get_package_cycles", "object", key="cycles")(lambda g, a: mt.package_cycles(g))

for _name, _make in {
    "get_callers": rc.upstream_callers, "get_callees": rc.downstream_calls, "get_subclasses": rc.all_subclasses,
    "get_interface_hierarchy": rc.interface_hierarchy, "get_import_closure": rc.import_closure, "get_change_impact": rc.change_impact,
}.items():
    tool(_name, "page", NAME)(lambda g, a, make=_make: summaries(g, make(g, one_id(g, a[NAME], "root"), whole(a, "depth", None)), "id"))
tool("get_async_call_chain", "array", NAME)(lambda g, a: summaries(g, rc.async_call_chain(g, one_id(g, a[NAME], "root"), whole(a, "depth", None)), "id"))
tool("get_superclasses", "page", NAME)(lambda g, a: rc.superclass_chain(g, one_id(g, a[NAME], "root")).select("position", "id").join(g.nodes.select("id", "kind", "name", NAME), "id").select("position", "id", "kind", "name", NAME))

for _name, _make in {
    "get_direct_callers": nb.direct_callers, "get_direct_callees": nb.direct_callees, "get_implementors": nb.implementors, "get_overriders": nb.overriders,
    "get_readers_of": nb.readers_of, "get_writers_of": nb.writers_of, "get_fields_read_by": nb.fields_read_by, "get_fields_written_by": nb.fields_written_by,
    "get_direct_imports": nb.direct_imports, "get_direct_importers": nb.direct_importers, "get_instantiators": nb.instantiators,
    "get_types_instantiated_by": nb.types_instantiated_by, "get_unused_fields": mt.unused_fields, "get_unimplemented_methods": mt.unimplemented_interface_methods,
}.items():
    tool(_name, "page", NAME)(lambda g, a, make=_make: summaries(g, make(g, one_id(g, a[NAME]))))
for _name, _make, _shape in (("get_methods", nb.methods_of, "page"), ("get_fields", nb.fields_of, "page"), ("get_public_api", nb.public_api, "page"), ("get_parameters_of", nb.parameters_of, "array")):
    tool(_name, _shape, NAME)(lambda g, a, make=_make: details(g, make(g, one_id(g, a[NAME]))))
tool("get_what_overrides", "object", NAME)(lambda g, a: summaries(g, nb.what_overrides(g, one_id(g, a[NAME]))))
tool("get_parent_of", "object", NAME)(lambda g, a: summaries(g, nb.parent_of(g, one_id(g, a[NAME]))))
tool("get_usages_of_type", "array", NAME)(lambda g, a: summaries(g, mt.usages_of_type(g, one_id(g, a[NAME]))))


@tool("get_graph_summary", "object")
def graph_summary(g: SourceGraph, a: dict[str, Any]) -> DataFrame:
    """Totals and counts by kind, and how many nodes are tests."""
    counts = lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by"))
    nodes = counts(g.nodes).select(F.col("total").alias("total_nodes"), F.col("by").alias("nodes_by_kind"))
    edges = counts(g.edges).select(F.col("total").alias("total_edges"), F.col("by").alias("edges_by_kind"))
    return nodes.join(edges).join(mt.test_split(g))


@tool("get_coupling", "object", NAME)
def get_coupling(g: SourceGraph, a: dict[str, Any]) -> DataFrame:
    """Of the node's own edges alone, not of the whole graph."""
    own, id = one_id(g, a[NAME]), node_id(g, a[NAME])
    near = g.edges.filter((F.col("src") == id) | (F.col("to_id") == id))
    return mt.coupling(SourceGraph(g.nodes.join(own, "id", "left_semi"), near))


@tool("get_cohesion", "object", NAME)
def get_cohesion(g: SourceGraph, a: dict[str, Any]) -> DataFrame:
    own = one_id(g, a[NAME])
    found = mt.lcom(SourceGraph(g.nodes, g.edges.filter("kind <> 'Contains'").unionByName(g.edges.filter("kind = 'Contains'").join(own.select(F.col("id").alias("src")), "src", "left_semi").select(*g.edges.columns))))
    return own.join(found, "id", "left").select("id", F.coalesce("lcom", F.lit(0.0)).alias("lcom"))


@tool("get_call_path", "object", "from", "to")
def get_call_path(g: SourceGraph, a: dict[str, Any]) -> DataFrame:
    pair = one_id(g, a["from"], "from_id").join(one_id(g, a["to"], "to_id"))
    return pair.join(rc.call_path(g, pair), ["from_id", "to_id"], "left").select("path")


@tool("get_shared_dependencies", "array", "qualified_name_a", "qualified_name_b")
def get_shared_dependencies(g: SourceGraph, a: dict[str, Any]) -> DataFrame:
    pair = one_id(g, a["qualified_name_a"], "a").join(one_id(g, a["qualified_name_b"], "b"))
    return summaries(g, mt.shared_dependencies(g, pair))


@tool("get_file_source", "object", "file")
def get_file_source(g: SourceGraph, a: dict[str, Any]) -> DataFrame:
    """Lines of a file, from 1 and inclusive."""
    found = a["files"].filter(F.col("path") == a["file"])
    first, last = F.lit(whole(a, "start_line", 1)).cast("int"), F.lit(whole(a, "end_line", 2**31 - 1)).cast("int")
    return found.select("path", source_lines(F.col("content"), first, last).alias("source"))
