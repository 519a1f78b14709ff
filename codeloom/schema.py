"""Schemas and value domains of code graphs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

#: Kinds of nodes and edges, languages, visibilities and target states.
NODE_KINDS = ("File", "Package", "Class", "Interface", "Trait", "Enum", "Annotation", "TypeAlias", "Function", "Method", "Field", "StaticField", "Constant", "Variable", "Parameter", "TypeParameter", "Closure", "GlobalVariable", "Import", "ExternalPackage")
EDGE_KINDS = ("Contains", "Imports", "Reexports", "Extends", "Implements", "Overrides", "HasParameter", "Returns", "HasType", "Calls", "Instantiates", "Reads", "Writes", "Throws", "Awaits", "Captures", "Decorates", "DependsOn", "References")
LANGUAGES = ("Java", "Python", "TypeScript", "JavaScript", "Rust", "Go", "CSharp", "Cpp", "Ruby", "Swift", "Kotlin", "Unknown")
VISIBILITIES = ("Public", "Protected", "Private", "Internal", "PackagePrivate", "Unspecified")
TARGET_STATES = ("Resolved", "External", "Unresolved")

#: Edge kinds that each metric follows.
COUPLING_KINDS = ("Calls", "Instantiates", "Implements", "Extends", "HasType", "Returns")
IMPACT_KINDS = ("Calls", "Instantiates", "Reads", "Writes", "HasType", "Returns", "Extends", "Implements")
USAGE_KINDS = ("HasType", "Returns", "Instantiates", "References")
SHARED_KINDS = ("Calls", "Instantiates", "HasType", "Returns")
PACKAGE_KINDS = ("Calls", "Instantiates", "Implements", "Extends", "Imports", "References")
LAYER_KINDS = ("Calls", "Instantiates", "Imports", "References")
CYCLE_KINDS = ("Extends", "Imports")
FIELD_KINDS = ("Field", "StaticField", "Constant")
DESCRIBED_KINDS = ("Class", "Interface", "Trait", "Enum", "Method", "Function", "Field", "StaticField")

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_line", "start_col", "end_line", "end_col")])

NODES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("qualified_name", T.StringType(), False),
    T.StructField("file", T.StringType()),
    T.StructField("span", SPAN),
    T.StructField("language", T.StringType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("is_async", T.BooleanType(), False),
    T.StructField("is_abstract", T.BooleanType(), False),
    T.StructField("is_constructor", T.BooleanType(), False),
    T.StructField("is_test", T.BooleanType(), False),
    T.StructField("type_annotation", T.StringType()),
    T.StructField("generic_params", T.ArrayType(T.StringType(), False)),
    T.StructField("generic_bounds", T.ArrayType(T.StringType(), False)),
    T.StructField("attributes", T.ArrayType(T.StringType(), False)),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType(), False)),
    T.StructField("description", T.StringType()),
    T.StructField("hash", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("src", T.LongType(), False),
    T.StructField("to_state", T.StringType(), False),
    T.StructField("to_id", T.LongType()),
    T.StructField("to_name", T.StringType()),
    T.StructField("span", SPAN),
    T.StructField("call_arity", T.IntegerType()),
    T.StructField("annotation_args", T.StringType()),
])

FILES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("content", T.StringType()), T.StructField("ext", T.StringType()), T.StructField("hash", T.StringType())])


def make_node(id: int, kind: str, name: str, qualified_name: str | None = None, **more: Any) -> dict[str, Any]:
    """A node with defaults for all it doesn't state."""
    if kind not in NODE_KINDS:
        raise ValueError(f"unknown node kind {kind!r}")
    base = {"id": id, "kind": kind, "name": name, "qualified_name": qualified_name or name, "file": None, "span": (0, 0, 0, 0), "language": "Unknown", "visibility": "Unspecified", "is_async": False, "is_abstract": False, "is_constructor": False, "is_test": False, "type_annotation": None, "generic_params": [], "generic_bounds": [], "attributes": [], "metadata": {}, "description": None, "hash": None}
    return base | more


def make_edge(id: int, kind: str, src: int, to: int | str, state: str | None = None, **more: Any) -> dict[str, Any]:
    """An edge to a node id, or to a name that is yet unresolved unless ``state`` says External."""
    if kind not in EDGE_KINDS:
        raise ValueError(f"unknown edge kind {kind!r}")
    resolved = isinstance(to, int)
    base = {"id": id, "kind": kind, "src": src, "to_state": state or ("Resolved" if resolved else "Unresolved"), "to_id": to if resolved else None, "to_name": None if resolved else to, "span": (0, 0, 0, 0), "call_arity": None, "annotation_args": None}
    return base | more
