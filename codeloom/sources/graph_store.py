"""A stored graph in versions: a base, the changes since, and a manifest that is switched in one step.

Every write goes to a folder of its own that nothing reads yet. Only then a manifest that
names the folders gets the next version's number, by a rename that fails where another
writer was first. A run that breaks before that leaves the former version as it was; a
reader sees one version whole. Changes are rows that came or were altered, and ids that
went; reading keeps of each id what the latest folder says. After some changes a version
is written whole again.

``discard_unused`` deletes folders that no version kept names.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.schema import EDGES, NODES

#: Changes that a version may rest on before it is written whole.
MOST_CHANGES = 8
TABLES = {"nodes": NODES, "edges": EDGES}


class ConcurrentWrite(RuntimeError):
    """Another writer committed the version first; nothing was changed."""


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of a path, and the path in it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions stored at ``path``, in order; none where nothing is stored."""
    fs, folder = file_system(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    return sorted(int(name) for name in (s.getPath().getName() for s in fs.listStatus(folder)) if name.isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict[str, Any]:
    """The folders of a version: its base, and the changes in order."""
    rows = spark.read.text(f"{path}/manifests/{version:012d}", wholetext=True).collect()
    return json.loads(rows[0][0])


def commit(spark: SparkSession, path: str, version: int, folders: dict[str, Any]) -> None:
    """Make the folders the given version, unless there is one of that number."""
    fs, target = file_system(spark, f"{path}/manifests/{version:012d}")
    _, draft = file_system(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise ConcurrentWrite(f"version {version} of {path} is there already")


def layer(spark: SparkSession, folder: str, name: str, n: int) -> DataFrame:
    """The rows of a folder's table, or the ids that went, as (id, _n, _row)."""
    schema = TABLES[name]
    columns = [F.col(c) for c in schema.names]
    rows = spark.read.schema(schema).parquet(f"{folder}/{name}").select("id", F.lit(n).alias("_n"), F.struct(*columns).alias("_row"))
    if not n:
        return rows
    gone = spark.read.schema("id long").parquet(f"{folder}/{name}-gone").select("id", F.lit(n).alias("_n"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    return rows.unionByName(gone)


def read_table(spark: SparkSession, folders: dict[str, Any], name: str) -> DataFrame:
    base = spark.read.schema(TABLES[name]).parquet(f"{folders['base']}/{name}")
    if not folders["changes"]:
        return base.select(*TABLES[name].names)
    # Only ids that some change names are merged; all other rows are the base's, and aren't shuffled where the changes are small.
    changes = [layer(spark, folder, name, n + 1) for n, folder in enumerate(folders["changes"])]
    late = changes[0]
    for more in changes[1:]:
        late = late.unionByName(more)
    last = late.groupBy("id").agg(F.max_by("_row", "_n").alias("_row"))
    return base.join(last.select("id"), "id", "left_anti").select(*TABLES[name].names).unionByName(last.filter("_row is not null").select("_row.*"))


def read_graph(spark: SparkSession, path: str, version: int | None = None) -> SourceGraph:
    """The latest version stored at ``path``, or the given one; where none was ever stored, an empty graph. What can't be read raises."""
    known = versions(spark, path)
    if version is None and not known:
        return SourceGraph(*(spark.createDataFrame([], schema) for schema in TABLES.values()))
    folders = manifest(spark, path, known[-1] if version is None else version)
    return SourceGraph(read_table(spark, folders, "nodes"), read_table(spark, folders, "edges"))


def write_graph(g: SourceGraph, path: str) -> int:
    """Store a graph whole as the next version, its edges partitioned by kind; the version's number."""
    spark = g.nodes.sparkSession
    version = (versions(spark, path) or [-1])[-1] + 1
    folder = f"{path}/data/{version:012d}-{uuid.uuid4().hex}"
    g.nodes.select(*NODES.names).write.parquet(f"{folder}/nodes")
    g.edges.select(*EDGES.names).write.partitionBy("kind").parquet(f"{folder}/edges")
    commit(spark, path, version, {"base": folder, "changes": []})
    return version


def write_changes(g: SourceGraph, path: str, most: int = MOST_CHANGES) -> int:
    """Store what a graph has otherwise than the latest version as the next one; it is written whole if that is the first, or rests on ``most`` changes."""
    spark = g.nodes.sparkSession
    known = versions(spark, path)
    before = manifest(spark, path, known[-1]) if known else None
    if before is None or len(before["changes"]) >= most:
        return write_graph(g, path)
    version = known[-1] + 1
    folder = f"{path}/data/{version:012d}-{uuid.uuid4().hex}"
    for name, new in (("nodes", g.nodes), ("edges", g.edges)):
        columns = TABLES[name].names
        mark = F.xxhash64(F.to_json(F.struct(*columns)), F.lit(1)), F.xxhash64(F.to_json(F.struct(*columns)), F.lit(2))
        old = read_table(spark, before, name).select("id", *(m.alias(f"_m{i}") for i, m in enumerate(mark)))
        marked = new.select(*columns, *(m.alias(f"_n{i}") for i, m in enumerate(mark)))
        came = marked.join(old, "id", "left").filter("_m0 is null or _m0 <> _n0 or _m1 <> _n1").select(*columns)
        (came.write.partitionBy("kind") if name == "edges" else came.write).parquet(f"{folder}/{name}")
        old.join(new.select("id"), "id", "left_anti").select("id").write.parquet(f"{folder}/{name}-gone")
    commit(spark, path, version, {"base": before["base"], "changes": [*before["changes"], folder]})
    return version


def discard_unused(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete all versions but the latest ``keep``, and the folders that none of these names; how many folders went. No writer may be under way."""
    known = versions(spark, path)
    used = set()
    for version in known[-keep:]:
        folders = manifest(spark, path, version)
        used |= {folders["base"], *folders["changes"]}
    fs, data = file_system(spark, f"{path}/data")
    for version in known[:-keep]:
        fs.delete(file_system(spark, f"{path}/manifests/{version:012d}")[1], False)
    names = {folder.rsplit("/", 1)[-1] for folder in used}
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in names] if fs.exists(data) else []
    for folder in gone:
        fs.delete(folder, True)
    return len(gone)
