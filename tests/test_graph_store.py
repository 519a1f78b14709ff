"""Versions of a stored graph."""

import pytest
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.schema import make_edge, make_node
from codeloom.sources import graph_store as gs


def shown(g):
    return sorted(map(repr, g.nodes.collect())), sorted(map(repr, g.edges.collect()))


def first(spark):
    nodes = [make_node(i, "Class", f"C{i}", file="a.src", metadata={"k": "v"} if i == 1 else {}, attributes=["@x"]) for i in range(5)]
    edges = [make_edge(i, kind, i % 5, to) for i, (kind, to) in enumerate([("Calls", 1), ("Calls", "out"), ("Extends", 2), ("Reads", 3)])]
    return SourceGraph.of_rows(spark, nodes, edges)


def altered(g):
    """Without node 4 and edge 1, with node 9 and edge 9, and another text for node 1 and target for edge 0."""
    nodes = g.nodes.filter("id <> 4").withColumn("description", F.when(F.col("id") == 1, "new")).unionByName(g.nodes.filter("id = 4").withColumn("id", F.lit(9).cast("long")))
    edges = g.edges.filter("id <> 1").withColumn("to_id", F.when(F.col("id") == 0, 3).otherwise(F.col("to_id"))).unionByName(g.edges.filter("id = 1").withColumn("id", F.lit(9).cast("long")).withColumn("kind", F.lit("Throws")))
    return SourceGraph(nodes, edges)


def test_versions_hold_what_was_written(spark, tmp_path):
    path = str(tmp_path / "g")
    assert gs.read_graph(spark, path).nodes.count() == 0 and gs.versions(spark, path) == []
    one = first(spark)
    two = altered(one)
    assert gs.write_changes(one, path) == 0 and gs.write_changes(two, path) == 1 and gs.write_changes(one, path) == 2
    assert [shown(gs.read_graph(spark, path, v)) for v in (0, 1, 2)] == [shown(one), shown(two), shown(one)]
    assert shown(gs.read_graph(spark, path)) == shown(one)
    changes = gs.manifest(spark, path, 2)["changes"]
    assert len(changes) == 2 and spark.read.parquet(f"{changes[0]}/nodes").count() == 2 and spark.read.parquet(f"{changes[0]}/edges-gone").count() == 1
    assert gs.write_changes(two, path, most=2) == 3 and gs.manifest(spark, path, 3)["changes"] == []
    assert shown(gs.read_graph(spark, path)) == shown(two)
    assert gs.discard_unused(spark, path) == 3 and gs.versions(spark, path) == [3]
    assert shown(gs.read_graph(spark, path)) == shown(two)
    empty = SourceGraph(one.nodes.limit(0), one.edges.limit(0))
    gs.write_changes(empty, path)
    assert gs.read_graph(spark, path).nodes.count() == 0


@pytest.mark.parametrize("broken", ["nodes", "edges", "commit"])
def test_a_broken_write_keeps_the_former_version(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "g")
    one = first(spark)
    gs.write_graph(one, path)
    fails = F.when(F.col("id") >= 0, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long")
    two = altered(one)
    if broken == "commit":
        monkeypatch.setattr(gs, "commit", lambda *a: (_ for _ in ()).throw(OSError("broken")))
    else:
        two = SourceGraph(two.nodes.withColumn("id", fails) if broken == "nodes" else two.nodes, two.edges.withColumn("id", fails) if broken == "edges" else two.edges)
    for write in (gs.write_graph, gs.write_changes):
        with pytest.raises(Exception, match="broken"):
            write(two, path)
        assert shown(gs.read_graph(spark, path)) == shown(one)
    monkeypatch.undo()
    assert gs.write_changes(altered(one), path) == 1 and gs.discard_unused(spark, path, keep=2) >= 2
    assert shown(gs.read_graph(spark, path)) == shown(altered(one)) and shown(gs.read_graph(spark, path, 0)) == shown(one)


def test_the_second_writer_of_a_version_fails(spark, tmp_path):
    path = str(tmp_path / "g")
    one = first(spark)
    gs.write_graph(one, path)
    with pytest.raises(gs.ConcurrentWrite):
        gs.commit(spark, path, 0, {"base": "elsewhere", "changes": []})
    assert shown(gs.read_graph(spark, path)) == shown(one)


def test_what_cant_be_read_is_not_empty(spark, tmp_path):
    path = str(tmp_path / "g")
    gs.write_graph(first(spark), path)
    gs.commit(spark, path, 1, {"base": str(tmp_path / "nowhere"), "changes": []})
    with pytest.raises(Exception):
        gs.read_graph(spark, path).nodes.count()
