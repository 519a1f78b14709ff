"""A stored index of names finds what a scan finds, and reads less."""

import random

from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.operators import lookups as lk
from codeloom.schema import make_node
from codeloom.sources import name_index as ni


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    pick = random.Random(1)
    parts = ["Order", "order", "Straße", "İnit", "x", "", "List", "a.b", "日本語", "__", "O'Neil", "%", "CUSTOMER"]
    names = [".".join(pick.choice(parts) + str(pick.randrange(40)) * pick.randrange(2) for _ in range(pick.randrange(1, 4))) for _ in range(400)]
    nodes = [make_node(i, "Class", n.rsplit(".", 1)[-1], n, is_test=i % 5 == 0) for i, n in enumerate(names)]
    g = SourceGraph.of_rows(spark, nodes, [])
    path = str(tmp_path / "index")
    ni.build(g, path, ranges=6)
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    for query in ("order", "ORDER1", "straße", "STRASSE", "日本語", "日本", "x", "", "a.b.", "er1.li", "order%", "'neil", "nowhere", "customer1.ord", "İnit"):
        assert ids(ni.search_nodes(spark, path, query)) == ids(lk.search_nodes(g, query)), query
    assert ids(ni.search_nodes(spark, path, "order", True)) == ids(lk.search_nodes(g, "order", True))
    for prefix in ("Order", "a.b", "", "日", "zzz"):
        assert ids(ni.nodes_in_package(spark, path, prefix)) == ids(lk.nodes_in_package(g, prefix)), prefix
    every = {r["part"] for r in spark.read.parquet(f"{path}/nodes").select("part").distinct().collect()}
    grams = ni.rarest(spark, path, "customer1")
    assert len(grams) == ni.READ and len(every) == 6
    one = max(names, key=len).lower()
    met = {r["part"] for r in ni.candidates(spark, path, ni.rarest(spark, path, one)).collect()}
    assert met and len(met) < len(every)
    plan = ni.search_nodes(spark, path, one)._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters")[1][:120]
    assert ni.rarest(spark, path, "nowhere") is None


def test_an_empty_graph_has_an_index(spark, tmp_path):
    g = SourceGraph.of_rows(spark, [make_node(0, "Class", "A")], [])
    path = str(tmp_path / "index")
    ni.build(g, path)
    assert ni.search_nodes(spark, path, "abc").count() == 0 and ni.search_nodes(spark, path, "a").count() == 1
    ni.build(SourceGraph(g.nodes.limit(0), g.edges), path + "0")
    assert ni.search_nodes(spark, path + "0", "abc").count() == 0 and ni.nodes_in_package(spark, path + "0", "a").count() == 0


def test_what_a_task_sorts_does_not_grow_with_the_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ni, "NODE_ROWS", 300, raising=False)
    monkeypatch.setattr(ni, "POSTING_ROWS", 500, raising=False)
    g = SourceGraph.of_rows(spark, [make_node(i, "Class", f"Cus{i}", f"Cus.{i}") for i in range(9000)], [])
    path = str(tmp_path / "index")
    ni.build(g, path)
    ranges = spark.read.parquet(f"{path}/nodes").groupBy("part").count().collect()
    assert len(ranges) == 30 and max(r["count"] for r in ranges) < 900
    files = spark.read.parquet(f"{path}/postings").groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) < 1000  # "cus" is in every name
    assert sorted(r["id"] for r in ni.search_nodes(spark, path, "CUS12").collect()) == [i for i in range(9000) if str(i).startswith("12")]
