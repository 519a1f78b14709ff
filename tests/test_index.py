"""The index job, feature folders, batches, stream compaction and the scratch folder."""

import os

import pytest
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.jobs import index as ix
from codeloom.jobs.enrich import split_batches
from codeloom.jobs.features import named_folders, next_folders
from codeloom.jobs.ingest import scan
from codeloom.operators import components
from codeloom.operators.closure import closure
from codeloom.operators.components import connected_components
from codeloom.schema import make_edge, make_node
from codeloom.sources import scratch
from codeloom.streaming import ingest as st

FIRST = {"a/Cart.java": "package a;\npublic class Cart extends Base {\n    int n;\n    void add() {\n        this.n = 1;\n    }\n}\n", "a/Base.java": "package a;\nclass Base {\n}\n", "t/test_x.py": "def run():\n    pass\n", "notes.txt": "no"}
SECOND = {"a/Cart.java": "package a;\npublic class Cart extends Root {\n    void add() {\n        helper(1);\n    }\n}\n", "a/Root.java": "package a;\nclass Root {\n}\n", "t/test_x.py": FIRST["t/test_x.py"]}


def files(spark, sources):
    return spark.createDataFrame(list(sources.items()), "path string, content string")


def named(g):
    name = {r["id"]: (r["file"], r["qualified_name"]) for r in g.nodes.collect()}
    nodes = sorted((r["file"], r["qualified_name"], r["kind"], r["is_test"], str(r["span"])) for r in g.nodes.collect())
    edges = sorted((name[e["src"]], e["kind"], e["to_state"], str(name.get(e["to_id"], e["to_name"])), str(e["call_arity"])) for e in g.edges.collect())
    return nodes, edges


def test_two_runs_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "graph")
    first = ix.index_tree(spark, files(spark, FIRST), path)
    assert {(r["path"], r["status"]) for r in first.files.collect()} == {(p, "added") for p in FIRST if p != "notes.txt"}
    assert {r["file"] for r in first.tasks.collect()} == {"a/Cart.java", "a/Base.java", "t/test_x.py"}
    second = ix.index_tree(spark, files(spark, SECOND), path)
    assert {(r["path"], r["status"]) for r in second.files.collect()} == {("a/Cart.java", "changed"), ("a/Base.java", "deleted"), ("a/Root.java", "added"), ("t/test_x.py", "unchanged")}
    assert {r["file"] for r in second.tasks.collect()} == {"a/Cart.java", "a/Root.java"}
    rebuilt = ix.update(second.graph, files(spark, SECOND), rebuild=True)
    assert named(second.graph) == named(rebuilt.graph)
    kept = lambda g: {r["qualified_name"]: r["id"] for r in g.nodes.filter("file = 't/test_x.py'").collect()}
    assert kept(first.graph) == kept(second.graph)
    ids = [r["id"] for r in second.graph.nodes.collect()]
    assert len(ids) == len(set(ids)) and second.graph.validate().count() == 0
    back = ix.read_graph(spark, path)
    assert named(back) == named(second.graph)
    nothing = ix.index_tree(spark, files(spark, SECOND), path)
    assert {r["status"] for r in nothing.files.collect()} == {"unchanged"} and named(nothing.graph) == named(second.graph)


def test_own_extractors_and_descriptions(spark):
    def headings(sources, first_id):
        nodes = [make_node(first_id + i, "File", r["path"], file=r["path"], hash=r["hash"]) for i, r in enumerate(sources.collect())]
        return SourceGraph.of_rows(spark, nodes, [make_edge(first_id, "References", first_id, "Cart")] if nodes else [])

    texts = spark.createDataFrame([("Cart", "A cart.")], "qualified_name string, description string")
    done = ix.update(ix.empty_graph(spark), files(spark, FIRST), extractors={"txt": headings}, descriptions=texts)
    nodes = {r["qualified_name"]: r for r in done.graph.nodes.collect()}
    assert nodes["notes.txt"]["kind"] == "File" and nodes["Cart"]["description"] == "A cart."
    assert done.graph.edges.filter("kind = 'References' and to_state = 'Resolved'").count() == 1
    assert done.graph.nodes.count() == len({r["id"] for r in done.graph.nodes.collect()})


def test_feature_folders(spark):
    folders = spark.createDataFrame([("001-first",), ("012-Second thing",), ("x",), ("7-seven",)], "name string")
    texts = spark.createDataFrame([(1, "# Add a cart!\nmore"), (2, "no title"), (3, "x\n# Three")], "id long, text string")
    assert {(r["id"], r["folder"]) for r in next_folders(folders, texts).collect()} == {(1, "013-add-a-cart"), (2, "014-feature"), (3, "015-three")}
    assert [r["folder"] for r in next_folders(folders.limit(0), texts.limit(1)).collect()] == ["001-add-a-cart"]
    asked = spark.createDataFrame([("X",), ("012",), ("second",), ("0",), ("s",), ("none",), ("7-SEVEN",)], "name string")
    assert {(r["name"], r["folder"]) for r in named_folders(folders, asked).collect()} == {("X", "x"), ("012", "012-Second thing"), ("second", "012-Second thing"), ("7-SEVEN", "7-seven")}


def test_batches_of_a_large_file(spark):
    rows = spark.range(3000).selectExpr("case when id < 2500 then 'hot' else concat('f', id % 7) end as file", "3000 - id as position", "id as other")
    got = split_batches(rows, 20).toPandas().sort_values(["file", "position"])
    assert len(got) == 3000
    for _, one in got.groupby("file"):
        assert one["batch"].tolist() == [i // 20 for i in range(len(one))]


def test_state_is_compacted(spark, tmp_path):
    folder = str(tmp_path / "state")
    put = lambda i, rows: st.upsert(spark.createDataFrame([(p, c, None) for p, c in rows], "path string, content string, modified timestamp").withColumn("modified", F.lit("2024-01-01").cast("timestamp")), i, folder, every=3)
    want = {}
    for i in range(8):
        rows = [("a", str(i)), (f"b{i}", "x")]
        put(i, rows)
        want |= dict(rows)
    put(7, rows)  # a batch that is run again
    hashes = {t: r for t, r in spark.createDataFrame([(t,) for t in set(want.values())], "t string").select("t", F.sha2("t", 256)).collect()}
    assert {r["path"]: r["hash"] for r in st.state(spark, folder).collect()} == {p: hashes[c] for p, c in want.items()}
    assert sorted(os.listdir(f"{folder}/batches")) == ["batch=6", "batch=7"] and os.listdir(f"{folder}/compacted") == ["upto=5"]


def test_paths_with_signs_of_patterns(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "x.py").write_text("1")
    (root / "y.py").write_text("2")
    assert {(r["path"], r["content"]) for r in scan(spark, str(root)).collect()} == {("sub/x.py", "1"), ("y.py", "2")}


def test_loops_leave_only_their_result(spark):
    written = lambda: {f"{d}/{n}" for d, names, _ in os.walk(scratch.scratch_dir(spark).removeprefix("file:")) for n in names if "-" in n}
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "root long")
    before = written()
    assert closure(edges, roots).count() == 12
    assert len(written() - before) <= 1
    before = written()
    assert connected_components(edges.toDF("a", "b")).count() == 13
    assert len(written() - before) <= 1


def test_components_that_do_not_settle_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def test_rounds_of_few_edges_take_few_tasks(spark, monkeypatch):
    """What a round writes goes by its edges, not by the session's number of partitions."""
    files, own = [], components.checkpoint
    monkeypatch.setattr(components, "checkpoint", lambda df: (files.append(len(own_files(out := own(df)))), out)[1])
    own_files = lambda table: [n for n in os.listdir(table.scratch_path.removeprefix("file:")) if n.startswith("part-")]
    edges = spark.createDataFrame([(i, i - i % 7) for i in range(300)] + [(0, 7)], "a long, b long")
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert got == {i: 0 if i < 14 else i - i % 7 for i in range(300)}
    assert len(files) >= 3 and max(files[1:]) <= spark.sparkContext.defaultParallelism
