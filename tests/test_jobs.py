"""Ingest, enrichment, memory, tools, streaming and text helpers on small inputs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.graph import SourceGraph
from codeloom.jobs import enrich as en
from codeloom.jobs import ingest as ig
from codeloom.jobs import memory as mm
from codeloom.jobs import tools as tl
from codeloom.schema import make_edge, make_node
from codeloom.streaming import ingest as st
from tests.test_mini_graph import g, got, ids  # noqa: F401


def tree(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_walk_skips_hidden_ignored_and_unknown(spark):
    files = tree(
        spark,
        ("A.java", "a"), ("b/B.RS", "b"), ("b/.hidden/C.py", "c"), (".d.py", "d"), ("node_modules/x.ts", "x"), ("e.txt", "e"), ("empty.go", ""),
        (".gitignore", "build/\n*.gen.go\n# note\n!keep.gen.go\n/top.py\nlogs/**/x.py\n"), ("build/F.java", "f"), ("sub/build/G.java", "g"), ("h.gen.go", "h"), ("keep.gen.go", "k"),
        ("top.py", "t"), ("sub/top.py", "t"), ("logs/x.py", "l"), ("logs/a/b/x.py", "l"), ("logs/a/y.py", "l"),
        ("sub/.gitignore", "*.ts\n!ok.ts\r\n"), ("sub/p.ts", "p"), ("sub/ok.ts", "o"), ("q.ts", "q"),
        ("deep/.gitignore", "!h2.gen.go\n"), ("deep/h2.gen.go", "h"),
    )
    assert got(ig.walk(files), "path") == sorted(["A.java", "b/B.RS", "keep.gen.go", "sub/top.py", "logs/a/y.py", "sub/ok.ts", "q.ts"])


def test_diff_and_rebuild(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert got(ig.hash_diff(old, new), "path", "status") == [("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "added")]
    assert got(ig.hash_diff(old, new, rebuild=True), "status") == ["added"] * 3


def test_ids_are_gapless_and_stable(spark):
    rows = spark.range(500).selectExpr("concat('f', id % 17) as file", "id as ordinal")
    one = ig.assign_ids(rows, base=100)
    assert got(one, "id") == list(range(100, 600))
    assert got(one, "file", "ordinal", "id") == got(ig.assign_ids(rows.repartition(5), base=100), "file", "ordinal", "id")
    assert one.orderBy("id").filter("file = 'f3'").toPandas()["ordinal"].is_monotonic_increasing


def test_resolve_remove_and_sticky(spark):
    nodes = [make_node(0, "Class", "A", file="a"), make_node(1, "Class", "B", file="b"), make_node(2, "Class", "B", file="c")]
    edges = [make_edge(0, "Calls", 0, "B"), make_edge(1, "Calls", 0, "None"), make_edge(2, "Calls", 1, 0)]
    first = ig.resolve(SourceGraph.of_rows(spark, nodes, edges))
    assert got(first.edges, "id", "to_state", "to_id", "to_name") == [(0, "Resolved", 2, None), (1, "External", None, "None"), (2, "Resolved", 0, None)]
    gone = ig.remove_files(first, spark.createDataFrame([("c",), ("b",)], "path string"))
    assert got(gone.nodes, "id") == [0] and got(gone.edges, "id", "to_state", "to_name") == [(0, "Unresolved", "B"), (1, "External", "None")]
    late = SourceGraph(first.nodes.unionByName(SourceGraph.of_rows(spark, [make_node(3, "Class", "None", file="d")], []).nodes), first.edges)
    assert got(ig.resolve(late).edges.filter("id = 1"), "to_state") == ["Resolved"]
    assert got(ig.resolve(late, sticky=True).edges.filter("id = 1"), "to_state") == ["External"]


def test_flags_tasks_and_commit(spark):
    span = lambda a, b: (a, 0, b, 0)
    nodes = [make_node(0, "Class", "Shop", file="s.py", span=span(0, 2)), make_node(1, "Method", "test_x", "Shop.test_x", file="s.py", span=span(1, 1)), make_node(2, "Parameter", "p", file="s.py"), make_node(3, "Class", "Tester", file="/x/tests/t.py", span=span(0, 0)), make_node(4, "Class", "Test", file="u.py", span=span(9, 12))]
    marked = ig.mark_tests(SourceGraph.of_rows(spark, nodes, []).nodes)
    assert got(marked.filter("is_test"), "id") == [1, 3, 4]
    files = tree(spark, ("s.py", "one\ntwo\nthree"), ("u.py", "x"))
    tasks = {r["file"]: r for r in ig.description_tasks(files, marked).collect()}
    assert tasks["s.py"]["snippets"] == {"Shop": "one\ntwo\nthree", "Shop.test_x": "two"} and tasks["s.py"]["is_test_schema"] == {"Shop": None, "Shop.test_x": True}
    assert tasks["u.py"]["snippets"] == {"Test": ""}
    assert ig.description_tasks(files, marked, compat=True).filter("file = 's.py'").first()["snippets"] == {"Shop": "one\ntwo", "Shop.test_x": "one"}
    texts = spark.createDataFrame([("Shop", "sells"), ("Shop.test_x", ""), ("None", "n")], "qualified_name string, description string")
    flags = spark.createDataFrame([("Shop.test_x", False)], "qualified_name string, is_test boolean")
    done = {r["id"]: (r["description"], r["is_test"]) for r in ig.commit_descriptions(marked, texts, flags).collect()}
    assert done[0] == ("sells", False) and done[1] == (None, False) and done[3] == (None, True)


def test_graph_round_trips(spark, g):  # noqa: F811
    lines = ig.yaml_lines(g)
    yaml = pytest.importorskip("yaml")
    text = "\n".join(r["line"] for r in lines.orderBy("section", "id").collect())
    assert len(yaml.safe_load(text)["nodes"]) == 13 and yaml.safe_load(text)["edges"][23]["kind"] == "HasType"
    again = ig.from_yaml_lines(lines)
    assert sorted(map(repr, again.edges.collect())) == sorted(map(repr, g.edges.collect()))
    assert sorted(map(repr, again.nodes.drop("metadata").collect())) == sorted(map(repr, g.nodes.drop("metadata").collect()))
    with pytest.raises(Exception):
        ig.from_yaml_lines(spark.createDataFrame([("nodes", "- {broken")], "section string, line string")).nodes.collect()


def test_text_helpers(spark):
    paths = {"a_test.go": True, "test_a.py": True, "a_test.py": True, "a.test.ts": True, "a.spec.tsx": True, "FooTest.java": True, "FooIT.java": True, "tests/x.rs": False, "/tests/x.rs": True, "a/__tests__/b.ts": True, "latest.py": False, "Testing.java": False}
    df = spark.createDataFrame(list(paths.items()), "p string, want boolean")
    assert df.filter(tx.is_test_file(F.col("p")) != F.col("want")).count() == 0
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], list(v)).select(c.alias("x")).first()["x"]
    assert one(tx.title_slug(F.col("t")), t="intro\n# My Big, Title!\n# no") == "my-big-title" and one(tx.title_slug(F.col("t")), t="x") == "feature"
    assert one(tx.strip_preamble(F.col("t")), t="hello\nthere\n# T\nx") == "# T\nx" and one(tx.strip_preamble(F.col("t")), t="# T\n# U") == "# T\n# U" and one(tx.strip_preamble(F.col("t")), t="none") == "none"
    calls = one(tx.text_tool_calls(F.col("t")), t="a <function=f><parameter=x> 1 </parameter><parameter=y\n2\n</parameter></function></tool_call> b <function=g></function>")
    assert [(c["name"], c["arguments"]) for c in calls] == [("f", {"x": "1", "y": "2"}), ("g", {})]
    assert one(tx.without_tool_calls(F.col("t")), t="a <function=f>x</function></tool_call> b") == "a  b"
    assert one(tx.visibility_from_modifiers(F.col("t")), t="static private protected") == "Protected"
    assert one(tx.go_visibility(F.col("t")), t="Éa") == "Public" and one(tx.go_visibility(F.col("t")), t="ea") == "Internal"
    assert one(tx.qualify(F.col("s"), F.col("n"), "::"), s="a", n="b") == "a::b" and one(tx.qualify(F.col("s"), F.col("n")), s="", n="b") == "b"
    assert one(tx.extension(F.col("t")), t="a/b.TSX") == "tsx" and one(tx.extension(F.col("t")), t="a.b/c") == ""


def test_answers_are_parsed_as_asked(spark):
    cases = {
        '{"descriptions": {"a": " x ", "b": " ", "z": "q"}, "is_test": {"a": true, "b": "yes"}}': ({"a": "x"}, ["b"], {"a": True}),
        '{"a": "flat", "b": "both"}': ({"a": "flat", "b": "both"}, [], {}),
        "[1]": None, "3": None, "not json": None, "": None, "{}": ({}, ["a", "b"], {}),
    }
    df = spark.createDataFrame([(k, ["a", "b"]) for k in cases], "answer string, wanted array<string>")
    for r in df.select("answer", en.parse_answer(F.col("answer"), F.col("wanted")).alias("p")).collect():
        assert (None if r["p"] is None else (r["p"]["filled"], r["p"]["missing"], r["p"]["flags"])) == cases[r["answer"]], r["answer"]


def test_enrichment_retries_what_is_missing(spark):
    rows = [("f", i, f"f.n{i}", f"code {i}", True if i == 0 else None) for i in range(45)]
    entities = spark.createDataFrame(rows, "file string, position long, name string, snippet string, known boolean")
    assert got(en.split_batches(entities).groupBy("batch").count(), "batch", "count") == [(0, 20), (1, 20), (2, 5)]

    def model(prompts):
        out = []
        for p in prompts:
            names = [x.split("\n")[0] for x in p.split("### ")[1:]]
            out.append(json.dumps({"descriptions": dict.fromkeys(names[: max(1, len(names) // 2)], "does"), "is_test": {names[0]: False}}))
        return out

    texts, flags = en.enrich(entities, model)
    assert texts.count() == (10 + 10 + 2) + (10 + 1) + 6
    assert texts.select("qualified_name").distinct().count() == texts.count() and flags.count() >= 3


def chat(spark, *sizes):
    roles = ["system", "user", "assistant", "tool"]
    return spark.createDataFrame([(1, i, roles[i % 4] if i else "system", "é" * (n // 2)) for i, n in enumerate(sizes)], "conv_id long, turn long, role string, text string")


def test_memory(spark):
    assert mm.should_compress(chat(spark, 100, 100, 100), 0).first()["compress"] is False
    eleven = chat(spark, *[20] * 11)
    row = mm.should_compress(eleven, 100).first()
    assert (row["n"], row["chars"], row["compress"]) == (11, 220, True)
    assert mm.compression_boundary(eleven).first()["boundary"] == 7  # 8 of 20 bytes: 112 of 160 are reached by the sixth
    assert mm.compression_boundary(chat(spark, 10, 10, 10)).count() == 0 and mm.compression_boundary(chat(spark, 10, 10, 10, 10)).first()["boundary"] == 2
    folded = mm.apply_compression(eleven, spark.createDataFrame([(1, "sum")], "conv_id long, summary string")).orderBy("turn").collect()
    assert len(folded) == 6 and folded[1]["role"] == "user" and folded[1]["text"] == "[Summary of the 6 messages before this one]\n\nsum"
    text = mm.transcripts(eleven).first()["transcript"]
    assert text.startswith("[User]: " + "é" * 10 + "\n\n[Assistant]: ") and "[Tool result]: " in text
    names = {"gpt-4.1-mini": 1_047_576, "GPT-4o": 128_000, "o3": 200_000, "claude-sonnet-4-5": 1_000_000, "claude-3": 200_000, "gemini-2.0": 1_048_000, "mixtral": 32_000, "phi4": 16_000, "other": 128_000}
    df = spark.createDataFrame(list(names.items()), "m string, want int")
    assert df.filter(mm.context_window(F.col("m")) != F.col("want")).count() == 0
    assert spark.range(1).select(mm.compression_threshold(F.lit(128_000)).alias("t")).first()["t"] == 256_000


def answer(graph, name, **args):
    return json.loads(tl.call(graph, name, json.dumps(args)).first()["answer"])


def test_tools(spark, g):  # noqa: F811
    assert len(tl.TOOLS) == 51
    page = answer(g, "get_callees", qualified_name="shop.Counter.serve", limit=2)
    assert [i["id"] for i in page["items"]] == [8, 9] and (page["total"], page["returned"], page["has_more"]) == (3, 2, True)
    assert [i["id"] for i in answer(g, "get_callees", qualified_name="shop.Counter.serve", depth=1)["items"]] == [8, 11]
    assert [i["id"] for i in answer(g, "get_hotspots", limit=3, offset=1)["items"]] == [5, 8, 2]
    assert answer(g, "get_callers") == {"error": "missing 'qualified_name' parameter"} and answer(g, "get_callers", qualified_name="x") == {"error": "node not found: x"}
    assert answer(g, "nothing") == {"error": "unknown tool: nothing"} and "error" in answer(g, "find_nodes_by_kind", kind="method")
    coupling = answer(g, "get_coupling", qualified_name="shop.oven.Stove.warm")
    assert (coupling["afferent"], coupling["efferent"], coupling["instability"]) == (1, 1, 0.5)
    assert answer(g, "get_call_path", **{"from": "shop.Counter.refill", "to": "shop.oven.Stove.warm"}) == {"path": [11, 10, 8, 9]}
    assert answer(g, "get_cohesion", qualified_name="shop.Counter")["lcom"] == 1.0
    assert answer(g, "get_graph_summary")["total_edges"] == 26
    assert answer(g, "list_files")["items"] == [{"file": "oven.src", "node_count": 8}, {"file": "shop.src", "node_count": 5}]
    assert tl.arguments("{bad") == {} and tl.whole({"n": -1}, "n", 5) == 5 and tl.whole({"n": "3"}, "n", 5) == 5
    files = tree(spark, ("A.java", "1\n2\n3\n4"))
    assert json.loads(tl.call(g, "get_file_source", json.dumps({"file": "A.java", "start_line": 2, "end_line": 3}), files).first()["answer"])["source"] == "2\n3"


@pytest.mark.parametrize("name", sorted(tl.TOOLS))
def test_every_tool_answers(spark, g, name):  # noqa: F811
    given = {"qualified_name": "shop.oven.Stove", "file": "A.java", "kind": "Class", "query": "bake", "package_prefix": "shop", "attribute": "x", "exception_name": "E", "from": "shop.Counter", "to": "shop.Counter", "qualified_name_a": "shop.Counter", "qualified_name_b": "shop.oven.Stove"}
    args = {k: given[k] for k in tl.TOOLS[name].required}
    rows = tl.call(g, name, json.dumps(args), tree(spark, ("A.java", "x"))).collect()
    assert all(json.loads(r["answer"]) is not None and "error" not in r["answer"] for r in rows)


def test_stream_upserts_and_sees_deletions_by_listing(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda rows, t: spark.createDataFrame([(p, c, datetime.fromisoformat(t)) for p, c in rows], "path string, content string, modified timestamp").coalesce(1).write.mode("append").parquet(source)
    put([("a", "1"), ("b", "1")], "2024-01-01")
    st.watch(spark, source, folder, str(tmp_path / "c")).awaitTermination()
    put([("b", "2"), ("c", "1"), ("a", "1")], "2024-01-02")
    st.watch(spark, source, folder, str(tmp_path / "c")).awaitTermination()
    now = {r["path"]: r["hash"] for r in st.state(spark, folder).collect()}
    assert now["b"] == spark.range(1).select(F.sha2(F.lit("2"), 256).alias("h")).first()["h"] and set(now) == {"a", "b", "c"}
    assert spark.read.parquet(f"{folder}/batches/batch=1").count() == 2
    assert got(st.deleted(spark, folder, tree(spark, ("a", "1"), ("b", "2"))), "path") == ["c"]


def test_repeated_keys_end_no_job(spark):
    """Texts of a model, and entities of a file, may name a thing twice; the last value counts."""
    from codeloom.functions.text import text_tool_calls
    from codeloom.jobs.enrich import build_prompt, enrich, parse_answer

    text = "<function=f>\n<parameter=a>1</parameter><parameter=b>x</parameter><parameter=a>\n2 </parameter></function><function=g></function>"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(text_tool_calls(F.col("t")).alias("c")).collect()
    assert [(c["name"], c["arguments"]) for c in rows[0]["c"]] == [("f", {"a": "2", "b": "x"}), ("g", {})] and not rows[1]["c"] and rows[2]["c"] == []

    kind = "array<struct<name:string,snippet:string,known:boolean>>"
    given = [([("C.f", "one", None), ("C.f", "two", True), (None, "z", None), ("C.g", None, None)],), ([],), (None,)]
    prompts = [r["p"] for r in spark.createDataFrame(given, f"e {kind}").select(build_prompt(F.lit("f.java"), F.col("e")).alias("p")).collect()]
    assert prompts[0].count("### C.f") == 2 and '{"C.f":"","C.g":""}' in prompts[0] and '["C.f","C.g"]' in prompts[0] and "### " not in prompts[1]

    answers = [
        '{"descriptions": {"a": "old", "a": "new"}, "is_test": {"a": false, "a": true}}', '{"descriptions": {"a": "x"}, "descriptions": {"b": "y"}}', '{"a": "flat", "a": "last"}',
        '{"a": 1} trailing', '{"a": 1}, {"b": 2}', "[]", "null", "", None, '{"descriptions": null}', '{"descriptions": "text"}', '{"a": {"b": 1}}', "{", "{}",
    ]
    wanted = spark.createDataFrame([(i, a, ["a", "b", "a", None]) for i, a in enumerate(answers)], "i int, answer string, wanted array<string>")
    got = {r["i"]: r["p"] for r in wanted.select("i", parse_answer(F.col("answer"), F.col("wanted")).alias("p")).collect()}
    assert got[0]["filled"] == {"a": "new"} and got[0]["flags"] == {"a": True} and "b" in got[0]["missing"]
    assert got[1]["filled"] == {"b": "y"} and got[2]["filled"] == {"a": "last"}
    assert all(got[i] is None for i in (3, 4, 5, 6, 7, 8, 12))
    assert got[9]["filled"] == {} and got[10]["filled"] == {} and got[13]["filled"] == {}

    entities = spark.createDataFrame([("f.java", i, n, "s", None) for i, n in enumerate(["C.f", "C.f", "C.g"])], "file string, position int, name string, snippet string, known boolean")
    texts, flags = enrich(entities, lambda prompts: ['{"descriptions": {"C.f": "first", "C.f": "both", "C.g": "g"}, "is_test": {"C.g": true, "C.g": false}}' for _ in prompts])
    assert {tuple(r) for r in texts.collect()} == {("C.f", "both"), ("C.g", "g")} and {tuple(r) for r in flags.collect()} == {("C.g", False)}


def test_plain_lists_are_whole_or_fail(spark, g, monkeypatch):  # noqa: F811
    name = next(n for n, t in sorted(tl.TOOLS.items()) if t.shape == "array")
    args = json.dumps({k: {"qualified_name": "shop.oven.Stove", "kind": "Class", "query": "o"}.get(k, "shop.oven.Stove") for k in tl.TOOLS[name].required})
    every = tl.found(g, name, args).count()
    assert len(json.loads(tl.call(g, name, args).first()["answer"])) == every
    monkeypatch.setattr(tl, "ARRAY_LIMIT", every - 1)
    if every:
        assert "more than" in json.loads(tl.call(g, name, args).first()["answer"])["error"]
        assert len(json.loads(tl.call(g, name, json.dumps(json.loads(args) | {"limit": every})).first()["answer"])) == every
    with pytest.raises(ValueError, match="unknown tool"):
        tl.found(g, "no_tool")


def test_removed_nodes_are_stored_before_edges_meet_them(spark):
    """A few removed nodes go to the tasks by their stored size; the edges aren't shuffled for them."""
    from codeloom.graph import SourceGraph
    from codeloom.jobs.ingest import remove_files

    nodes = spark.range(10).selectExpr("id", "concat('n', id) qualified_name", "concat('f', id % 2) file")
    edges = spark.range(9).selectExpr("id", "'Calls' kind", "id src", "'Resolved' to_state", "id + 1 to_id", "cast(null as string) to_name")
    left = remove_files(SourceGraph(nodes, edges), spark.createDataFrame([("f1",)], "path string"))
    assert {(r["src"], r["to_name"]) for r in left.edges.collect()} == {(i, f"n{i + 1}") for i in range(0, 9, 2)}
    plan = left.edges._jdf.queryExecution().executedPlan().toString()
    assert "/gone-" in plan and plan.count("BroadcastHashJoin") >= 2
