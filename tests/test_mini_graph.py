"""Exact answers on a hand-made graph of a bakery, and on small graphs with cycles and odd edges."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom import graph
from codeloom.graph import SourceGraph
from codeloom.operators import closure as cl
from codeloom.operators import lookups as lk
from codeloom.operators import metrics as mt
from codeloom.operators import neighbours as nb
from codeloom.operators import reach as rc
from codeloom.operators.closure import closure, nearest_ancestors, shortest_paths, strong_components
from codeloom.schema import make_edge, make_node


@pytest.fixture(scope="module")
def g(spark):
    rows = [
        ("Package", "shop", "shop", "shop.src", "Public", False), ("Package", "oven", "shop.oven", "oven.src", "Public", False),
        ("Interface", "Baker", "shop.oven.Baker", "oven.src", "Public", True), ("Class", "Stove", "shop.oven.Stove", "oven.src", "Public", False), ("Class", "Counter", "shop.Counter", "shop.src", "Public", False),
        ("Field", "heat", "shop.oven.Stove.heat", "oven.src", "Private", False), ("Method", "bake", "shop.oven.Baker.bake", "oven.src", "Public", True), ("Method", "clean", "shop.oven.Baker.clean", "oven.src", "Public", True),
        ("Method", "bake", "shop.oven.Stove.bake", "oven.src", "Public", False), ("Method", "warm", "shop.oven.Stove.warm", "oven.src", "Private", False),
        ("Method", "serve", "shop.Counter.serve", "shop.src", "Public", False), ("Method", "refill", "shop.Counter.refill", "shop.src", "Public", False), ("Field", "stock", "shop.Counter.stock", "shop.src", "Private", False),
    ]
    nodes = [make_node(i, k, n, q, file=f, visibility=v, is_abstract=a, language="Java") for i, (k, n, q, f, v, a) in enumerate(rows)]
    links = [("Contains", a, b) for a, b in ((0, 1), (1, 2), (1, 3), (0, 4), (2, 6), (2, 7), (3, 5), (3, 8), (3, 9), (4, 10), (4, 11), (4, 12))]
    links += [("Implements", 3, 2), ("Overrides", 8, 6), ("Calls", 10, 8), ("Calls", 8, 9), ("Calls", 9, 8), ("Calls", 10, 11), ("Calls", 11, 10), ("Reads", 9, 5), ("Writes", 8, 5), ("Reads", 10, 12), ("Instantiates", 10, 3), ("HasType", 12, 3)]
    edges = [make_edge(i, k, a, b) for i, (k, a, b) in enumerate(links)]
    return SourceGraph.of_rows(spark, nodes, [*edges, make_edge(24, "Calls", 11, "lib.log", "External"), make_edge(25, "Extends", 4, "Base")])


def ids(spark, *values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def test_summary(g):
    counts = {(r["what"], r["kind"]): r["n"] for r in mt.summary(g).collect()}
    want = {"node": {"Package": 2, "Interface": 1, "Class": 2, "Field": 2, "Method": 6}, "edge": {"Contains": 12, "Calls": 6, "Implements": 1, "Overrides": 1, "Reads": 2, "Writes": 1, "Instantiates": 1, "HasType": 1, "Extends": 1}}
    assert counts == {(what, kind): n for what, kinds in want.items() for kind, n in kinds.items()}
    assert g.validate().count() == 0


def test_calls(spark, g):
    down = lambda depth=None: got(rc.downstream_calls(g, ids(spark, 10, name="root"), depth), "id")
    assert down() == [8, 9, 11] and down(1) == [8, 11] and down(0) == []
    assert got(rc.upstream_callers(g, ids(spark, 9, name="root")), "id") == [8, 10, 11]
    pairs = spark.createDataFrame([(11, 9), (9, 10), (10, 10)], "from_id long, to_id long")
    assert got(rc.call_path(g, pairs), "from_id", "to_id", "path") == [(10, 10, [10]), (11, 9, [11, 10, 8, 9])]
    assert got(mt.cycles(g, "Calls"), "id", "component") == [(8, 8), (9, 8), (10, 10), (11, 10)]


def test_types(spark, g):
    assert got(nb.implementors(g, ids(spark, 2)), "other") == [3]
    assert got(nb.overriders(g, ids(spark, 6)), "other") == [8]
    assert got(nb.what_overrides(g, ids(spark, 8, 6)), "id", "other") == [(8, 6)]
    assert got(mt.unimplemented_interface_methods(g, ids(spark, 3, 4)), "id", "other") == [(3, 7)]
    assert got(mt.usages_of_type(g, ids(spark, 3)), "other") == [10, 12]
    assert got(nb.public_api(g, ids(spark, 3, 4)), "id", "other") == [(3, 8), (4, 10), (4, 11)]
    assert got(nb.parent_of(g, ids(spark, 8, 1)), "id", "other") == [(1, 0), (8, 3)]
    assert got(nb.methods_of(g, ids(spark, 3)), "other") == [8, 9] and got(nb.fields_of(g, ids(spark, 3)), "other") == [5]
    assert got(nb.dependencies(g, ids(spark, 11)), "kind", "target") == [("Calls", "external:lib.log"), ("Calls", "shop.Counter.serve")]
    assert ("Extends", "unresolved:Base") in got(nb.dependencies(g, ids(spark, 4)), "kind", "target")


def test_metrics(spark, g):
    want = {i: (0, 0, None) for i in range(13)} | {2: (1, 0, 0.0), 3: (2, 1, 1 / 3), 8: (2, 1, 1 / 3), 9: (1, 1, 0.5), 10: (1, 3, 0.75), 11: (1, 1, 0.5), 12: (0, 1, 1.0)}
    assert {r["id"]: (r["afferent"], r["efferent"], r["instability"]) for r in mt.coupling(g).collect()} == want
    assert [(r["id"], r["incoming"]) for r in mt.hotspots(g, 20).collect()] == [(3, 3), (5, 3), (8, 3), (2, 2), (6, 2), (9, 2), (10, 2), (11, 2), (12, 2), (1, 1), (4, 1), (7, 1), (0, 0)]
    assert got(mt.lcom(g), "id", "lcom") == [(2, 1.0), (3, 0.0), (4, 1.0)]
    assert got(mt.unused_fields(g, ids(spark, 3, 4)), "other") == []
    assert got(mt.unused_fields(SourceGraph(g.nodes, g.edges.filter("kind <> 'Reads'")), ids(spark, 3, 4)), "id", "other") == [(4, 12)]
    assert got(mt.shared_dependencies(g, spark.createDataFrame([(10, 9), (8, 11)], "a long, b long")), "a", "b", "other") == [(10, 9, 8)]
    assert got(nb.coupling_between(g, spark.createDataFrame([(10, 11)], "a long, b long")), "edge_id") == [17, 18]


def test_reach(spark, g):
    assert got(mt.entry_points(g), "id") == [6, 7]
    assert got(rc.reachable_from(g, ids(spark, 10)), "id") == [3, 8, 9, 10, 11]
    assert got(rc.dead_code(g, ids(spark, 10)), "id") == [0, 1, 2, 4, 5, 6, 7, 12]
    impact = rc.change_impact(g, ids(spark, 5, 2, name="root"))
    assert got(impact, "root", "id") == [(2, 3), (2, 10), (2, 11), (2, 12), (5, 8), (5, 9), (5, 10), (5, 11)]
    assert got(rc.package_of(g), "id", "package_id") == [(i, 0 if i in (0, 4, 10, 11, 12) else 1) for i in range(13)]
    assert got(mt.package_dependency_graph(g), "from_package", "to_package", "n") == [("shop", "shop.oven", 2)]


def test_lookups(g):
    assert got(lk.nodes_in_file(g, "shop.src"), "id") == [0, 4, 10, 11, 12]
    assert got(lk.nodes_in_package(g, "shop.oven.S"), "id") == [3, 5, 8, 9]
    assert got(lk.search_nodes(g, "BAKE"), "id") == [2, 6, 7, 8]
    assert [r["id"] for r in lk.page(g.nodes, ["id"], 2, 3).collect()] == [2, 3, 4]
    assert got(lk.list_files(g), "file", "node_count") == [("oven.src", 8), ("shop.src", 5)]
    with pytest.raises(ValueError):
        lk.nodes_of_kind(g, "class")


def test_layers(spark):
    nodes = [make_node(0, "Method", "ctrl", "web.Ctrl.ctrl"), make_node(1, "Method", "svc", "svc.Svc.svc")]
    two = SourceGraph.of_rows(spark, nodes, [make_edge(0, "Calls", 0, 1), make_edge(1, "Calls", 1, 0)])
    assert got(mt.layer_violations(two, [["web."], ["svc."]]), "src", "dst", "from_layer", "to_layer") == [(1, 0, 1, 0)]
    assert mt.layer_violations(two, []).count() == 0


def adj(spark, *pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, edge_id long")


def test_components_with_loops_and_trees(spark):
    edges = adj(spark, (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (5, 10), (10, 10), (4, 5))
    assert got(strong_components(edges), "id", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (10, 10)]
    assert strong_components(adj(spark, (1, 2), (2, 3))).count() == 0


def test_closure_on_cycles_leaves_out_its_seed(spark):
    edges = adj(spark, (1, 2), (2, 1), (2, 3), (1, 1))
    assert got(closure(edges, ids(spark, 1, name="root")), "id", "depth") == [(2, 1), (3, 2)]
    assert closure(edges, ids(spark, 1, name="root").limit(0)).count() == 0


def test_paths_break_ties_by_edge_order(spark):
    edges = adj(spark, (1, 3), (1, 2), (2, 4), (3, 4), (4, 1))
    pairs = spark.createDataFrame([(1, 4), (1, 1), (4, 2), (1, 9)], "from_id long, to_id long")
    assert got(shortest_paths(edges, pairs), "path") == [[1], [1, 3, 4], [4, 1, 2]]


def test_chain_ends_where_it_comes_round(spark):
    nodes = [make_node(i, "Class", f"c{i}") for i in range(4)]
    g = SourceGraph.of_rows(spark, nodes, [make_edge(0, "Extends", 0, 1), make_edge(1, "Extends", 1, 0), make_edge(2, "Extends", 2, 3), make_edge(3, "Extends", 2, 1)])
    assert got(rc.superclass_chain(g, ids(spark, 0, 2, name="root")), "root", "position", "id") == [(0, 0, 1), (0, 1, 0), (2, 0, 3)]


def test_packages_nest_and_cycle(spark):
    nodes = [make_node(0, "Package", "a"), make_node(1, "Package", "b", "a.b"), *(make_node(i, "Class", f"c{i}") for i in range(2, 8))]
    links = [(0, 1), (0, 2), (1, 3), (3, 4), (6, 7), (7, 6)]
    edges = [make_edge(i, "Contains", a, b) for i, (a, b) in enumerate(links)] + [make_edge(10, "Calls", 2, 4), make_edge(11, "Calls", 4, 2), make_edge(12, "Calls", 4, 3), make_edge(13, "Extends", 2, 5)]
    g = SourceGraph.of_rows(spark, nodes, edges)
    assert got(rc.package_of(g), "id", "package_id") == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 1)]
    assert got(mt.package_dependency_graph(g), "from_package", "to_package", "n") == [("a", "a.b", 1), ("a.b", "a", 1)]
    assert got(mt.package_cycles(g), "package", "component") == [("a", "a"), ("a.b", "a")]
    far = spark.range(200).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    kinds = far.select("id", F.when(F.col("id") == 0, "Package").otherwise("Class").alias("kind"))
    assert nearest_ancestors(kinds, far.filter("parent is not null"), "kind = 'Package'").filter("ancestor = 0").count() == 200


def test_throws_in_all_target_states(spark):
    nodes = [make_node(i, "Method", f"m{i}") for i in range(6)] + [make_node(9, "Class", "Bad", "x.Bad")]
    edges = [make_edge(0, "Throws", 0, 9), make_edge(1, "Throws", 1, "lib.Bad", "External"), make_edge(2, "Throws", 2, "y::Bad"), make_edge(3, "Throws", 3, "NotBad"), make_edge(4, "Calls", 4, 1), make_edge(5, "Calls", 5, 4), make_edge(6, "Throws", 0, 9)]
    g = SourceGraph.of_rows(spark, nodes, edges)
    assert got(nb.methods_throwing(g, "Bad"), "id") == [0, 0, 1, 2]
    assert got(rc.exception_propagation(g, "Bad"), "id") == [0, 1, 2, 4, 5]
    wrong = SourceGraph(g.nodes, g.edges.unionByName(SourceGraph.of_rows(spark, [], [make_edge(7, "Calls", 0, 77), make_edge(8, "Calls", 88, 0)]).edges))
    assert got(wrong.validate(), "id", "problem") == [(7, "dangling"), (8, "source")]
    assert got(nb.dependencies(wrong, ids(spark, 0, 1, 2)), "id", "target") == [(0, "#77"), (0, "x.Bad"), (0, "x.Bad"), (1, "external:lib.Bad"), (2, "unresolved:y::Bad")]


def slow_components(edges):
    """(id, least id of its component) of nodes on a cycle, by reachability."""
    reach = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), [start]
        while todo:
            at = todo.pop()
            for a, b in edges:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[start] = seen
    return sorted((x, min(y for y in reach[x] if x in reach.get(y, ()))) for x in reach if x in reach[x])


def test_components_of_random_graphs_match_reachability(spark):
    """Chains, tails, loops and cycles within cycles, sparse and dense; several graphs side by side."""
    rows = []
    for seed in range(12):
        pick = random.Random(seed)
        n, m = 24, (16, 26, 40)[seed % 3]
        rows += [(seed * 100 + pick.randrange(n), seed * 100 + pick.randrange(n)) for _ in range(m)]
        rows += [(seed * 100 + 50 + i, seed * 100 + 50 + (i + 1) % 7) for i in range(7 - seed % 2)]
    assert got(strong_components(adj(spark, *rows)), "id", "component") == slow_components(rows)


def test_a_long_cycle_settles_in_a_few_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(cl, "checkpoint", lambda df, own=cl.checkpoint: (stored.append(1), own(df))[1])
    n = 10_000
    path = [(i, i + 1) for i in range(n)]
    closing = [(n, 0), (5000, 20_000), (30_000, 5000)] + [(20_000 + i, 20_001 + i) for i in range(3000)] + [(30_000 + i + 1, 30_000 + i) for i in range(3000)]
    members = strong_components(adj(spark, *path, *closing))
    assert members.count() == n + 1 and members.filter("component <> 0").count() == 0 and len(stored) < 80
    assert strong_components(adj(spark, *path)).count() == 0


def test_closure_keeps_many_roots_in_a_word(spark):
    """130 roots into a path of 10 nodes that ends in a cycle: all pairs with their depths, from a row for each node and 64 roots."""
    from codeloom.operators.closure import reached_words

    edges = spark.createDataFrame([(1000 + r, r % 3, r) for r in range(130)] + [(i, i + 1, 500 + i) for i in range(9)] + [(9, 8, 600)], "src long, dst long, edge_id long")
    roots = spark.createDataFrame([(1000 + r,) for r in range(130)], "root long").coalesce(1)
    want = {(1000 + r, i, i - r % 3 + 1) for r in range(130) for i in range(r % 3, 10)}
    found = closure(edges, roots)
    assert {(x["root"], x["id"], x["depth"]) for x in found.collect()} == want and found.count() == len(want)
    words = spark.createDataFrame([(7, 0, -1)], "id long, w long, bits long")
    assert reached_words(spark.createDataFrame([(7, 8)], "src long, dst long"), words, None).count() == 2
    paths = shortest_paths(edges, spark.createDataFrame([(1002, 9), (9, 9), (3, 1)], "from_id long, to_id long"))
    assert sorted(x["path"] for x in paths.collect()) == [[9], [1002, *range(2, 10)]]


def test_a_row_of_a_closure_stands_for_a_thousand_roots(spark, monkeypatch):
    pick = random.Random(5)
    edges = [(i, 5000 + i % 7) for i in range(2100)] + [(5000 + i, 6000 + pick.randrange(5)) for i in range(7)] + [(6000 + i, 6000 + (i + 1) % 5) for i in range(5)]
    adj = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    stored = []
    monkeypatch.setattr(cl, "reached_words", lambda *a, own=cl.reached_words: (stored.append(own(*a)), stored[-1])[1])
    out = {(r["root"], r["id"]): r["depth"] for r in closure(adj, spark.createDataFrame([(i,) for i in range(2100)], "root long").repartition(3)).collect()}
    steps, want = {}, {}
    for a, b in edges:
        steps.setdefault(a, set()).add(b)
    for root in range(2100):
        seen, last, depth = {root}, {root}, 0
        while last:
            depth += 1
            last = {b for a in last for b in steps.get(a, ())} - seen
            want |= {(root, b): depth for b in last}
            seen |= last
    assert out == want
    # 33 words of 64 roots would be as many rows for each node and distance.
    assert stored[0].filter("id >= 5000").groupBy("id", "depth").count().agg({"count": "max"}).first()[0] == 3


def test_only_parents_are_followed_to_their_ancestors(spark, monkeypatch):
    kinds = spark.createDataFrame([(0, "Package"), *((i, "Class") for i in range(1, 4)), *((i, "Method") for i in range(10, 310)), (400, "Class")], "id long, kind string")
    parents = spark.createDataFrame([(1, 0), (2, 1), (3, 0), *((i, 1 + i % 3) for i in range(10, 310))], "id long, parent long")
    counts = []

    def counted(df, own=cl.checkpoint):
        rows = own(df)
        counts.append(rows.count())
        return rows

    monkeypatch.setattr(cl, "checkpoint", counted)
    found = got(nearest_ancestors(kinds, parents, "kind = 'Package'"), "id", "ancestor")
    assert found == [(i, 0) for i in (0, 1, 2, 3, *range(10, 310))]
    assert counts[0] == 304 and max(counts[1:]) <= 4


@pytest.mark.parametrize("name", ["fields_of", "lcom"])
def test_joins_are_dealt_by_nodes_and_edges(spark, monkeypatch, name):
    """Rows beyond the session's partitions get more tasks, and the rows found stay the same."""
    nodes = [make_node(1, "Class", "A"), *(make_node(i, "Method", f"m{i}") for i in range(10, 40)), *(make_node(i, "Field", f"f{i}") for i in range(50, 60))]
    held = [(1, i) for i in (*range(10, 40), *range(50, 60))]
    reads = [(i, 50 + i % 7) for i in range(10, 40)]
    edges = [make_edge(i, kind, *ends) for i, (kind, ends) in enumerate([("Contains", e) for e in held] + [("Reads", e) for e in reads])]
    g = SourceGraph.of_rows(spark, nodes, edges)
    run = {"fields_of": lambda: nb.fields_of(g, g.nodes), "lcom": lambda: mt.lcom(g)}[name]
    want = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(graph, "JOIN_ROWS", 5)
    many = g.tasks(*(("Contains",) if name == "fields_of" else ("Contains", "Reads", "Writes")))
    found = run()
    assert sorted(map(tuple, found.collect())) == want and want and many > 8
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert len(re.findall(rf"hashpartitioning\([^)]*, {many}\), REPARTITION_BY_NUM", plan)) >= 4
