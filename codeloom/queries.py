"""Registered queries of the graph operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import is_test_file, source_lines, text_tool_calls
from codeloom.graph import SourceGraph
from codeloom.jobs import memory
from codeloom.jobs.enrich import build_prompt, parse_answer, split_batches
from codeloom.jobs.extract import extract
from codeloom.jobs.features import next_folders
from codeloom.jobs.index import empty_graph, update
from codeloom.jobs.ingest import assign_ids, commit_descriptions, description_tasks, hash_diff, remove_files, resolve, walk
from codeloom.operators import lookups as lk
from codeloom.operators import metrics as mt
from codeloom.operators import neighbours as nb
from codeloom.operators import reach as rc
from codeloom.sources import name_index
from codeloom.sources.graphs import ONE_KIND, activity, commerce, contracts, corpus, library, polyglot_sources, references, shop_sources
from codeloom.sources.scratch import doom, scratch_path
from codeloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

SQL_COMMERCE = """
WITH nodes AS (
  SELECT CAST(r_regionkey AS BIGINT) * 8 AS id, 'Package' AS kind, r_name AS name, r_name AS qualified_name, 'world.src' AS file, 'Public' AS visibility, false AS is_test, CAST([] AS VARCHAR[]) AS attributes FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, 'Package', n_name, 'nation.' || n_name, 'world.src', 'Public', false, [] FROM nation
  UNION ALL SELECT c_custkey * 8 + 2, 'Class', c_name, 'customer.' || c_nationkey || '.' || c_name, 'customer' || c_nationkey || '.src', 'Public', false, [c_mktsegment] FROM customer
  UNION ALL SELECT s_suppkey * 8 + 3, 'Class', s_name, 'supplier.' || s_nationkey || '.' || s_name, 'supplier' || s_nationkey || '.src', 'Public', false, [] FROM supplier
  UNION ALL SELECT o_orderkey * 8 + 4, 'Method', 'o' || o_orderkey, 'order.' || o_orderkey, 'orders' || (o_orderkey % 1000) || '.src', CASE WHEN o_orderstatus = 'F' THEN 'Public' ELSE 'Private' END, starts_with(o_orderpriority, '5'), [] FROM orders
  UNION ALL SELECT p_partkey * 8 + 5, 'Field', p_name, 'part.' || p_partkey, 'parts' || (p_partkey % 100) || '.src', 'Private', false, [] FROM part
), contains AS (
  SELECT CAST(n_regionkey AS BIGINT) * 8 AS src, CAST(n_nationkey AS BIGINT) * 8 + 1 AS dst FROM nation
  UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 8 + 1, c_custkey * 8 + 2 FROM customer
  UNION ALL SELECT CAST(s_nationkey AS BIGINT) * 8 + 1, s_suppkey * 8 + 3 FROM supplier
  UNION ALL SELECT o_custkey * 8 + 2, o_orderkey * 8 + 4 FROM orders
  UNION ALL SELECT min(l_suppkey) * 8 + 3, l_partkey * 8 + 5 FROM lineitem GROUP BY l_partkey
), edges AS (
  SELECT dst * 8 AS edge_id, 'Contains' AS kind, src, dst FROM contains
  UNION ALL SELECT (l_orderkey * 16 + l_linenumber) * 8 + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END, CASE WHEN l_returnflag = 'N' THEN 'Reads' ELSE 'Writes' END, l_orderkey * 8 + 4, l_partkey * 8 + 5 FROM lineitem
  UNION ALL SELECT (l_orderkey * 16 + l_linenumber) * 8 + 3, 'Instantiates', l_orderkey * 8 + 4, l_suppkey * 8 + 3 FROM lineitem
)
"""


def sql_activity(kinds: dict[str, str], upward: bool = False, dangling: bool = False) -> str:
    """``links`` are all edges, ``edges`` the resolved ones, of the graph that ``activity`` derives."""
    src, dst = ("least(u, v)", "greatest(u, v)") if upward else ("u", "v")
    dst = f"CASE WHEN event_type = 'signup' THEN -1 - {dst} ELSE {dst} END" if dangling else dst
    kind = f"CASE event_type {' '.join(f"WHEN '{t}' THEN '{k}'" for t, k in kinds.items())} END"
    kind = f"CASE WHEN u = v AND event_type <> 'error' THEN 'References' ELSE {kind} END" if upward else kind
    return f"""
WITH RECURSIVE nodes AS (SELECT DISTINCT user_id AS id, 'user' || user_id AS qualified_name, CASE WHEN user_id % 2 = 0 THEN 'Public' ELSE 'Private' END AS visibility FROM events),
stepped AS (SELECT event_id, event_type, user_id AS u, lead(user_id) OVER (ORDER BY ts, event_id) AS v FROM events),
links AS (SELECT event_id AS edge_id, {kind} AS kind, u, v, CASE WHEN v IS NULL THEN 'unresolved' WHEN event_type = 'error' THEN 'external' ELSE 'resolved' END AS state, {src} AS src, {dst} AS dst FROM stepped),
edges AS (SELECT edge_id, kind, src, dst FROM links WHERE state = 'resolved')
"""


#: The query set of searches: users whose id is divisible by 50. All other queries ask for every node.
ROOTS = "id % 50 = 0"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def on_commerce(name: str, make: Callable, sql: str) -> None:
    add(name, lambda spark, d: make(commerce(spark, d)), SQL_COMMERCE + sql)


def on_activity(name: str, make: Callable, sql: str, kind: str = "Calls", kinds: dict[str, str] | None = None, upward: bool = False, dangling: bool = False) -> None:
    """A query of the event graph; ``{k}`` in its SQL is the kind asked for."""
    of_type = kinds or {t: k or kind for t, k in ONE_KIND.items()}
    add(name, lambda spark, d: make(activity(spark, d, kinds=of_type, upward=upward, dangling=dangling)), sql_activity(of_type, upward, dangling) + sql.replace("{k}", kind))


def seeds(g) -> DataFrame:
    return g.nodes.filter(ROOTS).select("id")


def roots(g) -> DataFrame:
    return seeds(g).withColumnRenamed("id", "root")


def every(g) -> DataFrame:
    return g.nodes.select(F.col("id").alias("root"))


def short(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "qualified_name")


# Filters and listings.
on_commerce("nodes_of_kind", lambda g: short(lk.nodes_of_kind(g, "Class")), "SELECT id, kind, qualified_name FROM nodes WHERE kind = 'Class'")
on_commerce("nodes_of_kind_no_tests", lambda g: short(lk.nodes_of_kind_no_tests(g, "Method")), "SELECT id, kind, qualified_name FROM nodes WHERE kind = 'Method' AND NOT is_test")
on_commerce("test_nodes_of_kind", lambda g: short(lk.test_nodes_of_kind(g, "Method")), "SELECT id, kind, qualified_name FROM nodes WHERE kind = 'Method' AND is_test")
on_commerce("search_nodes", lambda g: short(lk.search_nodes(g, "CUSTOMER.1")), "SELECT id, kind, qualified_name FROM nodes WHERE contains(lower(name), 'customer.1') OR contains(lower(qualified_name), 'customer.1')")
on_commerce("nodes_in_package", lambda g: short(lk.nodes_in_package(g, "supplier.1")), "SELECT id, kind, qualified_name FROM nodes WHERE starts_with(qualified_name, 'supplier.1')")
on_commerce("nodes_in_file", lambda g: short(lk.nodes_in_file(g, "customer7.src")), "SELECT id, kind, qualified_name FROM nodes WHERE file = 'customer7.src'")
on_commerce("nodes_with_attribute", lambda g: short(lk.nodes_with_attribute(g, "BUILDING")), "SELECT id, kind, qualified_name FROM nodes WHERE list_contains(attributes, 'BUILDING')")
on_commerce("list_files", lk.list_files, "SELECT file, count(*) AS node_count FROM nodes GROUP BY file")
on_commerce("find_page", lambda g: lk.page(short(lk.nodes_of_kind(g, "Field")), ["id"], offset=100, limit=50), "SELECT id, kind, qualified_name FROM nodes WHERE kind = 'Field' ORDER BY id LIMIT 50 OFFSET 100")
on_commerce("node_summary", lambda g: lk.node_summary(g.nodes), "SELECT id, kind, name, qualified_name, file, visibility, is_test FROM nodes")

# Counts.
on_commerce("graph_summary", mt.summary, "SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
on_commerce("test_split", mt.test_split, "SELECT count(*) FILTER (NOT is_test) AS production, count(*) FILTER (is_test) AS test FROM nodes")

# One hop. Every edge is a row.
OUT = "SELECT src AS id, dst AS other, edge_id FROM edges WHERE kind = '{k}'"
IN = "SELECT dst AS id, src AS other, edge_id FROM edges WHERE kind = '{k}'"
for name, make, form, kind in (
    ("readers_of", nb.readers_of, IN, "Reads"), ("writers_of", nb.writers_of, IN, "Writes"),
    ("fields_read_by", nb.fields_read_by, OUT, "Reads"), ("fields_written_by", nb.fields_written_by, OUT, "Writes"),
    ("instantiators", nb.instantiators, IN, "Instantiates"), ("types_instantiated_by", nb.types_instantiated_by, OUT, "Instantiates"),
):
    on_commerce(name, lambda g, make=make: make(g, g.nodes), form.format(k=kind))
on_commerce("parent_of", lambda g: nb.parent_of(g, g.nodes), "SELECT dst AS id, arg_max(src, edge_id) AS other FROM edges WHERE kind = 'Contains' GROUP BY dst")
CHILD = "SELECT e.src AS id, e.dst AS other, e.edge_id FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.kind = 'Contains' AND {c}"
on_commerce("methods_of", lambda g: nb.methods_of(g, g.nodes), CHILD.format(c="n.kind = 'Method'"))
on_commerce("fields_of", lambda g: nb.fields_of(g, g.nodes), CHILD.format(c="n.kind IN ('Field', 'StaticField', 'Constant')"))
on_commerce("public_api", lambda g: nb.public_api(g, g.nodes), CHILD.format(c="n.visibility = 'Public'"))
on_activity("dependencies", lambda g: nb.dependencies(g, g.nodes), """
SELECT l.u AS id, l.edge_id, l.kind, CASE WHEN state = 'resolved' THEN coalesce(n.qualified_name, '#' || l.dst) ELSE state || ':lib.user' || coalesce(CAST(v AS VARCHAR), '') END AS target
FROM links l LEFT JOIN nodes n ON n.id = l.dst""", dangling=True)
on_activity("dependents", lambda g: nb.dependents(g, g.nodes), "SELECT e.dst AS id, e.edge_id, e.kind, s.qualified_name AS source FROM edges e JOIN nodes n ON n.id = e.dst JOIN nodes s ON s.id = e.src", dangling=True)

FORWARD, BACKWARD = "SELECT src AS id, dst AS other, edge_id FROM edges WHERE kind = '{k}'", "SELECT dst AS id, src AS other, edge_id FROM edges WHERE kind = '{k}'"
for name, make, form, kind in (
    ("direct_callees", nb.direct_callees, FORWARD, "Calls"), ("direct_callers", nb.direct_callers, BACKWARD, "Calls"), ("implementors", nb.implementors, BACKWARD, "Implements"),
    ("overriders", nb.overriders, BACKWARD, "Overrides"), ("direct_imports", nb.direct_imports, FORWARD, "Imports"), ("direct_importers", nb.direct_importers, BACKWARD, "Imports"), ("closure_captures", nb.closure_captures, FORWARD, "Captures"),
):
    on_activity(name, lambda g, make=make: make(g, g.nodes), form, kind=kind)
on_activity("what_overrides", lambda g: nb.what_overrides(g, g.nodes), "SELECT src AS id, arg_min(dst, edge_id) AS other FROM edges WHERE kind = 'Overrides' GROUP BY src", kind="Overrides")

#: Errors throw their next user's name, outside; signups throw the user itself; other events call.
THROWING = {"purchase": "Calls", "view": "Calls", "click": "Reads", "signup": "Throws", "error": "Throws"}
THROWERS = "SELECT u AS id, edge_id FROM links WHERE kind = 'Throws' AND v = 7"
on_activity("methods_throwing", lambda g: nb.methods_throwing(g, "user7"), THROWERS, kinds=THROWING)
on_activity("exception_propagation", lambda g: rc.exception_propagation(g, "user7").select("id"), f", reach(id) AS (SELECT DISTINCT id FROM ({THROWERS}) UNION SELECT e.src FROM reach r JOIN edges e ON e.dst = r.id WHERE e.kind = 'Calls') SELECT id FROM reach", kinds=THROWING)


def all_pairs_of_neighbours(g) -> DataFrame:
    return g.nodes.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


on_activity("coupling_between", lambda g: nb.coupling_between(g, all_pairs_of_neighbours(g)), "SELECT n.id AS a, n.id + 1 AS b, e.edge_id, e.kind FROM nodes n JOIN edges e ON (e.src = n.id AND e.dst = n.id + 1) OR (e.src = n.id + 1 AND e.dst = n.id)")

# Closures: UNION ends the recursion on cycles.
REACH = """, steps AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ({kinds})), reach(root, id) AS (
  SELECT {s}, {d} FROM steps WHERE {s} % 50 = 0 UNION SELECT r.root, e.{d} FROM reach r JOIN steps e ON e.{s} = r.id
) SELECT root, id FROM reach WHERE id <> root"""
pairs = lambda df: df.select("root", "id")
for name, make, ends, kind, upward in (
    ("downstream_calls", rc.downstream_calls, ("src", "dst"), "Calls", False), ("upstream_callers", rc.upstream_callers, ("dst", "src"), "Calls", False), ("import_closure", rc.import_closure, ("src", "dst"), "Imports", True),
    ("all_subclasses", rc.all_subclasses, ("dst", "src"), "Extends", True), ("interface_hierarchy", rc.interface_hierarchy, ("dst", "src"), "Extends", True), ("async_call_chain", rc.async_call_chain, ("src", "dst"), "Awaits", True),
):
    on_activity(name, lambda g, make=make: pairs(make(g, roots(g))), REACH.format(s=ends[0], d=ends[1], kinds="'{k}'"), kind=kind, upward=upward)
#: Several of the kinds that a query follows, and one that it must leave out.
IMPACT = {"purchase": "Writes", "view": "Reads", "click": "HasType", "signup": "Imports", "error": "Calls"}
on_activity("change_impact", lambda g: pairs(rc.change_impact(g, roots(g))), REACH.format(s="dst", d="src", kinds="'Writes', 'Reads', 'HasType'"), kinds=IMPACT, upward=True)
on_activity("callees_depth2", lambda g: rc.downstream_calls(g, roots(g), depth=2), """
, steps AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'Calls'),
one AS (SELECT src AS root, dst AS id FROM steps WHERE src % 50 = 0),
two AS (SELECT DISTINCT o.root, e.dst AS id FROM one o JOIN steps e ON e.src = o.id)
SELECT root, id, 1 AS depth FROM one WHERE id <> root
UNION ALL SELECT root, id, 2 FROM (SELECT * FROM two EXCEPT SELECT * FROM one) WHERE id <> root""")
CALLED = {"purchase": "Calls", "view": "Instantiates", "click": "Reads", "signup": "Imports", "error": "Calls"}
SEEDED = ", reach(id) AS (SELECT id FROM nodes WHERE id % 50 = 0 UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.id WHERE e.kind IN ('Calls', 'Instantiates')) "
on_activity("reachable_from", lambda g: rc.reachable_from(g, seeds(g)).select("id"), SEEDED + "SELECT id FROM reach", kinds=CALLED, upward=True)
on_activity("dead_code", lambda g: rc.dead_code(g, seeds(g)).select("id"), SEEDED + "SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM reach)", kinds=CALLED, upward=True)
on_activity("entry_points", lambda g: mt.entry_points(g).select("id"), "SELECT id FROM nodes WHERE visibility = 'Public' AND id NOT IN (SELECT dst FROM edges WHERE kind = 'Calls')", kinds=CALLED, upward=True)


def call_paths(g) -> DataFrame:
    wanted = g.nodes.filter(ROOTS).select(F.col("id").alias("from_id"), (F.col("id") * 3 % 101).alias("to_id"))
    return rc.call_path(g, wanted).select("from_id", "to_id", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


# The distance of every node first, then all shortest paths in the order of their edges; a path has fewer steps than there are nodes.
on_activity("call_path", call_paths, """, steps AS (SELECT src, dst, min(edge_id) AS edge_id FROM edges WHERE kind = 'Calls' GROUP BY src, dst),
walk(root, id, n) AS (SELECT id, id, 0 FROM nodes WHERE id % 50 = 0 UNION SELECT w.root, e.dst, w.n + 1 FROM walk w JOIN steps e ON e.src = w.id WHERE w.n < (SELECT count(*) FROM nodes)),
far AS (SELECT root, id, min(n) AS n FROM walk GROUP BY root, id),
path(root, id, n, via, nodes) AS (SELECT root, id, n, CAST([] AS BIGINT[]), CAST(id AS VARCHAR) FROM far WHERE n = 0
  UNION ALL SELECT p.root, e.dst, f.n, list_append(p.via, e.edge_id), p.nodes || ',' || e.dst FROM path p JOIN steps e ON e.src = p.id JOIN far f ON f.root = p.root AND f.id = e.dst AND f.n = p.n + 1
  JOIN far t ON t.root = p.root AND t.id = p.root * 3 % 101 AND t.n > p.n)
SELECT root AS from_id, id AS to_id, arg_min(nodes, via) AS path FROM path WHERE id = root * 3 % 101 GROUP BY root, id""")
on_activity("superclass_chain", lambda g: rc.superclass_chain(g, g.nodes.select(F.col("id").alias("root"))), """
, step AS (SELECT src, arg_min(dst, edge_id) AS dst FROM edges WHERE kind = 'Extends' GROUP BY src),
chain(root, position, id) AS (SELECT src, 0, dst FROM step UNION ALL SELECT c.root, c.position + 1, s.dst FROM chain c JOIN step s ON s.src = c.id)
SELECT root, position, id FROM chain""", kind="Extends", upward=True)
on_commerce("package_of", rc.package_of, """
SELECT id, id AS package_id FROM nodes WHERE kind = 'Package'
UNION ALL SELECT c.dst, c.src FROM contains c JOIN nodes n ON n.id = c.dst WHERE n.kind = 'Class'
UNION ALL SELECT c.dst, p.src FROM contains c JOIN contains p ON p.dst = c.src JOIN nodes n ON n.id = c.dst WHERE n.kind IN ('Method', 'Field')""")

# Metrics.
COUPLED = """, pairs AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('Calls', 'Instantiates', 'Implements', 'Extends', 'HasType', 'Returns')),
a AS (SELECT dst AS id, count(*) AS afferent FROM pairs GROUP BY dst), e AS (SELECT src AS id, count(*) AS efferent FROM pairs GROUP BY src),
c AS (SELECT id, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent FROM nodes LEFT JOIN a USING (id) LEFT JOIN e USING (id))
SELECT id, {what} FROM c"""
RATIO = "CASE WHEN afferent + efferent > 0 THEN efferent / (afferent + efferent) END AS instability"
COUPLING = {"purchase": "Calls", "view": "Extends", "click": "HasType", "signup": "Reads", "error": "Calls"}
on_activity("afferent_coupling", mt.afferent_coupling, COUPLED.format(what="afferent"), kinds=COUPLING)
on_activity("efferent_coupling", mt.efferent_coupling, COUPLED.format(what="efferent"), kinds=COUPLING)
on_commerce("instability", mt.instability, COUPLED.format(what=RATIO))
on_commerce("hotspots", lambda g: mt.hotspots(g, 10), "SELECT id, kind, qualified_name, coalesce(n, 0) AS incoming FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) USING (id) ORDER BY incoming DESC, id LIMIT 10")
on_commerce("in_degrees", mt.in_degrees, "SELECT id, kind, qualified_name, coalesce(n, 0) AS incoming FROM nodes LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst) USING (id)")
on_commerce("lcom", mt.lcom, """
, m AS (SELECT c.src AS id, c.dst AS m FROM contains c JOIN nodes n ON n.id = c.dst WHERE n.kind = 'Method'),
t AS (SELECT DISTINCT m.id, m.m, e.dst AS t FROM m JOIN edges e ON e.src = m.m WHERE e.kind IN ('Reads', 'Writes')),
s AS (SELECT id, count(*) AS share FROM (SELECT DISTINCT a.id, a.m AS m1, b.m AS m2 FROM t a JOIN t b ON a.id = b.id AND a.t = b.t AND a.m < b.m) GROUP BY id),
k AS (SELECT id, count(*) AS n FROM m GROUP BY id)
SELECT id, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (n * (n - 1) / 2 - 2 * coalesce(share, 0)) / (n * (n - 1) / 2)) END AS lcom FROM k LEFT JOIN s USING (id)""")
on_commerce("package_dependency_graph", mt.package_dependency_graph, """
, of AS (SELECT c.dst AS id, c.src AS p FROM contains c JOIN nodes n ON n.id = c.dst WHERE n.kind = 'Class'
  UNION ALL SELECT c.dst, p.src FROM contains c JOIN contains p ON p.dst = c.src JOIN nodes n ON n.id = c.dst WHERE n.kind = 'Method'),
named AS (SELECT of.id, n.qualified_name AS p FROM of JOIN nodes n ON n.id = of.p)
SELECT a.p AS from_package, b.p AS to_package, count(*) AS n FROM edges e JOIN named a ON a.id = e.src JOIN named b ON b.id = e.dst
WHERE e.kind = 'Instantiates' AND a.p <> b.p GROUP BY ALL""")
add("unused_fields", lambda spark, d: mt.unused_fields(g := library(spark, d), g.nodes), """
WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)
SELECT first * 4 AS id, doc_id * 4 + 1 AS other FROM documents JOIN f USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
USING = {"purchase": "HasType", "view": "Returns", "click": "Instantiates", "signup": "Calls", "error": "References"}
on_activity("usages_of_type", lambda g: mt.usages_of_type(g, g.nodes), "SELECT DISTINCT dst AS id, src AS other FROM edges WHERE kind IN ('HasType', 'Returns', 'Instantiates', 'References')", kinds=USING)


def order_pairs(g) -> DataFrame:
    return lk.nodes_of_kind(g, "Method").select(F.col("id").alias("a"), (F.col("id") + 8).alias("b"))


on_commerce("shared_dependencies", lambda g: mt.shared_dependencies(g, order_pairs(g)), """
, d AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('Calls', 'Instantiates', 'HasType', 'Returns'))
SELECT x.src AS a, y.src AS b, x.dst AS other FROM d x JOIN d y ON y.src = x.src + 8 AND y.dst = x.dst""")
LAYERS = [["user1"], ["user2", "user3"], ["user4"], ["user10", "user5"]]
LAYERED = {"purchase": "Calls", "view": "Imports", "click": "HasType", "signup": "References", "error": "Calls"}
on_activity("layer_violations", lambda g: mt.layer_violations(g, LAYERS), """
, l AS (SELECT id, CASE WHEN starts_with(qualified_name, 'user1') THEN 0 WHEN starts_with(qualified_name, 'user2') OR starts_with(qualified_name, 'user3') THEN 1 WHEN starts_with(qualified_name, 'user4') THEN 2 WHEN starts_with(qualified_name, 'user5') THEN 3 END AS layer FROM nodes)
SELECT edge_id, src, dst, a.layer AS from_layer, b.layer AS to_layer FROM edges JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE kind IN ('Calls', 'Imports', 'References') AND a.layer > b.layer""", kinds=LAYERED)
on_activity("cycles", lambda g: mt.cycles(g, "Calls"), """
, steps AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'Calls'), reach(root, id) AS (SELECT src, dst FROM steps UNION SELECT r.root, e.dst FROM reach r JOIN steps e ON e.src = r.id),
mutual AS (SELECT a.root, a.id FROM reach a JOIN reach b ON a.root = b.id AND a.id = b.root)
SELECT root AS id, min(id) AS component FROM mutual GROUP BY root""")
on_commerce("package_cycles", mt.package_cycles, """
, of AS (SELECT c.dst AS id, c.src AS p FROM contains c JOIN nodes n ON n.id = c.dst WHERE n.kind = 'Class'
  UNION ALL SELECT c.dst, p.src FROM contains c JOIN contains p ON p.dst = c.src JOIN nodes n ON n.id = c.dst WHERE n.kind = 'Method'),
named AS (SELECT of.id, n.qualified_name AS p FROM of JOIN nodes n ON n.id = of.p),
d AS (SELECT DISTINCT a.p AS src, b.p AS dst FROM edges e JOIN named a ON a.id = e.src JOIN named b ON b.id = e.dst WHERE e.kind = 'Instantiates' AND a.p <> b.p),
reach AS (WITH RECURSIVE r(root, id) AS (SELECT src, dst FROM d UNION SELECT r.root, d.dst FROM r JOIN d ON d.src = r.id) SELECT * FROM r),
mutual AS (SELECT a.root, a.id FROM reach a JOIN reach b ON a.root = b.id AND a.id = b.root)
SELECT root AS package, min(id) AS component FROM mutual GROUP BY root""")

add("unimplemented_interface_methods", lambda spark, d: mt.unimplemented_interface_methods(g := contracts(spark, d), g.nodes), """
WITH held AS (SELECT o_custkey, o_orderpriority, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey),
wanted AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM held)
SELECT c.c_custkey * 8 + 2 AS id, (CAST(c.c_nationkey AS BIGINT) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT)) * 8 + 5 AS other
FROM customer c JOIN wanted w ON w.c_nationkey = c.c_nationkey
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.o_custkey = c.c_custkey AND h.o_orderpriority = w.o_orderpriority)""")
add("parameters_of", lambda spark, d: nb.parameters_of(g := contracts(spark, d), g.nodes), """
SELECT l_orderkey * 8 + 4 AS id, (l_orderkey * 16 + l_linenumber) * 8 + 7 AS other, (l_orderkey * 16 + l_linenumber) * 8 + 7 AS edge_id FROM lineitem""")
add("external_dependencies", lambda spark, d: short(lk.external_dependencies(contracts(spark, d))), "SELECT s_suppkey * 8 + 3 AS id, 'ExternalPackage' AS kind, s_name AS qualified_name FROM supplier")
add("find_by_qualified", lambda spark, d: short(lk.find_by_qualified(contracts(spark, d), "nation.7.BUILDING")), "SELECT min(c_custkey) * 8 + 6 AS id, 'Method' AS kind, 'nation.7.BUILDING' AS qualified_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING' HAVING count(*) > 0")
add("node_details", lambda spark, d: lk.node_details(contracts(spark, d).nodes).filter("kind <> 'Parameter'").select("id", "kind", "name", "file", "is_abstract"), """
SELECT CAST(n_nationkey AS BIGINT) * 8 + 1 AS id, 'Interface' AS kind, n_name AS name, 'nations.src' AS file, false AS is_abstract FROM nation
UNION ALL SELECT c_custkey * 8 + 2, 'Class', c_name, 'customers.src', false FROM customer
UNION ALL SELECT s_suppkey * 8 + 3, 'ExternalPackage', s_name, NULL, false FROM supplier
UNION ALL SELECT o_orderkey * 8 + 4, 'Method', o_orderpriority, 'orders.src', false FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT DISTINCT (CAST(c_nationkey AS BIGINT) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT)) * 8 + 5, 'Method', o_orderpriority, 'nations.src', true FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT min(c_custkey) * 8 + 6, 'Method', c_mktsegment, 'nations.src', false FROM customer GROUP BY c_nationkey, c_mktsegment""")


# Source files: the corpus as a tree, and a second version without some sources and with other texts.
def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, hash) before and after: documents of source src3 go, those in German get a line, those in Spanish are new."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path")
    old = docs.filter("lang <> 'es'").select(path, F.sha2("text", 256).alias("hash"))
    new = docs.filter("source <> 'src3'").select(path, F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("\n"))).otherwise(F.col("text")), 256).alias("hash"))
    return old, new


def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below folders named for their source, some of them test files by name."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), "source", F.when(F.col("lang") == "fr", "/tests/").otherwise("/main/"), F.when(F.col("lang") == "de", "test_").otherwise(""), "lang", F.col("doc_id").cast("string"), F.when(F.col("lang") == "es", "Test.java").otherwise(".py"))
    return docs.select("doc_id", is_test_file(path).alias("is_test"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, of which those to a page's path resolve to it."""
    g = references(spark, sf_dir)
    named = SourceGraph(g.nodes.withColumn("qualified_name", F.concat(F.lit("/"), F.regexp_extract("qualified_name", r"://[^.]*\.([^.]*)", 1))), g.edges)
    return resolve(named).edges.select("id", "src", "to_state", "to_id", "to_name")


def doc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("position"))
    return split_batches(docs).select("file", "position", "batch")


def merged_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users described by their latest event, and flagged as tests where any was an error."""
    g, events = activity(spark, sf_dir), table(spark, sf_dir, "events")
    name = F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("qualified_name")
    texts = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("description")).select(name, F.when(F.col("description") == "click", "").otherwise(F.col("description")).alias("description"))
    flags = events.filter("event_type = 'error'").select(name, F.lit(True).alias("is_test")).distinct()
    nodes = g.nodes.withColumn("description", F.lit(None).cast("string"))
    return commit_descriptions(nodes, texts, flags).select("id", "description", "is_test")


SQL_USER_EVENTS = "SELECT user_id, arg_max(event_type, event_id) AS last, bool_or(event_type = 'error') AS bad FROM events GROUP BY user_id"
add("file_hashes", lambda spark, d: corpus(spark, d).select("path", F.sha2("content", 256).alias("hash")), "SELECT 'doc' || doc_id AS path, sha256(text) AS hash FROM documents")
add("duplicate_files", lambda spark, d: corpus(spark, d).groupBy(F.sha2("content", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).filter("n > 1"), "SELECT sha256(text) AS hash, count(*) AS n, min('doc' || doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
add("incremental_diff", lambda spark, d: hash_diff(*versions(spark, d)), """
WITH old AS (SELECT doc_id, text FROM documents WHERE lang <> 'es'), new AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || chr(10) ELSE text END AS text FROM documents WHERE source <> 'src3')
SELECT 'doc' || coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS status
FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
add("is_test_flags", path_flags, "SELECT doc_id, lang IN ('fr', 'de', 'es') AS is_test FROM documents")
add("snippet_slices", lambda spark, d: corpus(spark, d).select("path", source_lines(F.col("content"), F.lit(2), F.lit(4)).alias("snippet")), "SELECT 'doc' || doc_id AS path, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS snippet FROM documents")
add("resolve_edges", resolved_links, """
WITH n AS (SELECT '/' || regexp_extract(url, '://[^.]*\\.([^.]*)', 1) AS name, max(page_id) AS id FROM pages GROUP BY 1),
l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS k FROM pages)
SELECT page_id * 100000 + k AS id, page_id AS src, CASE WHEN n.id IS NULL THEN 'External' ELSE 'Resolved' END AS to_state, n.id AS to_id, CASE WHEN n.id IS NULL THEN t END AS to_name FROM l LEFT JOIN n ON n.name = l.t""")
add("batch_split", doc_batches, "SELECT source AS file, doc_id AS position, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents")
add("merge_descriptions", merged_descriptions, f"SELECT user_id AS id, CASE WHEN last <> 'click' THEN last END AS description, bad OR user_id % 10 = 0 AS is_test FROM ({SQL_USER_EVENTS})")
add("char_counts", lambda spark, d: (m := table(spark, d, "conversations")).select("conv_id", "turn", memory.char_count(m).alias("chars")), "SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS chars FROM conversations")
add("should_compress", lambda spark, d: memory.should_compress(table(spark, d, "conversations"), 2000), "SELECT conv_id, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS chars, count(*) >= 5 AND sum(strlen(text)) > 2000 AS compress FROM conversations GROUP BY conv_id")
add("compression_boundary", lambda spark, d: memory.compression_boundary(table(spark, d, "conversations")), """
WITH m AS (SELECT conv_id, turn, strlen(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS s, sum(c) OVER (PARTITION BY conv_id) AS t FROM m WHERE p >= 1 AND p < greatest(n - 2, 1))
SELECT conv_id, min(p) + 1 AS boundary FROM i WHERE s >= floor(t * 70 / 100) GROUP BY conv_id""")


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below folders of their sources, with ignore rules at the root and in one folder."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".txt").otherwise(".PY")).alias("path"), F.col("text").alias("content"))
    rules = spark.createDataFrame([(".gitignore", "src3/\n*7.PY\n!d17.PY\n"), ("src1/.gitignore", "/de/\n")], "path string, content string")
    return walk(files.unionByName(rules)).select("path", "ext", "hash")


def numbered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of documents among those of their source, by the ids that they get."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("ordinal"))
    ids = assign_ids(rows, base=1000)
    firsts = ids.groupBy("file").agg(F.min("id").alias("first"))
    return ids.join(firsts, "file").select("file", "ordinal", (F.col("id") - F.col("first")).alias("place"))


def without_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = commerce(spark, sf_dir)
    left = remove_files(g, spark.createDataFrame([("supplier7.src",), ("customer3.src",)], "path string"))
    return left.edges.select(F.col("id").alias("edge_id"), "kind", "src", "to_state", "to_id", "to_name")


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of customers: nested or flat, with a blank text, or no object at all."""
    c = table(spark, sf_dir, "customer")
    pair = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "segment": "'), F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")), F.lit('"}'))
    nested = F.concat(F.lit('{"descriptions": '), pair, F.lit(', "is_test": {"name": true, "segment": "no"}}'))
    answer = F.when(F.col("c_mktsegment") == "MACHINERY", pair).when(F.col("c_mktsegment") == "FURNITURE", F.lit("sorry")).otherwise(nested)
    parsed = c.select("c_custkey", parse_answer(answer, F.array(F.lit("name"), F.lit("segment"))).alias("p"))
    return parsed.select("c_custkey", F.element_at("p.filled", "name").alias("name"), F.element_at("p.filled", "segment").alias("segment"), F.size("p.missing").cast("long").alias("missing"), F.element_at("p.flags", "name").alias("flag"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written in texts that are made of customers."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("so <function=find>\n<parameter=name>\n "), "c_name", F.lit(" </parameter><parameter=kind>"), "c_mktsegment", F.lit("</parameter>\n</function> and <function=stop></function>"))
    calls = c.select("c_custkey", F.posexplode(text_tool_calls(text)).alias("n", "x"))
    return calls.select("c_custkey", F.col("n").cast("long").alias("n"), F.col("x.name").alias("tool"), F.element_at("x.arguments", "name").alias("name"), F.element_at("x.arguments", "kind").alias("kind"))


FOLDED = """
WITH m AS (SELECT *, strlen(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
i AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS s, sum(c) OVER (PARTITION BY conv_id) AS t FROM m WHERE p >= 1 AND p < greatest(n - 2, 1)),
b AS (SELECT conv_id, min(p) + 1 AS boundary FROM i WHERE s >= floor(t * 70 / 100) GROUP BY conv_id)
"""
add("walk", walked, """
WITH f AS (SELECT source || '/' || lang || '/d' || doc_id || '.PY' AS path, 'd' || doc_id || '.PY' AS name, * FROM documents WHERE lang <> 'fr' AND strlen(text) > 0)
SELECT path, 'py' AS ext, sha256(text) AS hash FROM f WHERE source <> 'src3' AND NOT (ends_with(name, '7.PY') AND name <> 'd17.PY') AND NOT (source = 'src1' AND lang = 'de')""")
add("assign_ids", numbered_places, "SELECT source AS file, doc_id AS ordinal, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents")
add("remove_file", without_a_file, SQL_COMMERCE + """, gone AS (SELECT id, qualified_name FROM nodes WHERE file IN ('supplier7.src', 'customer3.src'))
SELECT e.edge_id, e.kind, e.src, CASE WHEN g.id IS NULL THEN 'Resolved' ELSE 'Unresolved' END AS to_state, CASE WHEN g.id IS NULL THEN e.dst END AS to_id, g.qualified_name AS to_name
FROM edges e LEFT JOIN gone g ON g.id = e.dst WHERE e.src NOT IN (SELECT id FROM gone)""")
add("parse_answer", parsed_answers, """
SELECT c_custkey, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name END AS name, CASE WHEN c_mktsegment NOT IN ('FURNITURE', 'BUILDING') THEN c_mktsegment END AS segment,
CASE c_mktsegment WHEN 'FURNITURE' THEN NULL WHEN 'BUILDING' THEN 1 ELSE 0 END AS missing, CASE WHEN c_mktsegment NOT IN ('FURNITURE', 'MACHINERY') THEN true END AS flag FROM customer""")
add("text_tool_calls", tool_calls, """
SELECT c_custkey, 0 AS n, 'find' AS tool, c_name AS name, c_mktsegment AS kind FROM customer UNION ALL SELECT c_custkey, 1, 'stop', NULL, NULL FROM customer""")
add("transcripts", lambda spark, d: memory.transcripts(table(spark, d, "conversations")), FOLDED + """
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '[User]: ' || text || chr(10) WHEN 'assistant' THEN '[Assistant]: ' || text || chr(10) WHEN 'tool' THEN '[Tool result]: ' || text || chr(10) ELSE '' END || chr(10), '' ORDER BY p) AS transcript
FROM m JOIN b USING (conv_id) WHERE p >= 1 AND p < boundary GROUP BY conv_id""")


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    return memory.apply_compression(messages, messages.groupBy("conv_id").agg(F.concat(F.lit("sum "), F.first("conv_id").cast("string")).alias("summary"))).select("conv_id", "turn", "role", F.md5("text").alias("text"))


add("apply_compression", compressed, FOLDED + f"""
SELECT conv_id, turn, role, md5(text) AS text FROM m LEFT JOIN b USING (conv_id) WHERE NOT coalesce(p >= 1 AND p < boundary, false)
UNION ALL SELECT conv_id, turn, 'user', md5('{memory.COMPRESSED[0]}' || (boundary - 1) || '{memory.COMPRESSED[1]}' || chr(10) || chr(10) || 'sum ' || conv_id) FROM m JOIN b USING (conv_id) WHERE p = 1 AND boundary > 1""")


def indexed_names(spark: SparkSession, sf_dir: str) -> str:
    """An index of the commerce graph's names in the shared folder."""
    path = scratch_path(spark, "name-index")
    name_index.build(commerce(spark, sf_dir), path)
    doom(spark, path)
    return path


add("search_by_index", lambda spark, d: short(name_index.search_nodes(spark, indexed_names(spark, d), "CUSTOMER.1")), SQL_COMMERCE + " SELECT id, kind, qualified_name FROM nodes WHERE contains(lower(name), 'customer.1') OR contains(lower(qualified_name), 'customer.1')")
add("package_by_range", lambda spark, d: short(name_index.nodes_in_package(spark, indexed_names(spark, d), "supplier.1")), SQL_COMMERCE + " SELECT id, kind, qualified_name FROM nodes WHERE starts_with(qualified_name, 'supplier.1')")


def snippets_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of documents that each hold a class on their first two lines; those in French are known for tests."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    span = F.struct(F.lit(0).alias("start_line"), F.lit(0).alias("start_col"), F.lit(1).alias("end_line"), F.lit(0).alias("end_col"))
    nodes = docs.select(F.col("doc_id").alias("id"), F.explode(F.array(F.lit("Class"), F.lit("Import"))).alias("kind"), name.alias("qualified_name"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), span.alias("span"), (F.col("lang") == "fr").alias("is_test"))
    tasks = description_tasks(corpus(spark, sf_dir), nodes).select("file", F.explode("snippets").alias("name", "snippet"), "is_test_schema")
    return tasks.select("file", "name", F.md5("snippet").alias("snippet"), F.element_at("is_test_schema", F.col("name")).alias("known"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for three entities of each customer, two of which share a name; one is known where the account is in debt."""
    c = table(spark, sf_dir, "customer")
    one = lambda name, snippet, known: F.struct(name.alias("name"), snippet.alias("snippet"), known.alias("known"))
    none, segment = F.lit(None).cast("boolean"), F.concat(F.lit("seg."), "c_mktsegment")
    entities = F.array(one(F.col("c_name"), F.col("c_mktsegment"), none), one(segment, F.col("c_name"), F.when(F.col("c_acctbal") < 0, True)), one(F.col("c_name"), F.lit("again"), none))
    return c.select("c_custkey", build_prompt(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), entities).alias("prompt"))


MODELS = ("GPT-4.1-mini", "gpt-4o", "gpt-3.5-turbo", "o3", "claude-sonnet-4.5", "claude-2", "Gemini-2.0", "mixtral", "other")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("c_custkey") % len(MODELS) + 1).cast("int"))
    tokens = memory.context_window(model)
    return table(spark, sf_dir, "customer").select("c_custkey", tokens.cast("long").alias("tokens"), memory.compression_threshold(tokens).cast("long").alias("threshold"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.concat(F.lit("intro\n# "), "c_name", F.lit(" & "), "c_mktsegment")).alias("text"))
    old = table(spark, sf_dir, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("-x")).alias("name"))
    return next_folders(old, texts)


add("description_tasks", snippets_of_documents, """
SELECT 'doc' || doc_id AS file, 'D' || doc_id AS name, md5(array_to_string(string_split(text, chr(10))[1:2], chr(10))) AS snippet, CASE WHEN lang = 'fr' THEN true END AS known FROM documents""")
add("build_prompt", prompts, """
SELECT c_custkey, concat_ws(chr(10), 'Describe source code of c' || c_custkey || '.', '### ' || c_name, '```', c_mktsegment, '```', '', '### seg.' || c_mktsegment, '```', c_name, '```', '', '### ' || c_name, '```', 'again', '```',
  'Answer with one JSON object that has the keys "descriptions" and "is_test".', 'Fill a sentence for each key of "descriptions", with the keys unchanged: {"' || c_name || '":"","seg.' || c_mktsegment || '":""}',
  'State true or false in "is_test" for each of: ["' || c_name || CASE WHEN c_acctbal < 0 THEN '"]' ELSE '","seg.' || c_mktsegment || '"]' END, 'Write JSON alone, without fences, comments or further keys.') AS prompt FROM customer""")
add("context_windows", windows, """
WITH w AS (SELECT c_custkey, CAST([1047576, 128000, 16385, 200000, 1000000, 200000, 1048000, 32000, 128000][c_custkey % 9 + 1] AS BIGINT) AS tokens FROM customer) SELECT c_custkey, tokens, CAST(floor(tokens * 50 / 100) * 4 AS BIGINT) AS threshold FROM w""")
add("next_folders", folders, """
WITH n AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, (SELECT max(p_size) FROM part) + row_number() OVER (ORDER BY c_custkey) AS k FROM customer)
SELECT c_custkey AS id, CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END || '-' || CASE WHEN c_acctbal < 0 THEN 'feature' ELSE left(trim(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-'), 50) END AS folder FROM n""")


# A tree of sources made of customers and orders, indexed, and brought up to its second version.
def indexed(spark: SparkSession, sf_dir: str, version: int) -> SourceGraph:
    first = update(empty_graph(spark), shop_sources(spark, sf_dir, 1))
    return first.graph if version == 1 else update(first.graph, shop_sources(spark, sf_dir, 2)).graph


def named_nodes(g: SourceGraph) -> DataFrame:
    return g.nodes.select("file", "kind", "qualified_name", "visibility", "is_abstract", F.coalesce("type_annotation", F.lit("")).alias("type"), F.col("span.start_line").alias("first"), F.col("span.end_line").alias("last"))


def named_edges(g: SourceGraph) -> DataFrame:
    """Each edge by the names of its ends; files and packages are left out as sources, for their names say nothing more."""
    name = g.nodes.select("id", "qualified_name", F.col("kind").alias("of"))
    src = name.filter("of not in ('File', 'Package')").select(F.col("id").alias("src"), F.col("qualified_name").alias("owner"))
    dst = name.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("found"))
    return g.edges.join(src, "src").join(dst, "to_id", "left").select("owner", "kind", "to_state", F.coalesce("found", "to_name").alias("target"), F.col("call_arity").cast("long").alias("arity"))


def sql_shop(version: int) -> str:
    gone, more = ("FURNITURE", "false") if version == 1 else ("BUILDING", "c_mktsegment = 'MACHINERY'")
    return f"""
WITH o AS (SELECT o_custkey, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) - 1 AS r FROM orders),
c AS (SELECT 'C' || c_custkey AS c, 'shop/C' || c_custkey || '.java' AS f, 'N' || c_nationkey AS n, o AS a, r, {more} AS m, CASE WHEN {more} THEN 1 ELSE 0 END AS k, CASE WHEN o IS NULL THEN 4 ELSE 8 + r + (r + 1) // 2 END AS z FROM customer LEFT JOIN o ON o_custkey = c_custkey AND i = 0 WHERE c_mktsegment <> '{gone}'),
p AS (SELECT * FROM c WHERE a IS NOT NULL), q AS (SELECT c.*, o.o AS b, 8 + k + c.r + (i - 1) // 2 AS l FROM c JOIN o ON 'C' || o_custkey = c AND i > 0)
"""


SQL_SHOP_NODES = """
SELECT f AS file, 'File' AS kind, f AS qualified_name, 'Public' AS visibility, false AS is_abstract, '' AS type, 0 AS first, z + k + 1 AS last FROM c
UNION ALL SELECT f, 'Package', 'shop', 'PackagePrivate', false, '', 0, 0 FROM c
UNION ALL SELECT f, 'Class', c, 'Public', false, '', 2, z + k FROM c
UNION ALL SELECT f, 'Field', c || '.total', 'Private', false, 'int', 3, 3 FROM c
UNION ALL SELECT f, 'Field', c || '.more', 'Private', false, 'int', 4, 4 FROM c WHERE m
UNION ALL SELECT f, 'Method', c || '.o' || a, 'Public', false, '', 4 + k, 7 + k + r FROM p
UNION ALL SELECT f, 'Parameter', c || '.o' || a || '.price', 'Unspecified', false, 'int', 4 + k, 4 + k FROM p
UNION ALL SELECT f, 'Parameter', c || '.o' || a || '.notes', 'Unspecified', false, 'List<String>', 4 + k, 4 + k FROM p
UNION ALL SELECT f, 'Method', c || '.o' || b, 'PackagePrivate', false, '', l, l FROM q
UNION ALL SELECT 'shop/N' || n_nationkey || '.java', 'File', 'shop/N' || n_nationkey || '.java', 'Public', false, '', 0, 4 FROM nation
UNION ALL SELECT 'shop/N' || n_nationkey || '.java', 'Package', 'shop', 'PackagePrivate', false, '', 0, 0 FROM nation
UNION ALL SELECT 'shop/N' || n_nationkey || '.java', 'Class', 'N' || n_nationkey, 'Public', true, '', 2, 3 FROM nation"""
SQL_SHOP_EDGES = """
SELECT c AS owner, 'Extends' AS kind, 'Resolved' AS to_state, n AS target, NULL::BIGINT AS arity FROM c
UNION ALL SELECT c, 'Contains', 'Resolved', c || '.total', NULL FROM c UNION ALL SELECT c || '.total', 'HasType', 'External', 'int', NULL FROM c
UNION ALL SELECT c, 'Contains', 'Resolved', c || '.more', NULL FROM c WHERE m UNION ALL SELECT c || '.more', 'HasType', 'External', 'int', NULL FROM c WHERE m
UNION ALL SELECT c, 'Contains', 'Resolved', c || '.o' || a, NULL FROM p UNION ALL SELECT c || '.o' || a, 'Writes', 'Resolved', c || '.total', NULL FROM p
UNION ALL SELECT c || '.o' || a, 'HasParameter', 'Resolved', c || '.o' || a || '.price', NULL FROM p UNION ALL SELECT c || '.o' || a, 'HasParameter', 'Resolved', c || '.o' || a || '.notes', NULL FROM p
UNION ALL SELECT c || '.o' || a || '.price', 'HasType', 'External', 'int', NULL FROM p UNION ALL SELECT c || '.o' || a || '.notes', 'HasType', 'External', 'List<String>', NULL FROM p
UNION ALL SELECT c || '.o' || a, 'Calls', 'Resolved', c || '.o' || b, 0 FROM q UNION ALL SELECT c, 'Contains', 'Resolved', c || '.o' || b, NULL FROM q
UNION ALL SELECT c || '.o' || b, 'Reads', 'Resolved', c || '.total', NULL FROM q UNION ALL SELECT c || '.o' || b, 'Returns', 'External', 'int', NULL FROM q"""
add("extract_nodes", lambda spark, d: named_nodes(indexed(spark, d, 1)), sql_shop(1) + SQL_SHOP_NODES)
add("extract_edges", lambda spark, d: named_edges(indexed(spark, d, 1)), sql_shop(1) + SQL_SHOP_EDGES)
add("index_update_nodes", lambda spark, d: named_nodes(indexed(spark, d, 2)), sql_shop(2) + SQL_SHOP_NODES)
add("index_update_edges", lambda spark, d: named_edges(indexed(spark, d, 2)), sql_shop(2) + SQL_SHOP_EDGES)


# Sources in the other languages, made of customers and orders: all nodes, and all edges by the names of their ends.
def extracted(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    g = extract(walk(polyglot_sources(spark, sf_dir, ext)))
    name = g.nodes.select("id", "qualified_name")
    src, dst = (name.select(F.col("id").alias(i), F.col("qualified_name").alias(n)) for i, n in (("src", "owner"), ("to_id", "found")))
    nodes = g.nodes.select(F.lit("node").alias("part"), F.col("file").alias("owner"), "kind", F.col("qualified_name").alias("name"))
    return nodes.unionByName(g.edges.join(src, "src").join(dst, "to_id", "left").select(F.lit("edge").alias("part"), "owner", "kind", F.coalesce("found", "to_name").alias("name")))


def sql_extracted(ext: str, of_file: str, of_order: str) -> str:
    """Rows written as 'owner kind name' (edges) and '+kind name' (nodes of the file f), a line each, for customers c and their orders o."""
    def select(line: str, source: str) -> str:
        node = line.startswith("+")
        owner, kind, name = ("{f}", *line[1:].split(" ", 1)) if node else line.split(" ", 2)
        text = lambda x: "'" + x.replace("{f}", f"c' || c || '.{ext}").replace("{c}", "' || c || '").replace("{n}", "' || n || '").replace("{o}", "' || o || '") + "'"
        return f"SELECT '{'node' if node else 'edge'}' AS part, {text(owner)} AS owner, '{kind}' AS kind, {text(name)} AS name FROM {source}"

    lines = [select(x.strip(), "c") for x in of_file.strip().split("\n")] + [select(x.strip(), "o") for x in of_order.strip().split("\n")]
    return "WITH c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer), o AS (SELECT c, n, o_orderkey AS o FROM c JOIN orders ON o_custkey = c)\n" + "\nUNION ALL ".join(lines)


add("extract_python", lambda spark, d: extracted(spark, d, "py"), sql_extracted("py", """
    +File {f}\n+Import .n{n}.N{n}\n+Import .n{n}.LIMIT\n+Class C{c}\n+Method C{c}.__init__\n+Parameter C{c}.__init__.total\n+Field C{c}.total
    {f} Imports .n{n}.N{n}\n{f} Imports .n{n}.LIMIT\n{f} Contains C{c}\n{f} Imports .n{n}.N{n}\n{f} Imports .n{n}.LIMIT
    C{c} Extends Base\nC{c} Contains C{c}.__init__\nC{c} Contains C{c}.total\nC{c}.__init__ HasParameter C{c}.__init__.total
    C{c}.__init__ Writes C{c}.total\nC{c}.__init__ Writes a\nC{c}.__init__ Writes b\nC{c}.__init__ Reads C{c}.total""", """
    +Method C{c}.o{o}\n+Parameter C{c}.o{o}.n\nC{c} Contains C{c}.o{o}\nC{c}.o{o} HasParameter C{c}.o{o}.n\nC{c}.o{o}.n HasType int\nC{c}.o{o} Reads C{c}.total"""))
add("extract_go", lambda spark, d: extracted(spark, d, "go"), sql_extracted("go", """
    +File {f}\n+Package shop\n+Import fmt\n+Import math/big\n+Constant shop.A{c}\n+Constant shop.B{c}\n+Class shop.C{c}\n+Field shop.C{c}.x\n+Field shop.C{c}.total
    {f} Contains shop\n{f} Imports fmt\n{f} Imports math/big\n{f} Contains shop.A{c}\n{f} Contains shop.B{c}\n{f} Contains shop.C{c}\n{f} Imports fmt\n{f} Imports math/big
    shop.C{c} Contains shop.C{c}.x\nshop.C{c} Contains shop.C{c}.total\nshop.C{c} Extends N{n}\nshop.C{c}.x HasType int\nshop.C{c}.total HasType int""", """
    +Method shop.C{c}.O{o}\n+Parameter shop.C{c}.O{o}.n\n{f} Contains shop.C{c}.O{o}\nshop.C{c}.O{o} HasParameter shop.C{c}.O{o}.n\nshop.C{c}.O{o}.n HasType int
    shop.C{c}.O{o} Returns error\nshop.C{c}.O{o} Calls fmt.Println\nshop.C{c}.O{o} Calls s.save"""))
add("extract_rust", lambda spark, d: extracted(spark, d, "rs"), sql_extracted("rs", """
    +File {f}\n+Import shop::n{n}\n+Import shop::n{n}::N{n}\n+Import shop::list::*\n+Enum K{c}\n+Constant K{c}::Low\n+Constant K{c}::High\n+Constant K{c}::At\n+Class C{c}\n+Field C{c}::total\n+Field C{c}::rest
    {f} Imports shop::n{n}\n{f} Imports shop::n{n}::N{n}\n{f} Imports shop::list::*\n{f} Contains K{c}\n{f} Contains C{c}\n{f} Imports shop::n{n}\n{f} Imports shop::n{n}::N{n}\n{f} Imports shop::list::*
    K{c} Contains K{c}::Low\nK{c} Contains K{c}::High\nK{c} Contains K{c}::At\nC{c} Contains C{c}::total\nC{c} Contains C{c}::rest\nC{c}::total HasType u64\nC{c}::rest HasType HashMap<String, Vec<T>>\nC{c} Implements Base""", """
    +Method C{c}::o{o}\n+Parameter C{c}::o{o}::n\n+Variable C{c}::o{o}::m\nC{c} Contains C{c}::o{o}\nC{c}::o{o} HasParameter C{c}::o{o}::n\nC{c}::o{o}::n HasType u64\nC{c}::o{o} Returns u64
    C{c}::o{o} Contains C{c}::o{o}::m\nC{c}::o{o}::m HasType u64\nC{c}::o{o} Writes C{c}::o{o}::m\nC{c}::o{o} Reads C{c}::total"""))
add("extract_typescript", lambda spark, d: extracted(spark, d, "ts"), sql_extracted("ts", """
    +File {f}\n+Import ./n{n}\n+Import ./n{n}.N{n}\n+Class C{c}\n+Field C{c}.total
    {f} Imports ./n{n}\n{f} Imports ./n{n}.N{n}\n{f} Contains C{c}\n{f} Imports ./n{n}\n{f} Imports ./n{n}.N{n}\n{f} Reexports ./n{n}.LIMIT
    C{c} Extends Base<T>\nC{c} Implements I<T, U>\nC{c} Implements J\nC{c} Contains C{c}.total\nC{c}.total HasType number""", """
    +Method C{c}.o{o}\n+Parameter C{c}.o{o}.n\nC{c} Contains C{c}.o{o}\nC{c}.o{o} HasParameter C{c}.o{o}.n\nC{c}.o{o}.n HasType number\nC{c}.o{o} Returns number\nC{c}.o{o} Reads C{c}.total"""))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
