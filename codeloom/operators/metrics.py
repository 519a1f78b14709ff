"""Metrics as joins and aggregations, for all nodes or many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph, dealt
from codeloom.operators.closure import strong_components
from codeloom.operators.neighbours import fields_of
from codeloom.operators.reach import package_of
from codeloom.schema import COUPLING_KINDS, CYCLE_KINDS, LAYER_KINDS, PACKAGE_KINDS, SHARED_KINDS, USAGE_KINDS


def summary(g: SourceGraph) -> DataFrame:
    """(what, kind, n): counts of nodes and edges by kind."""
    nodes = g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    edges = g.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    return nodes.unionByName(edges)


def test_split(g: SourceGraph) -> DataFrame:
    """(production, test) counts of nodes."""
    return g.nodes.agg(F.count_if(~F.col("is_test")).alias("production"), F.count_if("is_test").alias("test"))


def coupling(g: SourceGraph) -> DataFrame:
    """(id, afferent, efferent, instability) of every node; no instability without coupling.

    Each edge counts once for its target and once for its source, in one pass over the
    distinct edges and one shuffle by node.
    """
    edges = g.adj(*COUPLING_KINDS).select("src", "dst").distinct()
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("e")), F.struct(F.col("src").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("e")))).alias("x")).select("x.*")
    counts = ends.groupBy("id").agg(F.sum("a").alias("afferent"), F.sum("e").alias("efferent"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    both = g.nodes.select("id").join(counts, "id", "left").select("id", zero("afferent"), zero("efferent"))
    total = F.col("afferent") + F.col("efferent")
    return both.withColumn("instability", F.when(total > 0, F.col("efferent") / total))


def afferent_coupling(g: SourceGraph) -> DataFrame:
    return coupling(g).select("id", "afferent")


def efferent_coupling(g: SourceGraph) -> DataFrame:
    return coupling(g).select("id", "efferent")


def instability(g: SourceGraph) -> DataFrame:
    return coupling(g).select("id", "instability")


def in_degrees(g: SourceGraph) -> DataFrame:
    """(id, incoming) of every node over all kinds of edges."""
    counts = g.adj().groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("incoming"))
    return g.nodes.select("id", "kind", "qualified_name").join(counts, "id", "left").withColumn("incoming", F.coalesce("incoming", F.lit(0).cast("long")))


def hotspots(g: SourceGraph, n: int) -> DataFrame:
    """The n nodes with most incoming edges, ties by id."""
    return in_degrees(g).orderBy(F.desc("incoming"), "id").limit(n)


def lcom(g: SourceGraph) -> DataFrame:
    """(id, lcom) of every node with methods: (pairs - 2 * sharing pairs) / pairs, at least 0; 0 below two methods.

    Pairs that share a read or written target are found by joining on the class and the
    target, so only sharing pairs are made, not all pairs of a class; methods with the same
    targets are counted together. A pair counts where its least shared target is, so none is
    made distinct again, and a class with many pairs is a plain join that can be split; only
    targets that several of its groups share come to it. What is before that is dealt by the
    number of nodes and edges, so that what a task sorts doesn't grow with the graph.
    """
    tasks = g.tasks("Contains", "Reads", "Writes")
    kinds = g.nodes.filter("kind = 'Method'").select(F.col("id").alias("m"))
    held = g.adj("Contains").select(F.col("src").alias("id"), F.col("dst").alias("m"))
    methods = dealt(held, tasks, "m").join(dealt(kinds, tasks, "m"), "m", "left_semi").select("id", "m").distinct()
    sizes = methods.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    touched = methods.join(dealt(g.adj("Reads", "Writes").select(F.col("src").alias("m"), F.col("dst").alias("t")), tasks, "m").distinct(), "m")
    # Methods that touch the same targets are one group; groups that share a target are paired, and a group with itself.
    of_method = touched.groupBy("id", "m").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    alike = dealt(of_method, tasks, "id", "ts").groupBy("id", "ts").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("g"))
    within = alike.filter("k > 1").select("id", (F.col("k") * (F.col("k") - 1) / 2).cast("long").alias("pairs"))
    ends = dealt(alike.select("id", "g", "k", "ts", F.explode("ts").alias("t")), tasks, "id", "t")
    shared = ends.groupBy("id", "t").agg(F.count(F.lit(1)).alias("groups")).filter("groups > 1").select("id", "t")
    ends = ends.join(shared, ["id", "t"], "left_semi")
    least = F.array_min(F.array_intersect("ts", "ts2"))
    across = ends.join(ends.select("id", "t", F.col("g").alias("g2"), F.col("k").alias("k2"), F.col("ts").alias("ts2")), ["id", "t"]).filter(F.col("g") < F.col("g2")).filter(least == F.col("t")).select("id", (F.col("k") * F.col("k2")).alias("pairs"))
    sharing = within.unionByName(across).groupBy("id").agg(F.sum("pairs").alias("share"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    value = F.greatest(F.lit(0.0), (pairs - 2 * F.coalesce("share", F.lit(0))) / pairs)
    return sizes.join(sharing, "id", "left").select("id", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.when(pairs > 0, value)).alias("lcom"))


def package_dependency_graph(g: SourceGraph) -> DataFrame:
    """(from_package, to_package, n): edges between different packages, by qualified name.

    Edges are counted by their source's package and target before the target's package is joined.
    """
    of = package_of(g)
    names = g.nodes.filter("kind = 'Package'").select("id", "qualified_name")
    out = g.adj(*PACKAGE_KINDS).select("src", "dst").join(of.select(F.col("id").alias("src"), F.col("package_id").alias("a")), "src").groupBy("a", "dst").agg(F.count(F.lit(1)).alias("n"))
    ends = out.join(of.select(F.col("id").alias("dst"), F.col("package_id").alias("b")), "dst")
    counted = ends.filter("a <> b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    named = counted.join(names.select(F.col("id").alias("a"), F.col("qualified_name").alias("from_package")), "a").join(names.select(F.col("id").alias("b"), F.col("qualified_name").alias("to_package")), "b")
    # Packages of one name are one package.
    return named.filter("from_package <> to_package").groupBy("from_package", "to_package").agg(F.sum("n").alias("n"))


def package_cycles(g: SourceGraph) -> DataFrame:
    """(package, component) of packages on a cycle; the component is named by its first package."""
    return named_components(package_dependency_graph(g).select(F.col("from_package").alias("src"), F.col("to_package").alias("dst")), "package")


def named_components(edges: DataFrame, name: str) -> DataFrame:
    """Cycle members of a graph whose nodes are texts."""
    code = lambda c: F.xxhash64(c)
    coded = edges.select(code("src").alias("src"), code("dst").alias("dst"))
    names = edges.select(F.col("src").alias(name)).distinct().select(code(name).alias("id"), name)
    members = strong_components(coded).join(names, "id")
    first = members.groupBy("component").agg(F.min(name).alias("first"))
    return members.join(first, "component").select(name, F.col("first").alias("component"))


def cycles(g: SourceGraph, *kinds: str) -> DataFrame:
    """(id, component) of nodes on a cycle of the given kinds, else of Extends and Imports."""
    return strong_components(g.adj(*(kinds or CYCLE_KINDS)))


def unused_fields(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """(id, other): the fields of each node that nothing reads or writes."""
    used = g.adj("Reads", "Writes").select(F.col("dst").alias("other")).distinct()
    return fields_of(g, ids).select("id", "other").distinct().join(used, "other", "left_anti").select("id", "other")


def entry_points(g: SourceGraph) -> DataFrame:
    """Public methods and functions that nothing calls."""
    called = g.adj("Calls").select(F.col("dst").alias("id")).distinct()
    return g.nodes.filter(F.col("kind").isin("Method", "Function") & (F.col("visibility") == "Public")).join(called, "id", "left_anti")


def unimplemented_interface_methods(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """(id, other): abstract methods of directly implemented interfaces whose name the class has no method of."""
    wanted = g.adj("Implements").select(F.col("src").alias("id"), F.col("dst").alias("interface")).join(ids.select("id").distinct(), "id", "left_semi").distinct()
    methods = g.nodes.filter("kind = 'Method'").select(F.col("id").alias("dst"), "name", "is_abstract")
    members = g.adj("Contains").join(methods, "dst").select("src", "dst", "name", "is_abstract")
    needed = wanted.join(members.filter("is_abstract").select(F.col("src").alias("interface"), F.col("dst").alias("other"), "name"), "interface")
    own = members.select(F.col("src").alias("id"), "name").distinct()
    return needed.join(own, ["id", "name"], "left_anti").select("id", "other")


def usages_of_type(g: SourceGraph, ids: DataFrame) -> DataFrame:
    """(id, other): distinct nodes that use a type."""
    return g.adj(*USAGE_KINDS).select(F.col("dst").alias("id"), F.col("src").alias("other")).join(ids.select("id").distinct(), "id", "left_semi").distinct()


def shared_dependencies(g: SourceGraph, pairs: DataFrame) -> DataFrame:
    """(a, b, other): what both nodes of a pair depend on."""
    out = g.adj(*SHARED_KINDS).select("src", F.col("dst").alias("other")).distinct()
    wanted = pairs.select("a", "b").distinct()
    of_a = wanted.join(out.withColumnRenamed("src", "a"), "a")
    return of_a.join(out.withColumnRenamed("src", "b"), ["b", "other"]).select("a", "b", "other")


def layer_of(name: Column, layers: list[list[str]]) -> Column:
    """The place of the first layer with a prefix of the name, or null."""
    found = F.lit(None).cast("int")
    for i in reversed(range(len(layers))):
        for prefix in layers[i]:
            found = F.when(name.startswith(prefix), F.lit(i)).otherwise(found)
    return found


def layer_violations(g: SourceGraph, layers: list[list[str]]) -> DataFrame:
    """(edge_id, src, dst, from_layer, to_layer) of edges from a layer to one before it; nodes of no layer are left out."""
    placed = g.nodes.select("id", layer_of(F.col("qualified_name"), layers).alias("layer")).filter("layer is not null")
    return (
        g.adj(*LAYER_KINDS)
        .join(placed.select(F.col("id").alias("src"), F.col("layer").alias("from_layer")), "src")
        .join(placed.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer")), "dst")
        .filter("from_layer > to_layer").select("edge_id", "src", "dst", "from_layer", "to_layer")
    )
