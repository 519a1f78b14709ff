"""Code graphs derived from business tables, so that queries run at any scale.

Ids are ``key * 8 + code`` with a code for each table, so they never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.graph import SourceGraph
from codeloom.sources.tables import table

REGION, NATION, CUSTOMER, SUPPLIER, ORDER, PART = range(6)


def node_rows(df: DataFrame, id: Column, kind: str, name: Column, qualified: Column, file: Column, visibility: Column | None = None, is_test: Column | None = None, attributes: Column | None = None) -> DataFrame:
    return df.select(
        id.cast("long").alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), file.alias("file"),
        (F.lit("Public") if visibility is None else visibility).alias("visibility"),
        (F.lit(False) if is_test is None else is_test).alias("is_test"),
        F.lit(False).alias("is_abstract"),
        (F.array().cast("array<string>") if attributes is None else attributes).alias("attributes"),
    )


def edge_rows(df: DataFrame, kind: str, id: Column, src: Column, dst: Column) -> DataFrame:
    return df.select(id.cast("long").alias("id"), F.lit(kind).alias("kind"), src.cast("long").alias("src"), F.lit("Resolved").alias("to_state"), dst.cast("long").alias("to_id"), F.lit(None).cast("string").alias("to_name"))


def key(column: str, code: int) -> Column:
    return F.col(column).cast("long") * 8 + code


def commerce(spark: SparkSession, sf_dir: str) -> SourceGraph:
    """Regions and nations as packages, customers and suppliers as classes, orders as methods, parts as fields.

    Orders read returned-flag N parts, write the others, and instantiate suppliers.
    """
    t = lambda name: table(spark, sf_dir, name)
    text = lambda c: F.col(c).cast("string")
    nodes = [
        node_rows(t("region"), key("r_regionkey", REGION), "Package", F.col("r_name"), F.col("r_name"), F.lit("world.src")),
        node_rows(t("nation"), key("n_nationkey", NATION), "Package", F.col("n_name"), F.concat(F.lit("nation."), "n_name"), F.lit("world.src")),
        node_rows(t("customer"), key("c_custkey", CUSTOMER), "Class", F.col("c_name"), F.concat(F.lit("customer."), text("c_nationkey"), F.lit("."), "c_name"), F.concat(F.lit("customer"), text("c_nationkey"), F.lit(".src")), attributes=F.array("c_mktsegment")),
        node_rows(t("supplier"), key("s_suppkey", SUPPLIER), "Class", F.col("s_name"), F.concat(F.lit("supplier."), text("s_nationkey"), F.lit("."), "s_name"), F.concat(F.lit("supplier"), text("s_nationkey"), F.lit(".src"))),
        node_rows(t("orders"), key("o_orderkey", ORDER), "Method", F.concat(F.lit("o"), text("o_orderkey")), F.concat(F.lit("order."), text("o_orderkey")), F.concat(F.lit("orders"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(".src")), visibility=F.when(F.col("o_orderstatus") == "F", "Public").otherwise("Private"), is_test=F.col("o_orderpriority").startswith("5")),
        node_rows(t("part"), key("p_partkey", PART), "Field", F.col("p_name"), F.concat(F.lit("part."), text("p_partkey")), F.concat(F.lit("parts"), (F.col("p_partkey") % 100).cast("string"), F.lit(".src")), visibility=F.lit("Private")),
    ]
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    line = F.col("l_orderkey").cast("long") * 16 + F.col("l_linenumber")
    contained = lambda df, parent, child: edge_rows(df, "Contains", child * 8, parent, child)
    edges = [
        contained(t("nation"), key("n_regionkey", REGION), key("n_nationkey", NATION)),
        contained(t("customer"), key("c_nationkey", NATION), key("c_custkey", CUSTOMER)),
        contained(t("supplier"), key("s_nationkey", NATION), key("s_suppkey", SUPPLIER)),
        contained(t("orders"), key("o_custkey", CUSTOMER), key("o_orderkey", ORDER)),
        contained(lines.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey")), key("l_suppkey", SUPPLIER), key("l_partkey", PART)),
        edge_rows(lines.filter("l_returnflag = 'N'"), "Reads", line * 8 + 1, key("l_orderkey", ORDER), key("l_partkey", PART)),
        edge_rows(lines.filter("l_returnflag <> 'N'"), "Writes", line * 8 + 2, key("l_orderkey", ORDER), key("l_partkey", PART)),
        edge_rows(lines, "Instantiates", line * 8 + 3, key("l_orderkey", ORDER), key("l_suppkey", SUPPLIER)),
    ]
    return SourceGraph(union(nodes), union(edges))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Edge kinds by event type, with the kind asked for in place of None; an error's edge leads outside.
ONE_KIND = {"purchase": None, "view": None, "click": None, "signup": "References", "error": None}


def activity(spark: SparkSession, sf_dir: str, kind: str = "Calls", kinds: dict[str, str | None] | None = None, upward: bool = False, dangling: bool = False) -> SourceGraph:
    """Users as functions, and for every event an edge from its user to that of the next event.

    An edge's id is its event's, its kind goes by the event's type (``kinds``). An error's
    target is External, ``lib.`` and the next user's name; the last event's is Unresolved.
    ``upward`` turns the other edges from the lesser user to the greater, so that these have no
    cycle; those of a user to itself are then References. With ``dangling``, signups lead to
    nodes that aren't there. The order in time is global, so it is found by minute: the next
    event of a minute's last one is the first of the next minute that has any.
    """
    of_type = {t: k or kind for t, k in (kinds or ONE_KIND).items()}
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").withColumn("minute", F.date_trunc("minute", "ts"))
    stepped = events.withColumn("next", F.lead("user_id").over(Window.partitionBy("minute").orderBy("ts", "event_id")))
    firsts = events.groupBy("minute").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.orderBy("minute"))).select("minute", "after")  # one row a minute
    steps = stepped.join(after, "minute").select("event_id", "event_type", F.col("user_id").alias("u"), F.coalesce("next", "after").alias("v"))
    outside = (F.col("event_type") == "error") | F.col("v").isNull()
    state = F.when(F.col("v").isNull(), "Unresolved").when(outside, "External").otherwise("Resolved")
    mapped = F.create_map(*(F.lit(x) for pair in of_type.items() for x in pair))[F.col("event_type")]
    src, dst = (F.least("u", "v"), F.greatest("u", "v")) if upward else (F.col("u"), F.col("v"))
    if dangling:
        dst = F.when(F.col("event_type") == "signup", -1 - dst).otherwise(dst)
    edges = steps.select(
        F.col("event_id").alias("id"),
        (F.when((F.col("u") == F.col("v")) & ~outside, "References").otherwise(mapped) if upward else mapped).alias("kind"),
        F.when(outside, F.col("u")).otherwise(src).alias("src"), state.alias("to_state"), F.when(~outside, dst).alias("to_id"),
        F.when(outside, F.concat(F.lit("lib.user"), F.coalesce(F.col("v").cast("string"), F.lit("")))).alias("to_name"),
    )
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    user = F.col("user_id")
    name = F.concat(F.lit("user"), user.cast("string"))
    nodes = node_rows(users, user, "Function", name, name, F.lit("users.src"), visibility=F.when(user % 2 == 0, "Public").otherwise("Private"), is_test=user % 10 == 0)
    return SourceGraph(nodes, edges)


def library(spark: SparkSession, sf_dir: str) -> SourceGraph:
    """Sources of documents as classes, named for their first document, documents as their fields, and labels as functions that read (quality 1) or write them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first"))
    nodes = [
        node_rows(first, F.col("first") * 4, "Class", F.col("source"), F.col("source"), F.lit("sources.src")),
        node_rows(docs, F.col("doc_id") * 4 + 1, "Field", F.col("doc_id").cast("string"), F.concat("source", F.lit("."), F.col("doc_id").cast("string")), F.concat("lang", F.lit(".src"))),
        node_rows(labels, F.col("doc_id") * 4 + 2, "Function", F.lit("label"), F.concat(F.lit("label."), F.col("doc_id").cast("string")), F.lit("labels.src")),
    ]
    held = docs.join(first, "source")
    edges = [
        edge_rows(held, "Contains", F.col("doc_id") * 4, F.col("first") * 4, F.col("doc_id") * 4 + 1),
        edge_rows(labels.filter("quality = 1"), "Reads", F.col("doc_id") * 4 + 1, F.col("doc_id") * 4 + 2, F.col("doc_id") * 4 + 1),
        edge_rows(labels.filter("quality = 0"), "Writes", F.col("doc_id") * 4 + 2, F.col("doc_id") * 4 + 2, F.col("doc_id") * 4 + 1),
    ]
    return SourceGraph(union(nodes), union(edges))


def contracts(spark: SparkSession, sf_dir: str) -> SourceGraph:
    """Nations as interfaces, customers as classes that implement theirs, and orders as their methods, named for the priority, with the order lines as parameters.

    An interface has an abstract method for each priority of its customers' orders, and one
    that isn't abstract for each segment of its customers. Suppliers are external packages.
    """
    t = lambda name: table(spark, sf_dir, name)
    text = lambda c: F.col(c).cast("string")
    held = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    wanted = held.select("c_nationkey", "o_orderpriority").distinct().withColumn("n", F.col("c_nationkey").cast("long") * 10 + F.substring("o_orderpriority", 1, 1).cast("int"))
    given = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("n"))
    abstract = node_rows(wanted, F.col("n") * 8 + 5, "Method", F.col("o_orderpriority"), F.concat(F.lit("nation."), text("c_nationkey"), F.lit("."), "o_orderpriority"), F.lit("nations.src")).withColumn("is_abstract", F.lit(True))
    line = F.col("l_orderkey").cast("long") * 16 + F.col("l_linenumber")
    nodes = [
        node_rows(t("nation"), key("n_nationkey", 1), "Interface", F.col("n_name"), F.concat(F.lit("nation."), text("n_nationkey")), F.lit("nations.src")),
        node_rows(t("customer"), key("c_custkey", 2), "Class", F.col("c_name"), F.concat(F.lit("customer."), text("c_custkey")), F.lit("customers.src")),
        node_rows(t("supplier"), key("s_suppkey", 3), "ExternalPackage", F.col("s_name"), F.col("s_name"), F.lit(None).cast("string")),
        node_rows(held, key("o_orderkey", 4), "Method", F.col("o_orderpriority"), F.concat(F.lit("order."), text("o_orderkey")), F.lit("orders.src")),
        abstract,
        node_rows(given, F.col("n").cast("long") * 8 + 6, "Method", F.col("c_mktsegment"), F.concat(F.lit("nation."), text("c_nationkey"), F.lit("."), "c_mktsegment"), F.lit("nations.src")),
        node_rows(t("lineitem"), line * 8 + 7, "Parameter", text("l_linenumber"), F.concat(F.lit("line."), line.cast("string")), F.lit("orders.src")),
    ]
    edges = [
        edge_rows(t("customer"), "Implements", key("c_custkey", 2), key("c_custkey", 2), key("c_nationkey", 1)),
        edge_rows(held, "Contains", key("o_orderkey", 4), key("o_custkey", 2), key("o_orderkey", 4)),
        edge_rows(wanted, "Contains", F.col("n") * 8 + 5, key("c_nationkey", 1), F.col("n") * 8 + 5),
        edge_rows(given, "Contains", F.col("n").cast("long") * 8 + 6, key("c_nationkey", 1), F.col("n").cast("long") * 8 + 6),
        edge_rows(t("lineitem"), "HasParameter", line * 8 + 7, key("l_orderkey", 4), line * 8 + 7),
        edge_rows(t("lineitem"), "HasType", line * 8, line * 8 + 7, key("l_suppkey", 3)),
    ]
    return SourceGraph(union(nodes), union(edges))


def references(spark: SparkSession, sf_dir: str) -> SourceGraph:
    """Pages as files, and their links as unresolved imports."""
    pages = table(spark, sf_dir, "pages")
    nodes = node_rows(pages, F.col("page_id"), "File", F.col("url"), F.col("url"), F.col("url"))
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("n", "to"))
    edges = links.select((F.col("page_id") * 100_000 + F.col("n")).alias("id"), F.lit("Imports").alias("kind"), F.col("page_id").alias("src"), F.lit("Unresolved").alias("to_state"), F.lit(None).cast("long").alias("to_id"), F.col("to").alias("to_name"))
    return SourceGraph(nodes, edges)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files: (path, content)."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def shop_sources(spark: SparkSession, sf_dir: str, version: int = 1) -> DataFrame:
    """A tree of Java files (path, content): an abstract class for each nation and a class for each customer, with a method for each of its orders.

    The first order's method takes parameters and calls those of the others; their methods
    stand two on a line. In version 2 the segment FURNITURE has come, BUILDING has gone, and
    MACHINERY has one field more.
    """
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    customers = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != ("FURNITURE" if version == 1 else "BUILDING")).join(orders, "c_custkey", "left")
    more = F.when((F.col("c_mktsegment") == "MACHINERY") & F.lit(version == 2), "    private int more;\n").otherwise("")
    name = lambda o: F.concat(F.lit("o"), o.cast("string"))
    others = F.slice("o", 2, F.greatest(F.size("o") - 1, F.lit(0)))
    calls = F.array_join(F.transform(others, lambda o: F.concat(F.lit("        this."), name(o), F.lit("();\n"))), "")
    first = F.concat(F.lit("    public void "), name(F.col("o")[0]), F.lit("(int price,\n            List<String> notes) {\n        this.total = price;\n"), calls, F.lit("    }\n"))
    rest = F.transform(others, lambda o, i: F.concat(F.when(i % 2 == 0, "    ").otherwise(" "), F.lit("int "), name(o), F.lit("() { return this.total; }"), F.when(i % 2 == 1, "\n").otherwise("")))
    number = F.col("c_custkey").cast("string")
    classes = customers.select(
        F.concat(F.lit("shop/C"), number, F.lit(".java")).alias("path"),
        F.concat(F.lit("package shop;\n\npublic class C"), number, F.lit(" extends N"), F.col("c_nationkey").cast("string"), F.lit(" {\n    private int total;\n"), more, F.coalesce(first, F.lit("")), F.coalesce(F.array_join(rest, ""), F.lit("")), F.when(F.size(others) % 2 == 1, "\n").otherwise(""), F.lit("}\n")).alias("content"),
    )
    nation = F.col("n_nationkey").cast("string")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("shop/N"), nation, F.lit(".java")).alias("path"), F.concat(F.lit("package shop;\n\npublic abstract class N"), nation, F.lit(" {\n}\n")).alias("content"))
    return classes.unionByName(nations)


#: By language: the file of customer {c} of nation {n} before its orders, the method of order {o}, and the end. Several declarations stand on a line, blocks and lists over lines.
SHOPS = {
    "py": ("from .n{n} import (N{n} as Base,\n    LIMIT)\nclass C{c}(Base, metaclass=M):\n    def __init__(self, total): self.total = total; self.a, self.b = 1, self.total\n", "    def o{o}(self, n: int = 3): return self.total\n", ""),
    "go": ("package shop\nimport (\"fmt\"; m \"math/big\")\nconst ( A{c} = iota; B{c}\n)\ntype C{c} struct { N{n}; x, total int }\n", "func (s *C{c}) O{o}(n int) error { fmt.Println(s.total); return s.save(n) }\n", ""),
    "rs": ("use shop::{n{n}::{self, N{n} as Base}, list::*}; pub enum K{c} { Low, High(u8), At { x: u8 } }\npub struct C{c}<T: Into<Vec<u8>>> { pub total: u64, rest: HashMap<String, Vec<T>> }\nimpl<T: Into<Vec<u8>>> Base<T> for C{c}<T> {", " fn o{o}(&self,\n n: u64) -> u64 { let m: u64 = self.total; m }", "\n}\n"),
    "ts": ("import Base, { N{n} as N } from \"./n{n}\"; export { LIMIT as MOST } from \"./n{n}\";\nexport class C{c}<T extends Q, U = Map<string, T>>\n  extends Base<T> implements I<T, U>, J { private total: number = 0;", " o{o}(n: number): number { return this.total; }", "}\n"),
}


def polyglot_sources(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """A tree of sources in one language (path, content): a file for each customer, with a class that has a method for each of its orders."""
    head, method, end = SHOPS[ext]
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")

    def filled(text: str, order: Column | None = None) -> Column:
        values = {"{c}": F.col("c_custkey"), "{n}": F.col("c_nationkey")} | ({} if order is None else {"{o}": order})
        out = F.lit(text)
        for name, value in values.items():
            out = F.replace(out, F.lit(name), value.cast("string"))
        return out

    methods = F.coalesce(F.array_join(F.transform("o", lambda o: filled(method, o)), ""), F.lit(""))
    return rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(f".{ext}")).alias("path"), F.concat(filled(head), methods, F.lit(end)).alias("content"))
