"""Building and maintaining a code graph from source files.

``files`` has path and content; a path is relative to the root, with slashes. The
state is a table of (path, hash). Deleting, diffing and resolving are joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.text import extension, is_test_file, is_test_name, source_lines
from codeloom.graph import SourceGraph
from codeloom.schema import DESCRIBED_KINDS, EDGES, NODES
from codeloom.sources.scratch import materialise

#: File extensions with an extractor.
EXTENSIONS = ("go", "java", "py", "rs", "ts", "tsx")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below a folder that Spark can list; empty files count as missing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1] + "/"
    relative = F.expr("path").substr(F.locate(base, "path") + len(base), F.length("path"))
    return found.filter("length > 0").select(relative.alias("path"), F.decode("content", "utf-8").alias("content"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(base, n, regex, dir_only, negated): the lines of each folder's .gitignore as regular expressions over paths below it."""
    found = files.filter(F.col("path").rlike(r"(^|/)\.gitignore$")).select(F.regexp_replace("path", r"/?\.gitignore$", "").alias("base"), F.posexplode(F.split("content", "\r?\n")).alias("n", "line"))
    line = F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")
    kept = found.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    kept = kept.withColumn("negated", F.col("line").startswith("!")).withColumn("p", F.regexp_replace("line", r"^!|^\\(?=[#!])", ""))
    kept = kept.withColumn("dir_only", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/$", ""))
    kept = kept.withColumn("anchored", F.contains("p", F.lit("/"))).withColumn("p", F.regexp_replace("p", "^/", "")).filter("p <> ''")
    steps = [(r"([.+^$(){}|])", r"\\$1"), (r"/\*\*$", "/\x02"), (r"\*\*/", "\x01"), (r"\*\*", "\x03"), (r"\*", "[^/]*"), (r"\?", "[^/]"), (r"\[!", "[^"), ("\x01", "(?:.*/)?"), ("\x02", ".+"), ("\x03", ".*")]
    body = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.col("p"))
    regex = F.concat(F.when(F.col("anchored"), "^").otherwise("^(?:.*/)?"), body, F.lit("$"))
    return kept.select("base", "n", regex.alias("regex"), "dir_only", "negated")


def ignored(files: DataFrame) -> DataFrame:
    """Paths that a layer of ignore rules leaves out: in each layer the last matching rule counts, and any layer that ignores wins."""
    parts = F.split("path", "/")
    n = F.size("parts")
    below = files.select("path", parts.alias("parts")).select("path", "parts", F.explode(F.sequence(F.lit(0), n - 1)).alias("depth"))
    below = below.select("path", "parts", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("base"), "depth", F.explode(F.sequence(F.col("depth") + 1, n)).alias("upto"))
    below = below.select("path", "base", F.array_join(F.slice("parts", F.col("depth") + 1, F.col("upto") - F.col("depth")), "/").alias("rel"), (F.col("upto") < n).alias("is_dir"))
    # The root's rules meet every path; the join goes by the rules' folders, which are few beside the paths, or AQE splits the root's.
    rules = ignore_rules(files)
    met = below.join(rules, "base").filter("rlike(rel, regex) and (is_dir or not dir_only)")
    last = met.groupBy("path", "base", "rel").agg(F.max_by("negated", "n").alias("negated"))
    return last.filter("not negated").select("path").distinct()


def walk(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, content, ext, hash) of sources: not hidden, not in node_modules, not ignored, of a known extension in any case."""
    shown = ~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike("(^|/)node_modules(/|$)")
    kept = files.filter(shown & extension(F.col("path")).isin(*extensions) & (F.length("content") > 0))
    kept = kept.join(ignored(files), "path", "left_anti")
    return kept.select("path", "content", extension(F.col("path")).alias("ext"), F.sha2("content", 256).alias("hash"))


def hash_diff(old: DataFrame, new: DataFrame, rebuild: bool = False) -> DataFrame:
    """(path, status) with status added, changed, deleted or unchanged; a rebuild knows no old files."""
    if rebuild:
        old = old.limit(0)
    both = old.select("path", F.col("hash").alias("old")).join(new.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def assign_ids(rows: DataFrame, base: int = 0, file: str = "file", ordinal: str = "ordinal", buckets: int = 4096) -> DataFrame:
    """Add id: gapless from ``base``, by a hash bucket of the file, the file, and the ordinal in it.

    Counts go up from file to bucket, so the only window over everything has a row for
    each bucket.
    """
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(file), F.lit(buckets)))
    per_file = materialise(rows.groupBy("_b", file).agg(F.count(F.lit(1)).alias("_n")), "per-file")
    per_bucket = per_file.groupBy("_b").agg(F.sum("_n").alias("_m"))
    of_bucket = per_bucket.select("_b", (F.sum("_m").over(Window.orderBy("_b")) - F.col("_m")).alias("_from"))
    of_file = per_file.select("_b", file, (F.sum("_n").over(Window.partitionBy("_b").orderBy(file)) - F.col("_n")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("_b", file).orderBy(ordinal)) - 1
    return rows.withColumn("_k", place).join(of_file, ["_b", file]).join(of_bucket, "_b").withColumn("id", (F.lit(base) + F.col("_from") + F.col("_at") + F.col("_k")).cast("long")).drop("_b", "_k", "_at", "_from")


def resolve(g: SourceGraph, sticky: bool = False) -> SourceGraph:
    """Point edges at the node their text names, else mark them external.

    Earlier external edges are looked up again, so an incremental run equals a rebuild;
    ``sticky`` leaves them external.
    """
    open_states = ("Unresolved",) if sticky else ("Unresolved", "External")
    names = g.name_index().select(F.col("qualified_name").alias("to_name"), F.col("id").alias("_found"))
    joined = g.edges.join(names, "to_name", "left")
    is_open = F.col("to_state").isin(*open_states)
    hit = is_open & F.col("_found").isNotNull()
    edges = joined.withColumns({
        "to_id": F.when(hit, F.col("_found")).otherwise(F.col("to_id")),
        "to_state": F.when(hit, "Resolved").when(is_open, "External").otherwise(F.col("to_state")),
        "to_name": F.when(hit, F.lit(None)).otherwise(F.col("to_name")),
    }).select(*g.edges.columns)
    return SourceGraph(g.nodes, edges)


def remove_files(g: SourceGraph, paths: DataFrame) -> SourceGraph:
    """Without the files' nodes and the edges from them; edges into them become unresolved by name again."""
    gone = g.nodes.join(paths.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select(F.col("id").alias("_id"), F.col("qualified_name").alias("_name"))
    # Stored, its size is known: where it is small the edges aren't shuffled for it.
    gone = materialise(gone, "gone")
    kept = g.edges.join(gone, F.col("src") == F.col("_id"), "left_anti")
    joined = kept.join(gone, F.col("to_id") == F.col("_id"), "left")
    lost = F.col("_id").isNotNull()
    edges = joined.withColumns({"to_state": F.when(lost, "Unresolved").otherwise(F.col("to_state")), "to_name": F.when(lost, F.col("_name")).otherwise(F.col("to_name")), "to_id": F.when(lost, F.lit(None)).otherwise(F.col("to_id"))})
    return SourceGraph(g.nodes.join(gone.withColumnRenamed("_id", "id"), "id", "left_anti"), edges.select(*g.edges.columns))


def mark_tests(nodes: DataFrame) -> DataFrame:
    """Set is_test by file and by name; a flag that is set stays."""
    by_rule = F.coalesce(is_test_file(F.col("file")), F.lit(False)) | is_test_name(F.col("kind"), F.col("name"))
    return nodes.withColumn("is_test", F.col("is_test") | by_rule)


def snippet_lines(span: Column, compat: bool) -> tuple[Column, Column]:
    """First and last line, from 1: of a span from 0, or with ``compat`` as if it counted from 1."""
    shift = 0 if compat else 1
    return span["start_line"] + shift, span["end_line"] + shift


def description_tasks(files: DataFrame, nodes: DataFrame, compat: bool = False) -> DataFrame:
    """(file, snippets, schema, is_test_schema): for each file its describable entities' source texts by name.

    Of entities that share a name the one of highest id counts.
    """
    described = nodes.filter(F.col("kind").isin(*DESCRIBED_KINDS))
    described = described.groupBy("file", "qualified_name").agg(F.max_by(F.struct("span", "is_test"), "id").alias("n"))
    joined = described.join(files.select(F.col("path").alias("file"), "content"), "file")
    first, last = snippet_lines(F.col("n.span"), compat)
    snippets = joined.select("file", "qualified_name", source_lines(F.col("content"), first, last).alias("snippet"), F.when(F.col("n.is_test"), F.lit(True)).alias("known"))
    entries = F.array_sort(F.collect_list(F.struct("qualified_name", "snippet", "known")))
    return snippets.groupBy("file").agg(entries.alias("e")).select(
        "file",
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["qualified_name"], x["snippet"]))).alias("snippets"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["qualified_name"], F.lit("")))).alias("schema"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["qualified_name"], x["known"]))).alias("is_test_schema"),
    )


def commit_descriptions(nodes: DataFrame, descriptions: DataFrame, flags: DataFrame) -> DataFrame:
    """Merge (qualified_name, description) and (qualified_name, is_test) into nodes: blank texts and unknown names change nothing, flags overwrite."""
    texts = descriptions.filter("description <> ''").groupBy("qualified_name").agg(F.max("description").alias("_d"))
    marks = flags.filter("is_test is not null").groupBy("qualified_name").agg(F.max("is_test").alias("_t"))
    joined = nodes.join(texts, "qualified_name", "left").join(marks, "qualified_name", "left")
    return joined.withColumns({"description": F.coalesce("_d", "description"), "is_test": F.coalesce("_t", "is_test")}).select(*nodes.columns)


def yaml_lines(g: SourceGraph) -> DataFrame:
    """(section, id, line) of the graph as YAML in flow style; in order of section and id it is one document."""
    spark = g.nodes.sparkSession
    heads = spark.createDataFrame([("edges", -1, "edges:"), ("nodes", -1, "nodes:")], "section string, id long, line string")
    of = lambda df, section: df.select(F.lit(section).alias("section"), "id", F.concat(F.lit("- "), F.to_json(F.struct(*df.columns))).alias("line"))
    return heads.unionByName(of(g.nodes, "nodes")).unionByName(of(g.edges, "edges"))


def from_yaml_lines(lines: DataFrame) -> SourceGraph:
    """The graph of (section, line); a line that isn't a row of its section fails."""
    options = {"mode": "FAILFAST"}
    of = lambda section, schema: lines.filter((F.col("section") == section) & F.col("line").startswith("- ")).select(F.from_json(F.substr("line", F.lit(3)), schema, options).alias("x")).select("x.*")
    return SourceGraph(of("nodes", NODES), of("edges", EDGES))
