"""Declarations and references of source files, by DataFrame operations over statements.

``statements`` cuts files into statements, whatever their lines; declarations are told by
patterns for each language, and nesting is a running sum over a file's braces, or its
indentation for Python. Which declarations enclose a statement, and where they end, is
told by a stack over the statements of a file, a Python function like the one that cuts it.
Lists of names, types and parameters are cut at the separators that no bracket holds, at
any depth, and trees of imports are unfolded to their leaves. The result is nodes and edges
with targets by name, for ``ingest.resolve`` to look up. A file's statements stay together
and in order up to their scopes, so a file is dealt out once and files bound what a task holds.

Names of a body are looked up in the enclosing declarations of the same file first, from
the innermost on; ``compat`` leaves them as they are written.

This is no parser: what stands inside round brackets (the bodies of functions that are
passed on, say) counts as part of the statement, and types declared inside expressions
are not found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import go_visibility, python_visibility, visibility_from_modifiers
from codeloom.graph import SourceGraph
from codeloom.jobs.ingest import assign_ids
from codeloom.jobs.statements import language_of, split_top, statements
from codeloom.schema import EDGES, NODES, SPAN
from codeloom.sources.scratch import materialise

MODIFIERS = r"((?:(?:public|protected|private|static|final|abstract|synchronized|default|native|transient|volatile|export|declare|readonly|async|override|get|set)\s+)*)"

#: What angle brackets hold after a name.
GENERIC = r"<(?:[^<>]++|<(?:[^<>]++|<(?:[^<>]++|<[^<>]*+>)*+>)*+>)*+>"
#: By language: kind, pattern with modifiers and name, whether it holds others. The first that matches a statement counts.
RULES: dict[str, list[tuple[str, str, bool]]] = {
    "Java": [
        ("Package", r"^\s*+()package\s+([\w.]+)", False), ("Import", r"^\s*+()import\s+(?:static\s+)?(\w+(?:\.\w+)*(?:\.\*)?)", False),
        ("Annotation", rf"^\s*+{MODIFIERS}@interface\s+(\w+)", True), ("Interface", rf"^\s*+{MODIFIERS}interface\s+(\w+)", True),
        ("Enum", rf"^\s*+{MODIFIERS}enum\s+(\w+)", True), ("Class", rf"^\s*+{MODIFIERS}(?:class|record)\s+(\w+)", True),
        ("Method", rf"^\s*+{MODIFIERS}(?:{GENERIC}\s+)?(?!return\b|new\b|throw\b|else\b)[\w.]+(?:\s*{GENERIC})?(?:\s*\[\s*\])*\s+(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^;{{]*\)\s*(?:throws\s+[\w., ]+)?\s*[;{{]", True),
        ("Method", rf"^\s*+((?:(?:public|protected|private)\s+)?)(?!if\b|for\b|while\b|switch\b|catch\b|synchronized\b|try\b)(\w+)\s*\([^;{{]*\)\s*(?:throws\s+[\w., ]+)?\s*\{{", True),
        ("Field", rf"^\s*+{MODIFIERS}(?!return\b|throw\b|package\b|import\b|new\b|else\b|case\b|assert\b)\w[\w.]*+(?:{GENERIC})?(?:\s*\[\s*\])*\s+(\w+)\s*(?:=(?!=)|;|,|\[)", False),
    ],
    "Rust": [
        ("Import", r"^\s*(pub(?:\([^)]*\))?\s+)?use\s+(\S.*?)\s*;?$", False), ("Import", r"^\s*()extern\s+crate\s+(\w+)", False),
        ("Package", r"^\s*(pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", True), ("Class", r"^\s*(pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", True),
        ("Enum", r"^\s*(pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", True), ("Interface", r"^\s*(pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", True),
        ("Impl", rf"^\s*()(?:unsafe\s+)?impl(?:\s*{GENERIC})?\s+(?:!?[^{{]+?\s+for\s+)?(?:&\s*|mut\s+|dyn\s+|'\w+\s+)*(?:\w+::)*(\w+)", True),
        ("Function", r"^\s*(pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)", True),
        ("StaticField", r"^\s*(pub(?:\([^)]*\))?\s+)?static\s+mut\s+(\w+)", False), ("Constant", r"^\s*(pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)", False),
        ("TypeAlias", r"^\s*(pub(?:\([^)]*\))?\s+)?type\s+(\w+)", False), ("Field", r"^\s*(pub(?:\([^)]*\))?\s+)?(\w+)\s*:(?!:)\s*[^=]+$", False), ("Variable", r"^\s*()let\s+(?:mut\s+)?(\w+)\s*(?::(?!:)|=|;|$)", False),
    ],
    "Python": [
        ("Import", r"^\s*()(?:from\s+([\w.]+)\s+import\b)", False), ("Import", r"^\s*()import\s+([\w.]+)", False), ("SelfField", r"^\s*()self\.(\w+)\s*(?::[^=]+)?=(?!=)", False), ("Class", r"^\s*()class\s+(\w+)", True),
        ("Function", r"^\s*((?:async\s+)?)def\s+(\w+)", True), ("GlobalVariable", r"^()([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", False), ("Field", r"^\s+()([A-Za-z_]\w*)\s*(?::\s*[^=]+(?:=.*)?|=(?!=).*)$", False),
    ],
    "Go": [
        ("Package", r"^()package\s+(\w+)", False), ("Import", r"^\s*()import\s+(?:[\w.]+\s+)?(\"\")", False),
        ("Class", r"^()type\s+(\w+)(?:\[[^\]]*\])?\s+struct\b", True), ("Interface", r"^()type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b", True), ("TypeAlias", r"^()type\s+(\w+)", False),
        ("Method", r"^func\s+\(\s*\w*\s*\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*(\w+)\s*\(", True), ("Function", r"^()func\s+(\w+)", True),
        ("Constant", r"^()const\s+(\w+)", False), ("GlobalVariable", r"^()var\s+(\w+)", False), ("Signature", r"^\s+()([A-Za-z_]\w*)\s*\(", False), ("Field", r"^\s+()([A-Za-z_]\w*)(?:\s*,\s*\w+)*\s+(?![=:+*/%&|<.-]*=)[\w*\[(<].*$", False),
    ],
    "TypeScript": [
        ("Import", r"^\s*()import\s+(?:[^\"]*?\bfrom\s*)?(\"\")", False), ("Interface", rf"^\s*+{MODIFIERS}interface\s+(\w+)", True), ("Enum", rf"^\s*+{MODIFIERS}(?:const\s+)?enum\s+(\w+)", True),
        ("Class", rf"^\s*+{MODIFIERS}class\s+(\w+)", True), ("TypeAlias", rf"^\s*+{MODIFIERS}type\s+(\w+)", False), ("Function", rf"^\s*+{MODIFIERS}function\s*\*?\s*(\w+)", True),
        ("Method", rf"^\s++{MODIFIERS}(?!if\b|for\b|while\b|switch\b|catch\b|return\b|super\b|await\b|new\b)(?:#|\*\s*)?(\w+)\??\s*(?:{GENERIC})?\((?!.*\)\s*=>).*\)\s*(?::\s*.+?)?[{{;]?\s*$", True),
        ("Constant", rf"^{MODIFIERS}const\s+(\w+)", False), ("GlobalVariable", rf"^{MODIFIERS}(?:let|var)\s+(\w+)", False), ("Field", rf"^\s++{MODIFIERS}#?(\w+)[?!]?\s*(?::|=(?![=>])|;|$)", False),
    ],
}
#: By language: texts of which each rule needs one, told before its pattern is tried.
NEEDS: dict[str, list[tuple[str, ...]]] = {
    "Java": [("package",), ("import",), ("@interface",), ("interface",), ("enum",), ("class", "record"), ("(",), ("(",), ("=", ";", ",", "[")],
    "Rust": [("use",), ("extern",), ("mod",), ("struct",), ("enum",), ("trait",), ("impl",), ("fn",), ("static",), ("const", "static"), ("type",), (":",), ("let",)],
    "Python": [("from",), ("import",), ("self.",), ("class",), ("def",), ("=",), (":", "=")],
    "Go": [("package",), ("import",), ("struct",), ("interface",), ("type",), ("func",), ("func",), ("const",), ("var",), ("(",), (" ",)],
    "TypeScript": [("import",), ("interface",), ("enum",), ("class",), ("type",), ("function",), ("(",), ("const",), ("let", "var"), (" ",)],
}
#: Words before a parenthesis that call nothing.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "new", "synchronized", "try", "func", "fn", "def", "class", "match", "elif", "except", "with", "not", "and", "or", "in", "super", "assert", "print", "yield", "lambda", "function", "constructor", "throw", "typeof", "await", "import")
CONTAINERS = ("Class", "Interface", "Enum", "Annotation", "Package", "Impl", "Function", "Method")
CALLABLE = ("Function", "Method")
KEPT = ("path", "language", "at", "line", "raw", "code", "marks", "depth", "d")


def says(column: str, *texts: str) -> Column:
    """Whether a column has one of the texts: most statements have nothing of a kind, which this tells before a pattern does."""
    return reduce(or_, (F.contains(column, F.lit(t)) for t in texts))


def matched(rules: dict[str, list[tuple[str, str, bool]]]) -> Column:
    """struct(kind, modifiers, name) of the first rule of the statement's language that matches, or null."""
    out = F.lit(None).cast("struct<kind:string,modifiers:string,name:string>")
    for language, own in rules.items():
        for (kind, pattern, _), needs in reversed(list(zip(own, NEEDS[language], strict=True))):
            hit = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", pattern, 1).alias("modifiers"), F.regexp_extract("code", pattern, 2).alias("name"))
            out = F.when((F.col("language") == language) & says("code", *needs) & F.col("code").rlike(pattern), hit).otherwise(out)
    # In a lambda Spark evaluates it step by step: as one piece of generated code it is too large for the JVM to compile.
    return F.get(F.transform(F.array(F.lit(0)), lambda _: out), F.lit(0))


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements with code, in order of file and place; annotations that are statements of their own go to the next one of their file."""
    kept, of = [], None
    for batch in batches:
        bare = np.asarray(pc.equal(pc.utf8_trim(batch.column("code"), " "), ""))
        if not (kept or bare.any()):
            yield batch
            continue
        paths, given, at = batch.column("path").to_pylist(), batch.column("marks").to_pylist(), batch.schema.get_field_index("marks")
        for i, path in enumerate(paths):
            if path != of:
                kept, of = [], path
            given[i] = kept + (given[i] or [])
            kept = given[i] if bare[i] else []
        yield batch.set_column(at, "marks", pa.array(given, batch.schema.field(at).type)).filter(pa.array(~bare))


def packaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements of whole files with the name of their file's Go package."""
    for batch in batches:
        d, found = batch.column("d"), {}
        says = pc.fill_null(pc.and_(pc.equal(pc.struct_field(d, "kind"), "Package"), pc.equal(batch.column("language"), "Go")), False)
        for path, name in zip(batch.column("path").filter(says).to_pylist(), pc.struct_field(d, "name").filter(says).to_pylist(), strict=True):
            found.setdefault(path, name)
        names = [found.get(path) for path in batch.column("path").to_pylist()] if found else [None] * batch.num_rows
        yield batch.append_column("package", pa.array(names, pa.string()))


def enclosed(rows: pa.Table) -> pa.RecordBatch:
    """For the statements of whole files, in order: the enclosing declarations, outermost first, and the last line of each one's own declaration."""
    ends = rows["last"].to_pylist()
    around, offsets, body, levels, stack, before, file = [], [0], [None] * len(ends), [], [], -1, None
    columns = zip(rows["path"].to_pylist(), rows["last"].to_pylist(), rows["depth"].to_pylist(), rows["closing"].to_pylist(), rows["holder"].to_pylist(), strict=True)
    for i, (path, last, depth, closing, holder) in enumerate(columns):
        if path != file:
            for own in stack:
                ends[own] = max(ends[own], before)
            levels, stack, before, file = [], [], -1, path
        while levels and levels[-1] >= depth:
            level, own = levels.pop(), stack.pop()
            ends[own] = max(ends[own], last if closing and level == depth else before)
        if stack:
            if body[stack[-1]] is None:
                body[stack[-1]] = depth
            around += stack
        offsets.append(len(around))
        if holder is not None:
            levels.append(depth)
            stack.append(i)
        before = last
    for own in stack:
        ends[own] = max(ends[own], before)
    whole = lambda c: rows[c].combine_chunks()
    own = pa.StructArray.from_arrays([whole("at"), pa.array(body, pa.int32()), whole("holder"), whole("name"), whole("modifiers")], names=["at", "body", "kind", "name", "modifiers"])
    scope = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own.take(pa.array(around, pa.int64())))
    return pa.RecordBatch.from_arrays([*map(whole, KEPT), scope, pa.array(ends, pa.int32())], names=[*KEPT, "scope", "end"])


def enclosed_by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``enclosed`` of statements in order of file and place; a file's are kept until the next one begins."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column("path")
        start = pc.index(paths, paths[-1]).as_py()
        if kept and (start or kept[-1].column("path")[-1] != paths[-1]):
            yield enclosed(pa.Table.from_batches([*kept, batch.slice(0, start)]))
            kept = []
        elif start:
            yield enclosed(pa.Table.from_batches([batch.slice(0, start)]))
        kept.append(batch.slice(start))
    if kept:
        yield enclosed(pa.Table.from_batches(kept))


def scoped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Statements in order of file and place, as ``scoped_statements`` gives them."""
    return packaged(enclosed_by_file(marked(batches)))


def scoped_statements(files: DataFrame) -> DataFrame:
    """Statements with their declaration (d), its last line (end), the declarations around them (scope, outermost first), the file's Go package and annotations (marks), which count for the declaration that follows."""
    rows = statements(files).withColumn("d", matched(RULES))
    rows = rows.withColumn("d", F.when(F.col("d.kind").isNotNull() & (F.col("d.name") != ""), F.col("d")))
    opens = (F.col("language") == "Python") | F.col("code").rlike(r"\{\s*$")
    holds = F.col("d.kind").isin(*CONTAINERS) & ~((F.col("d.kind") == "Package") & (F.col("language") != "Rust")) & opens
    rows = rows.withColumns({"holder": F.when(holds, F.col("d.kind")), "name": F.col("d.name"), "modifiers": F.col("d.modifiers")})
    # Whether a call or a method's head: a method only stands in a type.
    scope = "scope array<struct<at:long,body:int,kind:string,name:string,modifiers:string>>"
    columns = "path string, language string, at long, line int, raw string, code string, marks array<string>, depth int, d struct<kind:string,modifiers:string,name:string>"
    rows = rows.select(*KEPT, "last", "closing", "holder", "name", "modifiers").mapInArrow(scoped, f"{columns}, {scope}, end int, package string")
    # What declares nothing and has no letter, such as a bracket, refers to nothing either.
    rows = rows.filter(F.col("d").isNotNull() | F.col("code").rlike("[A-Za-z_]"))
    return rows.withColumn("d", F.when(stands(), F.struct(F.when(is_local(), "Variable").otherwise(F.col("d.kind")).alias("kind"), "d.modifiers", "d.name")))


def held_by() -> Column:
    return F.coalesce(F.try_element_at("scope", F.lit(-1))["kind"], F.lit(""))


def is_local() -> Column:
    return (F.col("language") == "Java") & (F.col("d.kind") == "Field") & held_by().isin(*CALLABLE)


def stands() -> Column:
    """Whether a statement that looks like a declaration can be one where it stands."""
    kind, language, holder = F.col("d.kind"), F.col("language"), held_by()
    in_callable = F.exists("scope", lambda s: s["kind"].isin(*CALLABLE))
    in_init = (holder == "Function") & (F.try_element_at("scope", F.lit(-1))["name"] == "__init__") & (F.try_element_at("scope", F.lit(-2))["kind"] == "Class") & (F.col("depth") == F.try_element_at("scope", F.lit(-1))["body"])
    return (
        F.when(kind == "Variable", in_callable)
        .when(kind == "SelfField", in_init)
        .when(kind == "Signature", holder == "Interface")
        .when(is_local(), True)
        .when(language.isin("Rust", "Go", "Python") & (kind == "Field"), holder == "Class")
        .when((language == "TypeScript") & kind.isin("Field", "Method"), holder.isin("Class", "Interface"))
        .when((language == "Java") & (kind == "Method") & F.col("code").rlike(r"^\s*\w+\s*\("), F.col("d.name") == F.try_element_at("scope", F.lit(-1))["name"])
        .when((language == "Java") & (kind == "Method"), holder.isin("Class", "Interface", "Enum", "Annotation"))
        .when(kind.isin("Field", "Constant", "GlobalVariable"), ~in_callable)
        .otherwise(kind.isNotNull())
    )


def kind_here() -> Column:
    """Methods, constants and fields by what holds the declaration and by its modifiers and name."""
    kind, name, modifiers, language = F.col("d.kind"), F.col("d.name"), F.col("d.modifiers"), F.col("language")
    holder = F.try_element_at("scope", F.lit(-1))["kind"]
    in_type = holder.isin("Class", "Interface", "Impl", "Enum")
    return (
        F.when(((kind == "Function") & in_type) | (kind == "Signature"), "Method")
        .when(kind == "SelfField", "Field")
        .when((kind == "Field") & (language == "Java") & F.contains(modifiers, F.lit("static")) & F.contains(modifiers, F.lit("final")), "Constant")
        .when((kind == "Field") & F.contains(modifiers, F.lit("static")), "StaticField")
        .when((kind == "GlobalVariable") & (language == "Python") & name.rlike(r"^[A-Z_]+$"), "Constant")
        .when((kind == "GlobalVariable") & in_type, "Field")
        .otherwise(kind)
    )


def visibility_here() -> Column:
    language, name, modifiers = F.col("language"), F.col("d.name"), F.col("d.modifiers")
    rust = F.when(modifiers.rlike(r"pub\("), "Internal").when(F.contains(modifiers, F.lit("pub")), "Public").otherwise("Private")
    typescript = F.when(F.contains(modifiers, F.lit("private")), "Private").when(F.contains(modifiers, F.lit("protected")), "Protected").when((F.col("d.kind") == "Function") & ~F.contains(modifiers, F.lit("export")), "Private").otherwise("Public")
    python = F.when(F.col("d.kind") == "Class", "Public").otherwise(python_visibility(name))
    return F.when(language == "Java", visibility_from_modifiers(modifiers)).when(language == "Go", go_visibility(name)).when(language == "Rust", rust).when(language == "Python", python).otherwise(typescript)


#: Statements that declare several names at once.
LISTS = ("Field", "Constant", "GlobalVariable", "Variable")


def declarations(rows: DataFrame) -> DataFrame:
    """Of named statements: (path, language, at, line, end, position, kind, name, qualified_name, parent, alias, visibility, code, modifiers, marks, scope), the owner's qualified name as parent, null for the file.

    ``position`` tells what one statement declares apart.
    """
    plain = F.col("d.kind").isin("Import", "Package") & (F.col("language") != "Rust") | (F.col("d.kind") == "Import")
    receiver = F.when((F.col("language") == "Go") & (F.col("d.kind") == "Method"), F.array("d.modifiers")).otherwise(F.array().cast("array<string>"))
    to_class = (F.col("d.kind") == "SelfField")
    around = F.concat("head", F.when(to_class, F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0)))).otherwise(F.col("names")))
    parent = F.when((F.size("scope") > 0) & ~plain, joined(separator(), around))
    own = ("path", "language", "at", "line", "end")
    none = F.lit(None).cast("string")
    declared = rows.filter(F.col("d").isNotNull()).withColumn("pieces", F.when(plain, imported()).otherwise(F.transform(listed_names(), lambda n: F.struct(n.alias("name"), n.alias("path"), none.alias("alias")))))
    found = declared.select("*", F.posexplode("pieces").alias("place", "piece")).select(
        *own, F.col("place").alias("position"), kind_here().alias("kind"), F.col("piece.name").alias("name"),
        F.when(plain, F.col("piece.path")).otherwise(joined(separator(), F.concat(around, receiver, F.array("piece.name")))).alias("qualified_name"), parent.alias("parent"), F.col("piece.alias").alias("alias"),
        visibility_here().alias("visibility"), "code", F.col("d.modifiers").alias("modifiers"), "marks", "scope",
    )
    # A class's field that its own body declares, or an earlier assignment, isn't declared again.
    same = Window.partitionBy("path", "qualified_name").orderBy(F.col("modifiers") == "self", "at", "position")
    marked = found.withColumn("modifiers", F.when((F.col("language") == "Python") & (F.col("kind") == "Field") & F.col("code").rlike(r"^\s*self\."), "self").otherwise(F.col("modifiers")))
    found = marked.withColumn("earlier", F.row_number().over(same)).filter((F.col("modifiers") != "self") | (F.col("earlier") == 1)).drop("earlier")
    # Members of an enumeration: the statements inside it that declare nothing else.
    inside = F.col("d").isNull() & (held_by() == "Enum")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("code", r"\{\s*$", ""), r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)|\{[^{}]*+\}", ""), ";.*$", "")
    listed = F.regexp_extract_all(text, F.lit(r"(?:^|,)\s*([A-Za-z_]\w*)\s*(?:=[^,}]*)?(?=,|\}|\s*$)"), 1)
    nearest = F.size("scope") == 0
    deep = F.col("depth") == F.try_element_at("scope", F.lit(-1))["body"]
    members = rows.filter(inside & deep & ~nearest).select(*own, "language", joined(separator(), F.concat("head", "names")).alias("parent"), F.posexplode(listed).alias("place", "name"), "scope").select(
        *own, F.col("place").alias("position"), F.lit("Constant").alias("kind"), "name", F.concat("parent", separator(), "name").alias("qualified_name"), "parent", none.alias("alias"),
        F.lit("Public").alias("visibility"), F.lit("").alias("code"), F.lit("").alias("modifiers"), F.array().cast("array<string>").alias("marks"), "scope",
    ).withColumn("end", F.col("line"))
    return found.unionByName(members)


def listed_names() -> Column:
    """The names that a statement declares: one, or those of a list whose values and types are none."""
    text = F.regexp_replace(F.regexp_replace("code", r"^\s+|[;{]\s*$", ""), "==|!=|<=|>=", "")
    pieces = split_top(text)
    name = lambda p: F.regexp_extract(p, r"^([A-Za-z_$][\w$]*)\s*(?:\[\s*\])*\s*(?:$|=|:|[\w*\[(<])", 1)
    go = F.col("language") == "Go"
    valued = F.array_position(F.transform(pieces, lambda p: F.contains(p, F.lit("="))), F.lit(True)).cast("int")
    said = F.when(go & (valued > 0), F.slice(pieces, 1, valued)).otherwise(pieces)
    more = F.filter(F.transform(F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), name), lambda n: n != "")
    several = F.col("d.kind").isin(*LISTS) & F.col("language").isin("Java", "Go", "TypeScript") & F.contains("code", F.lit(","))
    names = F.when(several, F.concat(F.array("d.name"), more)).otherwise(F.array("d.name"))
    return F.filter(names, lambda n: ~((n == "_") & go))


def use_tree(text: Column) -> Column:
    """The leaves of a tree of imports, array of struct(path, alias): a list in braces stands for one path for each of its own, at any depth."""
    state = lambda heads, piece, out: F.struct(heads.alias("heads"), piece.alias("piece"), out.alias("out"))
    empty = F.array().cast("array<string>")

    def leaf(s: Column) -> Column:
        """What has been found, with the piece read last."""
        piece = F.trim(s["piece"])
        return F.when(piece == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.concat(F.coalesce(F.try_element_at(s["heads"], F.lit(-1)), F.lit("")), piece))))

    def step(s: Column, token: Column) -> Column:
        head = F.concat(F.coalesce(F.try_element_at(s["heads"], F.lit(-1)), F.lit("")), F.trim(s["piece"]))
        up = F.slice(s["heads"], 1, F.greatest(F.size(s["heads"]) - 1, F.lit(0)))
        return (
            F.when(token == "{", state(F.concat(s["heads"], F.array(head)), F.lit(""), s["out"]))
            .when(token == "}", state(up, F.lit(""), leaf(s)))
            .when(token == ",", state(s["heads"], F.lit(""), leaf(s)))
            .otherwise(state(s["heads"], F.concat(s["piece"], token), s["out"]))
        )

    leaves = F.aggregate(F.regexp_extract_all(text, F.lit(r"[{},]|[^{},]+"), F.lit(0)), state(empty, F.lit(""), empty), step, leaf)
    alias = lambda x: F.nullif(F.regexp_extract(x, r"\sas\s+(\w+)$", 1), F.lit(""))
    return F.transform(leaves, lambda x: F.struct(F.regexp_replace(F.regexp_replace(x, r"\s+as\s+\w+$", ""), r"::self$", "").alias("path"), alias(x).alias("alias")))


def imported() -> Column:
    """array of struct(name, path, alias) of what an import, or a package's name, declares: the alias or the last part of the path is the name."""
    language, code, raw = F.col("language"), F.col("code"), F.col("raw")
    none = F.lit(None).cast("string")
    one = lambda name, path, alias: F.struct(name.alias("name"), path.alias("path"), alias.alias("alias"))
    last = lambda path, cut: F.regexp_extract(path, rf"([^{cut}]*)$", 1)
    rust = F.transform(use_tree(F.col("d.name")), lambda x: one(F.coalesce(x["alias"], last(x["path"], ":")), x["path"], x["alias"]))

    def as_named(piece: Column, module: Column) -> Column:
        name, alias = F.regexp_extract(piece, r"^([\w.*$]+)", 1), F.nullif(F.regexp_extract(piece, r"\sas\s+([\w$]+)$", 1), F.lit(""))
        return one(F.coalesce(alias, name), F.concat(module, name), alias)

    listed = F.regexp_extract(code, r"\bimport\s*\(?\s*(.*?)\s*,?\s*\)?$", 1)
    module = F.nullif(F.regexp_extract(code, r"^\s*from\s+([\w.]+)\s+import\b", 1), F.lit(""))
    python = F.transform(split_top(listed), lambda x: as_named(x, F.coalesce(F.concat(module, F.lit(".")), F.lit(""))))
    python = F.when(module.isNull(), F.transform(python, lambda x: one(F.coalesce(x["alias"], last(x["path"], ".")), x["path"], x["alias"]))).otherwise(python)
    target = F.regexp_extract(raw, r"[\"'`]([^\"'`]*)[\"'`]\s*;?$", 1)
    go_alias = F.nullif(F.regexp_extract(raw, r"^\s*import\s+([\w.]+)\s", 1), F.lit(""))
    go = F.when((target != "") & F.coalesce(go_alias != "_", F.lit(True)), F.array(one(F.coalesce(go_alias, last(target, "/")), target, go_alias)))
    clause = F.regexp_extract(raw, r"^\s*import\s+(?:type\s+)?(.*?)\s*\bfrom\s*[\"'`]", 1)
    first = F.regexp_extract(clause, r"^([\w$]+)", 1)
    space = F.regexp_extract(clause, r"\*\s*as\s+([\w$]+)", 1)
    named = F.filter(split_top(F.regexp_extract(clause, r"\{(.*)\}", 1)), lambda x: x != "")
    typescript = F.filter(F.concat(
        F.array(F.when(first != "", one(first, target, none))), F.array(F.when(space != "", one(space, target, none))),
        F.transform(named, lambda x: as_named(F.regexp_replace(x, r"^type\s+", ""), F.concat(target, F.lit(".")))), F.array(F.when(clause == "", one(last(target, "/"), target, none))),
    ), lambda x: x.isNotNull())
    own = F.array(one(F.col("d.name"), F.col("d.name"), none))
    is_import = F.col("d.kind") == "Import"
    found = F.when(is_import & (language == "Rust") & ~F.col("code").rlike(r"^\s*extern\b"), rust).when(is_import & (language == "Python"), python).when(is_import & (language == "Go"), go).when(is_import & (language == "TypeScript") & (target != ""), typescript)
    return F.coalesce(found, F.when(is_import & language.isin("Go", "TypeScript"), F.array().cast("array<struct<name:string,path:string,alias:string>>")).otherwise(own))


def separator() -> Column:
    return F.when(F.col("language") == "Rust", "::").otherwise(".")


def with_names(lines: DataFrame) -> DataFrame:
    """Add head (the package that leads qualified names) and names (of the enclosing declarations)."""
    go = F.col("language") == "Go"
    none = F.array().cast("array<string>")
    return lines.withColumns({
        "head": F.when(go & F.col("package").isNotNull() & ~F.coalesce(F.col("d.kind") == "Package", F.lit(False)), F.array("package")).otherwise(none),
        "names": F.flatten(F.transform("scope", lambda s: F.when(go & (s["kind"] == "Method"), F.array(s["modifiers"], s["name"])).otherwise(F.array(s["name"])))),
    })


#: By language: how a parameter is written, with its name and type.
PARAMETER = {
    "Java": (r"^(?:@\S+\s+|final\s+)*(?:.*[\s>\].])(\w+)(?:\[\])*$", r"^(?:@\S+\s+|final\s+)*(.*?)\s*\w+(?:\[\])*$"),
    "Python": (r"^([A-Za-z_]\w*)", r"^\w+\s*:\s*([^=]+?)\s*(?:=.*)?$"),
    "TypeScript": (r"^(?:(?:public|private|protected|readonly)\s+)*([A-Za-z_]\w*)", r"^[^:]*:\s*([^=]+?)\s*(?:=.*)?$"),
    "Rust": (r"^(?:mut\s+)?([A-Za-z_]\w*)\s*:", r"^[^:]*:\s*(.+)$"),
    "Go": (r"^([A-Za-z_]\w*)(?:\s|$)", r"^\w+\s+(.+)$"),
}
#: By language: the type that a declaration of fields or variables names.
FIELD_TYPE = {
    "Java": rf"^\s*+(?:(?:public|protected|private|static|final|transient|volatile)\s+)*+([\w.]+(?:{GENERIC})?(?:\s*\[\s*\])*)\s+\w+\s*[=;,\[]",
    "Python": r"^\s*(?:self\.)?\w+\s*:\s*([^=]+?)\s*(?:=.*)?$", "TypeScript": r"^[^:=]*:\s*((?:[^=;]|=>)+?)\s*(?:[=;]|$)", "Rust": r"^[^:=]*:(?!:)\s*([^=;]+?)\s*(?:,|[=;].*)?$",
    "Go": r"^\s*+(?:(?:const|var)\s++)?+[A-Za-z_]\w*(?:\s*,\s*\w+)*\s+([\w.*\[({<][^=\"]*?)\s*(?:=.*|\"\"\s*)?$",
}


def by_language(patterns: dict[str, str], text: Column, group: int = 1) -> Column:
    out = F.lit("")
    for language, pattern in patterns.items():
        out = F.when(F.col("language") == language, F.regexp_extract(text, pattern, group)).otherwise(out)
    return out


def parameters(decls: DataFrame) -> DataFrame:
    """(path, language, at, line, end, position, name, qualified_name, parent, type) of the parameters of methods and functions; receivers, self and star arguments aren't any, nor is the first one of a static or class method."""
    after = F.when(F.col("language") == "Go", F.regexp_replace("code", r"^func\s+\([^)]*\)", "func")).otherwise(F.col("code"))
    inner = F.regexp_extract(F.regexp_replace(after, GENERIC + r"(?=\s*\()", ""), r"\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+)\)", 1)
    found = decls.filter(F.col("kind").isin(*CALLABLE)).select("path", "language", "at", "line", "marks", F.col("qualified_name").alias("parent"), F.posexplode(split_top(inner)).alias("place", "piece"))
    found = found.filter((F.col("place") > 0) | ~F.exists("marks", lambda m: m.isin("@staticmethod", "@classmethod"))).drop("marks")
    named = found.withColumns({"name": by_language({k: v[0] for k, v in PARAMETER.items()}, F.col("piece")), "type": by_language({k: v[1] for k, v in PARAMETER.items()}, F.col("piece"))})
    kept = named.filter((F.col("name") != "") & ~F.col("name").isin("self", "cls", "this"))
    return kept.select("path", "language", "at", "line", F.col("line").alias("end"), (F.col("place") + 1000).alias("position"), "name", F.concat("parent", separator(), "name").alias("qualified_name"), "parent", F.nullif("type", F.lit("")).alias("type"))


def joined(separator: Column, parts: Column) -> Column:
    return F.call_function("array_join", F.array_remove(parts, ""), separator)


def as_targets(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("target"), F.lit(None).cast("int").alias("arity")))


def references(rows: DataFrame) -> DataFrame:
    """Of named statements: (path, at, line, owner, names, kind, target, arity): what callables call, make, await, read and write, by the text of the target; ``names`` are those of the owner and what encloses it."""
    lines = rows.filter(F.exists("scope", lambda s: s["kind"].isin(*CALLABLE)))
    lines = lines.withColumns({"owner": joined(separator(), F.concat("head", "names")), "body": F.when(F.col("d").isNotNull() & F.col("d.kind").isin(*CALLABLE), "").otherwise(F.col("code"))})
    local = F.when(F.col("d.kind") == "Variable", F.col("d.name"))
    simple = F.col("language").isin("Java", "Rust")
    short = lambda n: F.when(simple, F.regexp_replace(n, r"^.*(?:\.|::)", "")).otherwise(n)
    call = r"(?<![\w.])(?<!new )((?:[A-Za-z_]\w*(?:\.|::))*[A-Za-z_]\w*!?)\s*\("
    has = lambda *texts: says("body", *texts)
    none = F.array().cast("array<string>")
    found_in = lambda pattern, group, *texts: F.when(has(*texts), F.regexp_extract_all("body", F.lit(pattern), F.lit(group))).otherwise(none)
    whole = found_in(call + r"(?:[^()]*\))?", 0, "(")
    inner = lambda w: F.trim(F.regexp_extract(w, r"\(([^()]*)\)$", 1))
    arity = lambda w: F.when(w.endswith(")"), F.when(inner(w) == "", 0).otherwise(F.regexp_count(inner(w), F.lit(",")) + 1))
    calls = F.transform(whole, lambda w: F.struct(F.lit("Calls").alias("kind"), short(F.regexp_extract(w, r"^([\w.:]+!?)", 1)).alias("target"), arity(w).alias("arity")))
    calls = F.filter(calls, lambda c: ~c["target"].isin(*NOT_CALLS))
    news = found_in(r"\bnew\s+([A-Za-z_][\w.]*)", 1, "new")
    literals = F.when(F.col("language") == "Go", found_in(r"(?<![\w.])&?([A-Z]\w*)\{", 1, "{")).when(F.col("language") == "Rust", found_in(r"(?<![\w:])([A-Z]\w*)\s*\{", 1, "{")).otherwise(none)
    awaits = found_in(r"\bawait\s+([A-Za-z_][\w.]*)\s*\(", 1, "await")
    own = r"\b(?:this|self)\."
    # What stands before an assignment is written, be it one target or several.
    left = F.regexp_extract("body", r"^\s*([\w.,\s()\[\]*]*?)\s*(?:[-+*/%|&^]|//|<<|>>)?=(?![=>])", 1)
    targets = F.when(has("=") & has("this.", "self."), F.filter(F.transform(split_top(left), lambda x: F.regexp_extract(x, r"^[(*]?\s*(?:this|self)\.(\w+)[)]?$", 1)), lambda x: x != "")).otherwise(none)
    after = F.when(F.size("targets") > 0, F.concat(F.when(F.col("body").rlike(r"^[^=]*[-+*/%|&^]=(?!=)"), left).otherwise(""), F.substr("body", F.length(F.regexp_extract("body", r"^[^=]*=", 0)) + 1))).otherwise(F.col("body"))
    writes = F.array_union("targets", found_in(own + r"(\w+)\s*(?:=(?!=)|[-+*/%|&^]=|\+\+|--)", 1, "this.", "self."))
    reads = F.when(has("this.", "self."), F.regexp_extract_all(after, F.lit(own + r"(\w+)\b(?!\s*(?:\(|=(?!=)|[-+*/%|&^]=))"), 1)).otherwise(none)
    writes = F.concat(writes, F.when(local.isNotNull() & F.col("body").rlike(r"=(?!=)"), F.array(local)).otherwise(none))
    receivers = F.when(F.col("language").isin("Java", "Rust"), found_in(r"(?<![\w.])(?:this\.|self\.)?(?!this\b|super\b|self\b)([a-z_]\w*)\.\w+\s*\(", 1, "(")).otherwise(none)
    found = F.concat(calls, *(as_targets(names, kind) for kind, names in (("Instantiates", news), ("Instantiates", literals), ("Awaits", awaits), ("Writes", writes), ("Reads", F.array_union(reads, receivers)))))
    return lines.withColumn("targets", targets).select("path", "at", "line", "owner", "head", "names", separator().alias("separator"), F.explode(found).alias("r")).select("path", "at", "line", "owner", "head", "names", "separator", "r.kind", "r.target", "r.arity")


def within_file(refs: DataFrame, named: DataFrame) -> DataFrame:
    """Put the qualified name in place of a target that an enclosing declaration of the same file, the innermost first, has a member of.

    ``named`` has path and qualified_name of what the files declare, once each.
    """
    bare = F.regexp_replace("target", r"^(?:this|self)\.", "")
    depth = F.sequence(F.size("names"), F.lit(0), F.lit(-1))
    options = F.transform(depth, lambda k: joined(F.col("separator"), F.concat("head", F.slice("names", F.lit(1), k), F.array(bare))))
    asked = materialise(refs.withColumn("row", F.monotonically_increasing_id()), "references")
    tried = asked.select("row", "path", F.posexplode(options).alias("place", "qualified_name"))
    first = tried.join(named.select("path", "qualified_name"), ["path", "qualified_name"], "left_semi").groupBy("row").agg(F.min("place").alias("place"))
    return asked.join(first, "row", "left").withColumn("target", F.when(F.col("place").isNotNull(), F.get(options, F.col("place"))).otherwise(F.col("target"))).drop("row", "place")


def without_generics(code: Column) -> Column:
    """The statement without the type parameters that follow its keyword or name, and with arrows that close no bracket."""
    named = F.regexp_replace(F.regexp_replace(code, "->", "→"), "=>", "⇒")
    return F.regexp_replace(F.regexp_replace(named, rf"(\b(?:class|interface|record|struct|trait|enum|type|fn|function)\s+\w+)\s*{GENERIC}", "$1"), rf"(\bimpl)\s*{GENERIC}", "$1")


def heritage(decls: DataFrame) -> DataFrame:
    """(path, at, line, owner, kind, target): what declarations extend, implement, import, throw and return."""
    code, language = F.col("code"), F.col("language")
    bare = without_generics(code)
    part = lambda text, pattern: F.regexp_extract(text, pattern, 1)
    types = lambda text, separator=",": split_top(F.regexp_replace(F.regexp_replace(text, "→", "->"), "⇒", "=>"), separator)
    extends = F.when(F.col("kind").isin("Class", "Interface"), F.when(language.isin("Java", "TypeScript") & says("code", "extends"), types(part(bare, r"\bextends\s+(.+?)\s*(?:\bimplements\b|\bpermits\b|\{|;|$)"))).when(language == "Python", F.filter(types(part(code, r"class\s+\w+\s*\((.*)\)\s*:")), lambda x: (x != "object") & ~x.rlike(r"^\w+\s*=|^\*"))).when(language == "Rust", F.filter(types(part(bare, r"trait\s+\w+\s*:\s*(.+?)\s*(?:\bwhere\b|\{|;|$)"), "+"), lambda x: ~x.startswith("'") & ~x.startswith("?"))))
    implements = F.when(language.isin("Java", "TypeScript") & says("code", "implements"), types(part(bare, r"\bimplements\s+(.+?)\s*(?:\bpermits\b|\{|;|$)"))).when((language == "Rust") & says("code", "impl"), F.array(part(bare, r"\bimpl\s+([\w:]+)[^{]*?\s+for\s")))
    throws = F.when((language == "Java") & says("code", "throws"), types(part(code, r"\)\s*throws\s+([\w., ]+)")))
    path = F.when(language == "Python", F.regexp_replace("qualified_name", r"\.\*$", "")).otherwise(F.col("qualified_name"))
    imports = F.when(F.col("kind") == "Import", F.array(path))
    returns = F.when(F.col("kind").isin("Method", "Function"), F.array(F.coalesce(F.nullif(part(code, r"\)\s*->\s*(.+?)\s*(?:\bwhere\b|[{;]|:$|$)"), F.lit("")), F.when(language == "TypeScript", part(code, r"\)\s*:\s*([^(){};]+?)\s*(?:[{;]|$)")).when(language == "Go", part(F.regexp_replace(code, r"^func\s+\([^)]*\)", "func"), r"^\s*(?:func\s+)?\w+(?:\[[^\]]*\])?\s*\((?:[^()]++|\([^()]*+\))*+\)\s*(.*?)\s*\{?$")).otherwise(""))))
    empty = F.array().cast("array<string>")
    java_returns = F.when((language == "Java") & (F.col("kind") == "Method"), F.array(F.regexp_extract(code, rf"^\s*+{MODIFIERS}(?:{GENERIC}\s+)?(\w[\w<>\[\],.? ]*?)\s+\w+\s*\(", 2)))
    decorates = F.when(language.isin("Python", "TypeScript"), F.transform("marks", lambda m: F.regexp_replace(m, r"^@|\(.*$", "")))
    typed = F.when(F.col("kind").isin("Field", "StaticField", "Constant", "Variable") & ~((language == "Go") & (F.col("kind") == "Constant")), F.array(by_language(FIELD_TYPE, code)))
    pairs = (("Extends", extends), ("Implements", implements), ("Throws", throws), ("Imports", imports), ("Returns", returns), ("Returns", java_returns), ("Decorates", decorates), ("HasType", typed))
    found = F.concat(*(as_targets(F.filter(F.coalesce(names, empty), lambda n: ~n.isin("", "None", "void", "()")), kind) for kind, names in pairs))
    owner = F.when(F.col("kind") != "Import", F.col("qualified_name"))
    return decls.select("path", "at", "line", owner.alias("owner"), F.explode(found).alias("r")).select("path", "at", "line", "owner", "r.kind", "r.target", "r.arity")


def loose(rows: DataFrame) -> DataFrame:
    """(path, at, line, owner, kind, target, arity) of statements that declare nothing: types embedded in Go's structs and interfaces are extended, and names that a TypeScript file exports from elsewhere are exported again."""
    code = F.trim(F.col("code"))
    none = F.array().cast("array<string>")
    embedded = (F.col("language") == "Go") & F.col("d").isNull() & held_by().isin("Class", "Interface") & code.rlike(r"^[*~]?[A-Za-z_][\w.]*(?:\[.*\])?(?:\s*\|\s*~?[\w.]+)*(?:\s*\"\")?$")
    types = F.transform(F.split(F.regexp_replace(code, r"\s*\"\"$", ""), r"\s*\|\s*"), lambda x: F.regexp_replace(x, "^[*~]+", ""))
    exported = (F.col("language") == "TypeScript") & code.rlike(r"^export\s+(?:type\s+)?\{.*\}")
    module = F.nullif(F.regexp_extract("raw", r"\bfrom\s*[\"'`]([^\"'`]*)[\"'`]", 1), F.lit(""))
    listed = F.transform(split_top(F.regexp_extract(code, r"\{(.*)\}", 1)), lambda x: F.regexp_replace(x, r"^type\s+", ""))
    name = lambda x: F.when(module.isNotNull(), F.concat(module, F.lit("."), F.regexp_extract(x, r"^([\w$]+)", 1))).otherwise(F.regexp_extract(x, r"([\w$]+)$", 1))
    found = F.concat(as_targets(F.when(embedded, types).otherwise(none), "Extends"), as_targets(F.when(exported, F.transform(listed, name)).otherwise(none), "Reexports"))
    owner = F.when(embedded, joined(separator(), F.concat("head", "names")))
    return rows.filter(((F.col("language") == "Go") & F.col("d").isNull()) | ((F.col("language") == "TypeScript") & says("code", "export"))).select("path", "at", "line", owner.alias("owner"), F.explode(found).alias("r")).select("path", "at", "line", "owner", "r.kind", "r.target", "r.arity")


def extract(files: DataFrame, first_id: int = 0, compat: bool = False) -> SourceGraph:
    """The graph of source files (path, content, ext, hash): a File node for each, its declarations, and edges by name.

    Ids go by file and line, so the same files get the same ids. Of an inherent or trait
    implementation the type itself is the owner, and gets no second node. Parameters lie
    behind HasParameter, imports behind Imports (or Reexports), all else behind Contains.
    """
    rows = materialise(with_names(scoped_statements(files)), "statements")
    decls = materialise(declarations(rows), "declarations")
    code, language = F.col("code"), F.col("language")
    holder = F.try_element_at("scope", F.lit(-1))
    said = F.regexp_replace(F.regexp_replace(code, "->", "→"), "=>", "⇒")
    generic = F.when(F.col("kind").isin("Class", "Interface", "Enum", "Function", "Method", "TypeAlias"), F.regexp_extract(said, rf"\b(?:class|interface|record|struct|trait|enum|type|fn|function)\s+\w+\s*({GENERIC})", 1)).otherwise("")
    go_generic = F.when((language == "Go") & F.col("kind").isin("Class", "Interface", "Function"), F.regexp_extract(code, r"^\s*(?:type|func)\s+\w+\s*\[(.*?)\]\s*(?:struct|interface|\()", 1)).otherwise("")
    parts = split_top(F.regexp_replace(F.regexp_replace("inner", "→", "->"), "⇒", "=>"))
    decls_more = decls.withColumns({"g": generic, "go_generic": go_generic}).withColumn("inner", F.when(F.col("g") != "", F.expr("substr(g, 2, length(g) - 2)")).otherwise(F.col("go_generic"))).withColumn("parts", parts)
    in_interface = F.coalesce(holder["kind"] == "Interface", F.lit(False))
    note = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    static = F.when(code.rlike(r"^\s*(?:\w+\s+)*static\b"), note("static", F.lit("true")))
    noted = F.filter(F.array(static, F.when(F.col("alias").isNotNull(), note("alias", F.col("alias"))), F.when((F.col("kind") == "Import") & F.col("qualified_name").endswith("*"), note("wildcard", F.lit("true")))), lambda x: x.isNotNull())
    own_type = F.when(F.col("kind").isin("Field", "StaticField", "Constant", "GlobalVariable", "Variable"), F.nullif(by_language(FIELD_TYPE, code), F.lit("")))
    nodes = decls_more.filter("kind <> 'Impl'").select(
        F.col("path").alias("file"), (F.col("at") + 1).alias("ordinal"), "position", "kind", "name", "qualified_name", "line", "end", "language", F.when(F.col("kind") == "Variable", "Unspecified").otherwise(F.col("visibility")).alias("visibility"), "parent", F.lit(None).cast("string").alias("hash"),
        (code.rlike(r"\babstract\s") | (F.col("kind").isin("Method") & in_interface & ~F.contains(code, F.lit("{")))).alias("is_abstract"), code.rlike(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:[a-z]+\s+)*async\b").alias("is_async"),
        F.coalesce((F.col("kind") == "Method") & F.when(language == "Java", F.col("name") == holder["name"]).otherwise(F.col("name").isin("__init__", "constructor")), F.lit(False)).alias("is_constructor"),
        F.col("marks").alias("attributes"), F.transform("parts", lambda p: F.regexp_extract(p, r"^(?:const\s+)?('?\w+)", 1)).alias("generic_params"), F.filter("parts", lambda p: p.rlike(r"[:]|\bextends\b") | ((language == "Go") & p.rlike(r"\w\s+\S"))).alias("generic_bounds"),
        own_type.alias("type_annotation"), F.map_from_entries(noted).alias("metadata"),
    )
    tops = files.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("ordinal"), F.lit(0).alias("position"), F.lit("File").alias("kind"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("path").alias("qualified_name"), F.lit(0).alias("line"), (F.size(F.split("content", "\n")) - 1).alias("end"), language_of(F.col("ext")).alias("language"), F.lit("Public").alias("visibility"), "hash")
    taken = parameters(decls)
    inputs = taken.select(F.col("path").alias("file"), (F.col("at") + 1).alias("ordinal"), "position", F.lit("Parameter").alias("kind"), "name", "qualified_name", "line", "end", "language", F.lit("Unspecified").alias("visibility"), "parent", F.col("type").alias("type_annotation"))
    every = nodes.unionByName(tops, allowMissingColumns=True).unionByName(inputs, allowMissingColumns=True)
    every = materialise(every.withColumn("ordinal", F.struct("ordinal", "position")), "found")
    numbered = materialise(assign_ids(every, first_id), "entities")
    full = numbered.select(*(numbered_column(numbered, f) for f in NODES.fields))

    own = numbered.select("file", "id", "qualified_name", "kind")
    owners = materialise(own.filter("kind <> 'Parameter'").groupBy(F.col("file").alias("path"), F.col("qualified_name").alias("owner")).agg(F.min("id").alias("src")), "owners")
    file_ids = own.filter("kind = 'File'").select(F.col("file").alias("path"), F.col("id").alias("file_id"))
    none = lambda kind: F.lit(None).cast(kind)
    entity = (F.col("file").alias("path"), (F.col("ordinal.ordinal") - 1).alias("at"), "line")
    held = numbered.filter("kind <> 'File'").select(*entity, F.col("parent").alias("owner"), none("long").alias("src"), F.when(F.col("kind") == "Parameter", "HasParameter").when(F.col("kind") == "Import", F.when((F.col("language") == "Rust") & (F.col("visibility") == "Public"), "Reexports").otherwise("Imports")).otherwise("Contains").alias("kind"), F.col("id").alias("to_id"), none("string").alias("to_name"), none("int").alias("call_arity"))
    types = numbered.filter("kind = 'Parameter' and type_annotation is not null").select(*entity, none("string").alias("owner"), F.col("id").alias("src"), F.lit("HasType").alias("kind"), none("long").alias("to_id"), F.col("type_annotation").alias("to_name"), none("int").alias("call_arity"))
    refs = references(rows)
    refs = refs if compat else within_file(refs, owners.select("path", F.col("owner").alias("qualified_name")))
    edge = ("path", "at", "line", "owner", "kind", "target", "arity")
    named = heritage(decls).unionByName(loose(rows)).unionByName(refs.select(*edge)).select("path", "at", "line", "owner", none("long").alias("src"), "kind", none("long").alias("to_id"), F.col("target").alias("to_name"), F.col("arity").alias("call_arity"))
    # What no owner of the file is found for is the file's own.
    found = held.unionByName(types).unionByName(named).join(owners.withColumnRenamed("src", "by_name"), ["path", "owner"], "left").join(file_ids, "path")
    found = found.select("path", "at", "line", F.coalesce("src", "by_name", "file_id").alias("src"), "kind", "to_id", "to_name", "call_arity")
    edges = found.withColumns({"file": F.col("path"), "ordinal": F.struct("line", "at", "kind", "src", F.coalesce("to_name", F.lit("")), F.coalesce("to_id", F.lit(-1).cast("long")))})
    edges = assign_ids(materialise(edges, "edges"), first_id).withColumn("to_state", F.when(F.col("to_id").isNotNull(), "Resolved").otherwise("Unresolved"))
    return SourceGraph(full, edges.select(*(numbered_column(edges, f) for f in EDGES.fields)))


def numbered_column(df: DataFrame, field: T.StructField) -> Column:
    """The column of a schema, or its default where it is missing or null but mustn't be."""
    if field.name == "span":
        start, end = F.col("line").cast("int"), F.col("end" if "end" in df.columns else "line").cast("int")
        return F.struct(start.alias("start_line"), F.lit(0).alias("start_col"), end.alias("end_line"), F.lit(0).alias("end_col")).cast(SPAN).alias("span")
    if isinstance(field.dataType, T.BooleanType):
        default = F.lit(False)
    elif isinstance(field.dataType, T.ArrayType):
        default = F.array().cast(field.dataType)
    elif isinstance(field.dataType, T.MapType):
        default = F.create_map().cast(field.dataType)
    else:
        default = F.lit(None).cast(field.dataType)
    kind = field.dataType.simpleString()  # a cast can't promise that an array has no nulls
    return (F.coalesce(F.col(field.name).cast(kind), default) if field.name in df.columns else default).alias(field.name)
