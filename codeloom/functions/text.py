"""Names, paths and texts as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def qualify(scope: Column, name: Column, separator: str = ".") -> Column:
    """Scope and name joined; the name alone without a scope."""
    return F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat(scope, F.lit(separator), name))


def visibility_from_modifiers(modifiers: Column) -> Column:
    """By the first of public, protected and private in the text, in this order."""
    has = lambda word: F.contains(F.coalesce(modifiers, F.lit("")), F.lit(word))
    return F.when(has("public"), "Public").when(has("protected"), "Protected").when(has("private"), "Private").otherwise("PackagePrivate")


def go_visibility(name: Column) -> Column:
    """Public if the first letter is upper case."""
    return F.when(name.rlike(r"^\p{Lu}"), "Public").otherwise("Internal")


def python_visibility(name: Column) -> Column:
    return F.when(name.startswith("_"), "Private").otherwise("Public")


def extension(path: Column) -> Column:
    """In lower case; empty without a dot after the first character of the name."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_test_file(path: Column) -> Column:
    """By the name without its last extension, or by a folder inside the path."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(file.rlike(r"^\.[^.]*$"), file).otherwise(F.regexp_replace(file, r"\.[^.]*$", ""))
    by_name = file.endswith("_test.go") | stem.startswith("test_") | stem.rlike(r"(_test|\.test|\.spec|Test|Tests|Spec|IT)$")
    return by_name | path.rlike("/(test|tests|__tests__|spec)/")


def is_test_name(kind: Column, name: Column) -> Column:
    """Names of test classes and of test methods and fixtures."""
    of_class = name.rlike("(Test|Tests|Spec|Suite)$") | (name.startswith("Test") & (F.octet_length(name) > 4))
    of_method = name.startswith("test_") | name.startswith("Test") | name.isin("setUp", "tearDown", "beforeEach", "afterEach", "beforeAll", "afterAll")
    return F.when(kind.isin("Class", "Trait"), of_class).when(kind.isin("Method", "Function"), of_method).otherwise(F.lit(False))


def title_slug(text: Column) -> Column:
    """The first heading in lower case with dashes, 50 characters at most; feature without one."""
    title = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)
    return F.when(text.rlike(r"(?m)^#\s+.+$"), slug).otherwise("feature")


def strip_preamble(text: Column) -> Column:
    """What starts at the first line with a heading; the whole text without one."""
    return F.regexp_replace(text, r"(?s)\A(?!#).*?^(?=#)".replace("(?s)", "(?sm)"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def last_of_each(keys: Column, values: Column) -> Column:
    """A map from arrays of keys and values: of equal keys the last one's value counts, and null keys are left out."""
    def made(x: Column) -> Column:
        value = lambda k: F.element_at(x["back"], F.array_position(x["from_end"], k).cast("int"))
        return F.map_from_arrays(x["once"], F.transform(x["once"], value))

    return let(keys, lambda k: let(F.struct(F.filter(F.array_distinct(k), lambda x: x.isNotNull()).alias("once"), F.reverse(k).alias("from_end"), F.reverse(values).alias("back")), made))


def text_tool_calls(text: Column) -> Column:
    """array of struct(name, arguments map) of the function blocks in a text; a parameter that a block names again has its last value."""
    names = F.regexp_extract_all(text, F.lit(r"<function=(\w+)>[\s\S]*?</function>"), 1)
    bodies = F.regexp_extract_all(text, F.lit(r"<function=\w+>([\s\S]*?)</function>"), 1)
    parameter = r"<parameter=([^>\n]+?)(?:>|\n)([\s\S]*?)</parameter>"

    def arguments(body: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(body, F.lit(parameter), 1), lambda k: F.trim(k))
        values = F.transform(F.regexp_extract_all(body, F.lit(parameter), 2), lambda v: F.regexp_replace(v, r"^\s+|\s+$", ""))
        return last_of_each(keys, values)

    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), arguments(b).alias("arguments")))


def without_tool_calls(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<function=\w+>[\s\S]*?</function>|</tool_call>", ""), r"^\s+|\s+$", "")


def source_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1 and inclusive, kept within the text, joined by line ends."""
    lines = F.split(content, "\n")
    first = F.greatest(start, F.lit(1))
    last = F.least(end, F.size(lines))
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")
