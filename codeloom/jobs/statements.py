"""Statements of source files, from their tokens.

A pattern for each language cuts a file into comments, strings, brackets, separators and the
text between them, in Spark's regular expressions. One pass over the tokens of a file, a
Python function, follows bracket depths and indents. Round and square brackets, and those braces that
list names, are soft: nothing ends inside them. A statement ends with a semicolon, at a
brace that opens or closes a block, and in some languages with the line or at a member's
comma. Where a file breaks its lines is thus of no matter: several statements on a line,
and one over several lines, come out alike.

A file's tokens and statements stay together and in order, so files bound what a task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGE = {"java": "Java", "rs": "Rust", "py": "Python", "go": "Go", "ts": "TypeScript", "tsx": "TypeScript"}

COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
TEXT = r"\"(?:[^\"\\\n]++|\\[\s\S])*+\"?"
CHARACTER = r"'(?:[^'\\\n]|\\[^\n][^'\n]{0,8}?)'"
#: By language: comments, strings, and characters that stand alone; the rest goes in runs.
LEXICON = {
    "Java": (COMMENT, rf"\"\"\"[\s\S]*?\"\"\"|{TEXT}|{CHARACTER}", r"{}()\[\];\n"),
    "Rust": (COMMENT, rf"{TEXT}|{CHARACTER}", r"{}()\[\];\n,"),
    "Go": (COMMENT, rf"{TEXT}|`[^`]*`?|{CHARACTER}", r"{}()\[\];\n"),
    "TypeScript": (COMMENT, rf"{TEXT}|'(?:[^'\\\n]++|\\[\s\S])*+'?|`(?:[^`\\]++|\\[\s\S])*+`?", r"{}()\[\];\n"),
    "Python": (r"#[^\n]*", rf"\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z)|{TEXT}|'(?:[^'\\\n]++|\\[\s\S])*+'?", r"{}()\[\];\n"),
}
#: What doesn't stand before a Go bracket that opens no group.
NO_GROUP = r"(?<!\s\s)(?<!(?:import|const|var|type)\s?)"
#: An annotation or attribute before a declaration.
ANNOTATION = r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\))?"
ATTRIBUTE = r"#!?\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]"
#: A Python header with its block on the same line.
ONE_LINE = r"^((?:async\s+)?(?:def\s+\w+\s*\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)\s*(?:->[^:]+)?|class\s+\w+\s*(?:\((?:[^()]++|\([^()]*+\))*+\))?\s*):)\s*(\S.*)$"

#: How texts end or begin between which a line's end ends nothing, what comes before braces that list names and Go's groups, and what a Rust block of members follows.
WHITE = " \t\n\v\f\r"
LINE_END = re.compile("(?:\r\n|[\n\r\x85\u2028\u2029])\\Z")
GO_ON = re.compile(r"(?:^|[^+-])[+-]\Z|[=*/%&|^<>,.!]\Z", re.ASCII)
ON = re.compile(r"(?:[=+*/%&|^?:,.<-]|=>)\Z", re.ASCII)
NEXT = re.compile(r"^(?:[.?:&|+*/=,{)\]]|extends\b|implements\b)", re.ASCII)
GROUP = re.compile(r"\s*(import|const|var|type)\s*", re.ASCII)
TS_NAMES = re.compile(r"^\s*(?:import\b[\w\s,*$]*|export\s+(?:type\s+)?)\Z", re.ASCII)
USE = re.compile(r"(?:^|\s)use\b[\w:\s]*\Z", re.ASCII)
MEMBERS = re.compile(r"\b(?:struct|enum|union)\s+\w", re.ASCII)
ARROW = re.compile("[-=]>")
#: Characters that stand alone as tokens, and those that begin texts and comments.
ALONE, SHOWN = frozenset("{([})];\n,"), frozenset("\"'`/#")
#: What a Python statement is made of where it counts, its annotations, and its header if its block is on the same line, as Spark's patterns see them.
SAYS = re.compile(r"[^\s;,]", re.ASCII)
LEAD = re.compile(rf"\s*(?:{ANNOTATION}\s*)*", re.ASCII)
HEADER = re.compile(ONE_LINE.replace(".*", "[^\n\r\x85\u2028\u2029]*").replace("$", "(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)"), re.ASCII)
CUT = pa.schema([("path", pa.string()), ("language", pa.string()), ("sid", pa.int64()), ("line", pa.int32()), ("last", pa.int32()), ("spaces", pa.int32()), ("blank", pa.string()), ("tok", pa.string()), ("closes", pa.int32()), ("word", pa.string()), ("group", pa.bool_())])


def language_of(ext: Column) -> Column:
    return F.create_map(*(x for k, v in LANGUAGE.items() for x in (F.lit(k), F.lit(v))))[ext]


def split_top(text: Column, separator: str = ",") -> Column:
    """The trimmed pieces between separators that no bracket holds, angle brackets included, at any depth; empty ones are left out."""
    state = lambda parts, piece, depth: F.struct(parts.alias("parts"), piece.alias("piece"), depth.alias("depth"))
    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0))

    def step(s: Column, token: Column) -> Column:
        deeper = F.when(token.isin("<", "(", "[", "{"), 1).when(token.isin(">", ")", "]", "}"), -1).otherwise(0)
        more = state(s["parts"], F.concat(s["piece"], token), F.greatest(s["depth"] + deeper, F.lit(0)))
        return F.when((token == separator) & (s["depth"] == 0), state(F.concat(s["parts"], F.array(s["piece"])), F.lit(""), F.lit(0))).otherwise(more)

    trimmed = lambda parts: F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    tokens = F.regexp_extract_all(text, F.lit(rf"[-=]>|[<>()\[\]{{}}{separator}]|[^<>()\[\]{{}}{separator}=-]+|[=-]"), F.lit(0))
    # Most texts have no separator, or no bracket that could hold one.
    plain = F.when(~F.contains(text, F.lit(separator)), F.array(text)).when(~text.rlike(r"[<(\[{]"), F.split(text, re.escape(separator)))
    return trimmed(plain.otherwise(F.aggregate(tokens, start, step, lambda s: F.concat(s["parts"], F.array(s["piece"])))))


def tokens(files: DataFrame) -> DataFrame:
    """(path, language, toks): the tokens of each file in order; round brackets that hold no others, no text, comment or separator are one with what they hold."""
    rows = files.select("path", language_of(F.col("ext")).alias("language"), "content").filter("language is not null and content is not null")
    cut = F.array().cast("array<string>")
    for language, (comment, text, alone) in LEXICON.items():
        special = "\"'`/#" if language == "Python" else "\"'`/"
        simple = rf"{'' if language != 'Go' else NO_GROUP}\([^{special}{{}}()\[\];\n]*+\)"
        cut = F.when(F.col("language") == language, F.regexp_extract_all("content", F.lit(rf"{comment}|{text}|{simple}|[{alone}]|[^{special}{alone}]+|[\s\S]"), F.lit(0))).otherwise(cut)
    return rows.select("path", "language", cut.alias("toks"))


def shown(tok: str, language: str) -> str:
    """A token with comments gone and strings empty, but for their line ends."""
    if tok.startswith("#" if language == "Python" else ("//", "/*")):
        return "\n" * tok.count("\n")
    return '"' + "\n" * tok.count("\n") + '"' if len(tok) > 1 and tok[0] in "\"'`" else tok


def ends_so(pattern: re.Pattern, text: str) -> bool:
    """Whether the pattern matches up to the end, or up to a last line end."""
    return bool(pattern.search(text) or pattern.search(LINE_END.sub("", text)))


def goes_on(language: str, last: str, following: str) -> bool:
    """Whether a line's end between two texts ends no statement."""
    if language == "Python":
        return last.endswith("\\")
    if language == "Go":
        return ends_so(GO_ON, last)
    return ends_so(ON, last) or bool(NEXT.search(following))


def ending(text: str) -> str:
    """The text without the white space at its end, or before a last separator of lines."""
    return text[:-1].rstrip(WHITE) + text[-1] if text[-1:] in ("\x85", "\u2028", "\u2029") else text.rstrip(WHITE)


def indented(blank: str) -> tuple[int, bool]:
    """How far a Python statement is indented, and whether it is a header with its block on the same line."""
    text = blank.lstrip("\n")
    width = sum(4 if c == "\t" else 1 for c in text[: len(text) - len(text.lstrip(" \t"))])
    if "def" not in blank and "class" not in blank:
        return width, False
    code = re.sub(r";[ \t\n\v\f\r]*\Z", "", blank[LEAD.match(blank).end() :])
    return width, bool(HEADER.search(re.sub(r"[ \t\n\v\f\r]+", " ", code).strip(" ")))


def cut(language: str, toks: list[str]) -> Iterator[tuple]:
    """(sid, line, last, spaces, blank, tok, closes, word, group) of a file's statements in order: the lines it begins and ends on, its indent, its text without and with strings and comments, whether it closes a block, and the keyword of the group that it is in or opens."""
    python, go, rust, typescript = (language == x for x in ("Python", "Go", "Rust", "TypeScript"))
    by_line = python or go or typescript
    # What brackets hold: their depth, those that are soft, and the last token and word.
    level, soft, lead, last, hards = 0, 0, "", "", {}
    following, seen = "", -1
    sid, line, deep, blocks = 0, 0, 0, {}
    place, members, word = nothing = (None, False, None)
    angles: dict[int | None, int] = {}
    declared = False
    # The statement that is read, and how far those before it are indented.
    at, begins, opener, blanks, raws, closes, opened, group = -1, 0, None, [], [], 0, 0, False
    height, ground, ended, indent = 0, 0, -1, 0

    def statement() -> tuple:
        nonlocal height, ground, ended, indent
        blank = "".join(blanks)
        until = begins + (ending(blank).count("\n") if "\n" in blank else 0)
        if not python:
            # A brace that closes nothing counts for nothing: the lowest level so far is the ground.
            spaces = 4 * max(height - closes - ground, 0)
            height += opened
            ground = min(ground, height)
        else:
            # What follows a semicolon stands where the line's first statement does, or in its block if that has one.
            spaces = indent
            if SAYS.search(blank):
                if ended < begins:
                    spaces, header = indented(blank)
                    indent = spaces + 4 * header
                ended = until
        return at, begins, until, spaces, blank, "".join(raws), closes, opener, group

    for p, tok in enumerate(toks):
        what, ends, named, held, lines = 0, False, None, soft, 0
        blank = tok
        if tok not in ALONE:
            if tok[:1] in SHOWN:
                blank, lines = shown(tok, language), tok.count("\n")
            if rust and MEMBERS.search(tok):
                declared = True
        elif tok in "{([":
            found = GROUP.fullmatch(lead) if go and tok == "(" else None
            named = found and found[1]
            names = python or (typescript and ends_so(TS_NAMES, lead)) or (rust and ends_so(USE, lead))
            hard = hards[level] = not names if tok == "{" else named is not None
            level += 1
            if not hard:
                soft += 1
            elif held <= 0:
                what, ends = 1, True
        elif tok in "})]":
            level -= 1
            if hards.get(level, True):
                what = -1 if held <= 0 else 0
                ends = held <= 0
            else:
                soft -= 1
                held = soft
        elif held <= 0:
            if tok == ";":
                ends = True
            elif by_line and tok == "\n":
                if typescript and seen <= p:
                    following = ""
                    for seen in range(max(seen, p + 1), len(toks)):
                        if (text := shown(toks[seen], language)).strip(WHITE):
                            following = text.strip(" ")
                            break
                    else:
                        seen = len(toks)
                ends = not goes_on(language, last.strip(" "), following)
        if what:
            sid += what < 0
            deep += what
            if what > 0:
                blocks[deep] = (p, declared, named)
            place, members, word = blocks.get(deep, nothing) if deep > 0 else nothing
        stops = ends
        if rust:
            declared = declared and what >= 0 and not ends
            if "<" in blank or ">" in blank:
                plain = ARROW.sub("", blank)
                angles[place] = angles.get(place, 0) + plain.count("<") - plain.count(">")
            stops = ends or (members and held <= 0 and tok == "," and angles.get(place, 0) <= 0)
        if at != sid:
            if at >= 0:
                yield statement()
            at, begins, opener, blanks, raws, closes, opened, group = sid, line, word, [], [], 0, 0, False
        blanks.append(blank)
        raws.append(tok)
        if what:
            closes = max(closes, int(what < 0))
            opened += what if named is None and tok not in "()" else 0
            group = group or named is not None
        elif named is not None:
            group = True
        line += 1 if tok == "\n" else lines
        sid += stops
        lead = tok
        if by_line and blank.strip(WHITE):
            last = blank
    if at >= 0:
        yield statement()


def cut_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``cut`` of each file, some thousand statements at a time."""
    names, rows = CUT.names, []
    for batch in batches:
        for path, language, toks in zip(*(batch.column(c) for c in ("path", "language", "toks")), strict=True):
            path, language = path.as_py(), language.as_py()
            for row in cut(language, toks.as_py()):
                rows.append((path, language, *row))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CUT.types, strict=True)], names=names)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CUT.types, strict=True)], names=names)


def statements(files: DataFrame) -> DataFrame:
    """(path, language, at, line, last, raw, code, marks): statements in order (at), the lines they begin and end on, and their annotations or attributes.

    ``code`` has no comments, empty strings and single spaces, indented by its depth (as
    written, for Python); ``raw`` has the strings. A statement that only has annotations has
    no code. Those of a group in Go's parentheses have the group's keyword. The rows of a file
    lie together and in order, dealt out by path.
    """
    language = F.col("language")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of its own, for a join's partitions by path would stand for it, and be merged to fewer than there are cores.
    out = tokens(files.repartition(parts, F.xxhash64("path"))).mapInArrow(cut_files, "path string, language string, sid long, line int, last int, spaces int, blank string, tok string, closes int, word string, group boolean")
    marks = F.when(language == "Rust", F.lit(ATTRIBUTE)).otherwise(F.lit(ANNOTATION))
    annotated = F.when(language == "Rust", F.contains("blank", F.lit("#"))).otherwise((language != "Go") & F.contains("blank", F.lit("@")))
    lead = F.when(~annotated, F.regexp_extract("blank", r"^\s*", 0)).when(language == "Rust", F.regexp_extract("blank", rf"^\s*((?:{ATTRIBUTE}\s*)*)", 0)).otherwise(F.regexp_extract("blank", rf"^\s*((?:{ANNOTATION}\s*)*)", 0))
    out = out.withColumns({"annotated": annotated, "lead": lead}).withColumn("body", F.substr("blank", F.length("lead") + 1))
    out = out.withColumns({
        "first": F.col("line") + F.length("lead") - F.length(F.replace("lead", F.lit("\n"), F.lit(""))),
        "marks": F.when(F.col("annotated"), F.transform(F.regexp_extract_all("lead", marks, F.lit(0)), lambda m: F.regexp_replace(m, r"\s+", " "))).otherwise(F.array().cast("array<string>")),
        "code": F.trim(F.regexp_replace(F.when(language.isin("Go", "Python") & F.contains("body", F.lit(";")), F.regexp_replace("body", r";\s*$", "")).otherwise(F.col("body")), r"\s+", " ")), "raw": F.trim(F.regexp_replace("tok", r"\s+", " ")),
    })
    # A group's brackets are no statements, and its keyword is said with each of its own.
    is_group = F.coalesce("group", F.lit(False)) | ((language == "Go") & (F.col("code") == ")"))
    said = lambda c: F.when(F.col("word").isNotNull() & (F.col(c) != "") & (F.col("closes") == 0), F.concat_ws(" ", "word", c)).otherwise(F.col(c))
    out = out.filter(~is_group).withColumns({"code": said("code"), "raw": said("raw")}).filter((F.col("code").rlike(r"[^\s;,]")) | (F.size("marks") > 0))
    out = out.withColumn("header", F.when(language == "Python", F.regexp_extract("code", ONE_LINE, 1)).otherwise(""))
    one, two = F.struct("code", "spaces", "marks"), F.struct(F.regexp_extract("code", ONE_LINE, 2).alias("code"), (F.col("spaces") + 4).alias("spaces"), F.array().cast("array<string>").alias("marks"))
    pieces = F.when(F.col("header") != "", F.array(F.struct(F.col("header").alias("code"), "spaces", "marks"), two)).otherwise(F.array(one))
    cut = out.select("path", "language", "sid", F.col("first").alias("line"), "last", "raw", "closes", F.posexplode(pieces).alias("piece", "x"))
    code = F.when(F.col("x.code") == "", "").otherwise(F.concat(F.repeat(F.lit(" "), F.col("x.spaces")), F.col("x.code")))
    return cut.select("path", "language", (F.col("sid") * 2 + F.col("piece")).alias("at"), F.col("line").cast("int").alias("line"), F.greatest("line", "last").cast("int").alias("last"), "raw", code.alias("code"), F.col("x.marks").alias("marks"), F.col("x.spaces").alias("depth"), (F.col("closes") == 1).alias("closing"))
