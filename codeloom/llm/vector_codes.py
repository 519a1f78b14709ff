"""Short codes of vectors: a codebook for each part of a vector, learnt by Lloyd's rounds over cover trees.

Every vector is cut into parts. Each partition builds a cover tree of its own for each
part once, over tiles of its vectors, and stores it: a node has a point, a radius that
all points below it keep to, and the range of those points in the tree's order, whose
cumulative sums give the node's sum by one difference.

In a round the nodes of a level meet all codebook entries at once. If the nearest entry
is nearer to a node's point than the next one by more than twice its radius, it is the
nearest of all points below, and count and sum of the whole subtree go to it. Other
nodes hand over to their children, and only leaves that stay in doubt compare their
points one by one. Sums are added up by Spark, and an entry's new place is decided from
them by whole-number division. The codebooks, a number of entries fixed by parameters,
are all that passes through the driver.

Everything is exact: components are whole numbers, distances are compared in doubles only
where these hold every value that can occur, and as Python integers beyond that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.decontaminate import fits, fresh, small
from codeloom.llm.topk import EXACT, LONG
from codeloom.sources.scratch import materialise

#: Vectors of a tree, and points that a leaf may hold.
TILE, LEAF = 1024, 4
#: Distances are roots of whole numbers below 2**53, so their errors are below this.
MARGIN = 1e-6
#: Sums travel in digits of so many bits.
DIGIT = 62


class CoverTree(NamedTuple):
    """Points in the tree's order with the rows they are of, and its nodes level by level: where a node's points begin and end, the place of its own point, its radius, and its children (none for a leaf)."""

    rows: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    own: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of each x to each y; exact."""
    if x.dtype == object or y.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) for q in y.tolist()] for p in x.tolist()], object).reshape(len(x), len(y))
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def narrow(x: np.ndarray) -> bool:
    """Whether doubles hold every step of ``squares`` of such points exactly."""
    return x.dtype != object and float(np.abs(x).max(initial=0)) < (EXACT / (8 * max(x.shape[1], 1))) ** 0.5


def cover_tree(points: np.ndarray) -> CoverTree:
    """The tree of some points. Each level halves the reach: a node's children are points of it farther apart than that, each with those points within it that no earlier child took."""
    n = len(points)
    order = np.arange(n)
    begin, end, own, radius, child, children = [], [], [], [], [], []

    def node(a: int, b: int, reach: np.ndarray) -> None:
        begin.append(a)
        end.append(b)
        own.append(a)
        radius.append(float(np.sqrt(reach.max())))
        child.append(0)
        children.append(0)

    away: list[np.ndarray] = []  # squared distances of a node's points to its own
    if n:
        away.append(squares(points, points[:1])[:, 0])
        node(0, n, away[0])
    at = 0
    while at < len(begin):
        a, b, far = begin[at], end[at], away[at]
        if b - a > LEAF and radius[at] > 0:
            child[at] = len(begin)
            reach = (radius[at] / 2) ** 2
            left, parts, taken = order[a:b], [], far
            while len(left):
                within = taken <= reach
                within[0] = True
                parts.append((left[within], taken[within]))
                left = left[~within]
                if len(left):
                    taken = squares(points[left], points[left[:1]])[:, 0]
            order[a:b] = np.concatenate([p for p, _ in parts])
            for p, d in parts:
                node(a, a + len(p), d)
                away.append(d)
                a += len(p)
            children[at] = len(parts)
        away[at] = far[:0]
        at += 1
    as_ints = lambda x: np.array(x, np.int32)
    return CoverTree(order.astype(np.int32), points[order], as_ints(begin), as_ints(end), as_ints(own), np.array(radius), as_ints(child), as_ints(children))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def nearest(tree: CoverTree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes whose points all go to one entry, and those entries; and the points in doubt, with theirs.

    Of equally near entries the first is taken: a subtree goes whole only if no other entry can be as near to any of its points.
    """
    whole, to, alone, single = [], [], [], []
    level = np.arange(min(len(tree.begin), 1))
    while len(level):
        d = squares(tree.points[tree.own[level]], book)
        best = d.argmin(axis=1)
        roots = np.sqrt(d)
        first = roots[np.arange(len(level)), best]
        roots[np.arange(len(level)), best] = np.inf
        sure = (tree.radius[level] == 0) | (first + 2 * tree.radius[level] + MARGIN < roots.min(axis=1))
        whole.append(level[sure])
        to.append(best[sure])
        level = level[~sure]
        leaves = tree.children[level] == 0
        points = ranges(tree.begin[level[leaves]], tree.end[level[leaves]] - tree.begin[level[leaves]])
        alone.append(points)
        single.append(squares(tree.points[points], book).argmin(axis=1))
        level = level[~leaves]
        level = ranges(tree.child[level], tree.children[level])
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]).astype(np.int64) for x in (whole, to, alone, single))


def entry_sums(tree: CoverTree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number and the sum of the points that go to each entry, by cumulative sums for whole subtrees."""
    whole, to, alone, single = nearest(tree, book)
    counts = np.bincount(to, tree.end[whole] - tree.begin[whole], len(book)) + np.bincount(single, minlength=len(book))
    points = tree.points.astype(np.int64)
    sums = np.zeros(book.shape, np.int64)
    cumulative = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    np.add.at(sums, to, cumulative[tree.end[whole]] - cumulative[tree.begin[whole]])
    np.add.at(sums, single, points[alone])
    return counts.astype(np.int64), sums


def entries_of(tree: CoverTree, book: np.ndarray) -> np.ndarray:
    """Each row's entry."""
    whole, to, alone, single = nearest(tree, book)
    found = np.empty(len(tree.rows), np.int64)
    size = tree.end[whole] - tree.begin[whole]
    found[ranges(tree.begin[whole], size)] = np.repeat(to, size)
    found[alone] = single
    by_row = np.empty_like(found)
    by_row[tree.rows] = found
    return by_row


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``: doubles where distances of such numbers are exact in them, else Python integers."""
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    if narrow(v):
        return v
    return np.array([[int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(r, s, strict=True)] for r, s in zip(v.tolist(), x.tolist(), strict=True)], object).reshape(v.shape)


def integers(x: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [i * length // parts for i in range(parts + 1)]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector isn't null and has only finite components, none of them null."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", odd))


NODES = ("rows", "points", "begin", "end", "own", "radius", "child", "children")


def tree_tiles(kept: DataFrame, length: int, parts: int, scale: int) -> DataFrame:
    """A row for each tile: its vec_ids and labels, and the cover tree of each part in bytes, without points where these are beyond doubles; stored.

    Wide tiles (with numbers beyond doubles) have their vectors as they came in ``raw``.
    """
    ids, label = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    tree = T.StructType([T.StructField(n, T.BinaryType()) for n in NODES])
    schema = T.StructType([T.StructField("ids", T.ArrayType(ids)), T.StructField("labels", T.ArrayType(label)), T.StructField("trees", T.ArrayType(tree)), T.StructField("raw", T.BinaryType())])
    edges = cuts(length, parts)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                rows = batch.slice(at, TILE)
                x = np.asarray(rows.column("embedding").flatten().cast(pa.float64())).reshape(rows.num_rows, length)
                v = whole_numbers(x, scale)
                wide = v.dtype == object
                trees = []
                if not wide:
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        t = cover_tree(v[:, a:b])
                        trees.append({n: np.ascontiguousarray(getattr(t, n) if n != "points" else t.points.astype(np.int32)).tobytes() for n in NODES})
                one = {"ids": rows.column("vec_id").to_pylist(), "labels": rows.column("label").to_pylist(), "trees": trees, "raw": x.tobytes() if wide else None}
                yield pa.RecordBatch.from_pylist([one], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return materialise(kept.select("vec_id", "label", "embedding").mapInArrow(build, schema), "cover-trees")


def stored_tree(row: dict, width: int) -> CoverTree:
    kinds = {"radius": np.float64}
    got = {n: np.frombuffer(row[n], kinds.get(n, np.int32)) for n in NODES}
    return CoverTree(**(got | {"points": got["points"].astype(np.float64).reshape(len(got["rows"]), width)}))


def digits(value: int) -> list[int]:
    """A whole number as digits of DIGIT bits, the last of them with the sign."""
    found = []
    while not -(1 << DIGIT) <= value < 1 << DIGIT:
        found.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*found, value]


def as_numbers(book: list[list[int]], width: int) -> np.ndarray:
    """A codebook of doubles where these do, else of Python integers."""
    most = max((abs(v) for row in book for v in row), default=0)
    return np.array(book, np.float64 if most < EXACT else object).reshape(len(book), width)


def assigned(tile: dict, books: list[np.ndarray], edges: list[int], scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, CoverTree | None]]:
    """For each part of a tile its points by row, their entries, and the tree where there is one that can be used."""
    wide = None if tile["raw"] is None else whole_numbers(np.frombuffer(tile["raw"]).reshape(len(tile["ids"]), edges[-1]), scale)
    for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        book, tree = books[part], None
        if wide is not None:
            points = wide[:, a:b]
        else:
            tree = stored_tree(tile["trees"][part], b - a)
            points = np.empty_like(tree.points)
            points[tree.rows] = tree.points
        if tree is not None and narrow(book):
            yield points, entries_of(tree, book), tree
        else:
            points = integers(points)
            found = [min(range(len(book)), key=lambda e: (d[e], e)) for d in squares(points, integers(book))]
            yield points, np.array(found, np.int64), None


def lloyd_round(tiles: DataFrame, books: list[np.ndarray], edges: list[int], scale: int) -> list[np.ndarray]:
    """The codebooks whose entries are moved to the floor of the mean of the points that go to them."""
    shipped = tiles.sparkSession.sparkContext.broadcast(books)
    most = max(b - a for a, b in zip(edges[:-1], edges[1:], strict=True))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        books = shipped.value
        for batch in batches:
            for tile in batch.to_pylist():
                narrow_tile = tile["raw"] is None
                for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    if narrow_tile and narrow(books[part]):
                        counts, sums = entry_sums(stored_tree(tile["trees"][part], b - a), books[part])
                    else:
                        points, to, _ = list(assigned(tile, books, edges, scale))[part]
                        counts, sums = np.bincount(to, minlength=len(books[part])), np.zeros(books[part].shape, object)
                        for row, e in zip(points, to.tolist(), strict=True):
                            sums[e] += [int(v) for v in row]
                    for e in np.flatnonzero(counts).tolist():
                        new = [int(counts[e]), *(int(s) for s in sums[e])]
                        old = total.get((part, e))
                        total[part, e] = new if old is None else [x + y for x, y in zip(old, new, strict=True)]
        rows = []
        for (part, e), values in total.items():
            cut = [digits(v) for v in values]
            for digit in range(max(map(len, cut))):
                rows.append((part, e, digit, [c[digit] if digit < len(c) else 0 for c in cut] + [0] * (most + 1 - len(cut))))
        parts, entries, places, sums = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(places, pa.int32()), pa.array(sums, pa.list_(pa.int64()))], names=["part", "entry", "digit", "sums"])

    added = tiles.mapInArrow(add, "part int, entry int, digit int, sums array<long>")
    of_entry = added.groupBy("part", "entry", "digit").agg(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(most + 1)))
    found: dict[tuple[int, int], list[int]] = {}
    for r in of_entry.collect():
        values = found.setdefault((r["part"], r["entry"]), [0] * (most + 1))
        for i in range(most + 1):
            values[i] += int(r[f"s{i}"]) << (DIGIT * r["digit"])
    moved = []
    for part, book in enumerate(books):
        rows = [[int(v) for v in row] for row in book.tolist()]
        for e in range(len(rows)):
            if (part, e) in found:
                n, *sums = found[part, e]
                rows[e] = [s // n for s in sums[: len(rows[e])]]
        moved.append(as_numbers(rows, book.shape[1]))
    return moved


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for row in book.tolist() for v in row).encode()).hexdigest()


def train_codebooks(tiles: DataFrame, books: list[np.ndarray], edges: list[int], scale: int, rounds: int) -> list[np.ndarray]:
    for _ in range(rounds):
        books = lloyd_round(tiles, books, edges, scale)
    return books


def encode(tiles: DataFrame, books: list[np.ndarray], edges: list[int], scale: int) -> DataFrame:
    """(vec_id, label, code, error): two hex digits for each part's entry, and the squared distances to the entries summed."""
    shipped = tiles.sparkSession.sparkContext.broadcast(books)
    element = lambda c: tiles.schema[c].dataType.elementType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shipped.value
        for batch in batches:
            for i, tile in enumerate(batch.to_pylist()):
                found, errors = [], 0
                for part, (points, to, _) in enumerate(assigned(tile, books, edges, scale)):
                    found.append(to)
                    to_entry = books[part][to] if points.dtype != object else integers(books[part][to])
                    square = ((points - to_entry) ** 2).sum(axis=1)
                    errors = errors + (square if square.dtype == object else square.astype(np.int64))
                codes = ["".join(f"{e:02x}" for e in row) for row in zip(*(f.tolist() for f in found), strict=True)]
                own = lambda c: batch.column(c).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([own("ids"), own("labels"), pa.array(codes, pa.string()), pa.array(np.minimum(errors, LONG - 1).astype(np.int64))], names=["vec_id", "label", "code", "error"])

    return tiles.select("ids", "labels", "trees", "raw").mapInArrow(code, f"vec_id {element('ids')}, label {element('labels')}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each vector.

    Components become ``floor(scale * x)``. A part's codebook starts as that part of the
    ``entries`` smallest vec_ids (fewer, if there are no more; of equal ids the smaller
    vectors come first, null ids last). In each of ``rounds`` rounds every part goes to its
    nearest entry, of equally near ones the first, and every entry to the floor of the mean
    of its parts; unused entries stay. ``code`` has two hex digits for each part's entry,
    ``error`` is the squared distance summed over the parts, and ``label_error`` the errors
    summed over equal labels, null ones together. Sums beyond a long are shown as its
    greatest value.

    Vectors null or with null or non-finite components take no part, and neither do those
    of another length than the first vec_id's. A length that can't be cut equally is cut as
    nearly so as it can be. Repeated rows are each counted and coded; other columns are
    ignored; a table without a label column's values, or without rows, gives what it has.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    kept = kept_vectors(vectors.select("vec_id", "label", "embedding"))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    start = first.limit(1).collect()
    length = len(start[0]["embedding"]) if start else parts
    kept = kept.filter(F.size("embedding") == length)
    edges = cuts(length, parts)
    seeds = [list(r["embedding"]) for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    seeds = whole_numbers(np.array(seeds, np.float64).reshape(len(seeds), length), scale)
    books = [as_numbers([[int(v) for v in row] for row in seeds[:, a:b].tolist()], b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    tiles = tree_tiles(kept, length, parts, scale)
    if len(seeds):
        books = train_codebooks(tiles, books, edges, scale, rounds)
    coded = materialise(encode(tiles, books, edges, scale), "vector-codes")
    name = fresh(coded, "label_error")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG - 1).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias(name))
    fit = fits(by_label.select(F.col("label").cast("string").alias("label")), 32 << 20, "label")
    wanted = small(by_label.withColumnRenamed("label", "same"), fit)
    out = coded.join(wanted, F.col("label").eqNullSafe(F.col("same")), "left")
    return out.select("vec_id", "label", "code", "error", F.col(name).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
