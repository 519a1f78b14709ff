"""Which terms and which other sources a source's documents diverge from, by dominance skybands.

Terms are counted for each (lang, source) group, and each term's share of a group is
held against its share of the whole lang and of every other source of it. The value of
a difference grows with the group's share and falls with the other one's, so a term
stands behind every term that has at least its count in the group, at most its count in
the lang, and an earlier name. A term behind ``k`` others can't be among the first k:
every partition keeps the terms that fewer than k of its others dominate (its skyband),
skybands are merged by group and salt and then by group, and what is left, a few
hundred terms of a group however large it is, is ranked exactly.

Sources are compared in tiles of a bounded number of sources and terms. A tile has the
head of each of its sources (its share of a term that it lacks), so a pair of sources
costs one row for thousands of terms. Terms that neither source has are added by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.decontaminate import fits, small
from codeloom.llm.language_model import in_slices, split_tokens
from codeloom.sources.scratch import materialise

#: What shares are scaled by, and what is added to every count.
SCALE, ADDED = 1_000_000_000, 2
#: Bytes of text that a task counts at once.
SLICE = 32 << 20
#: Sources of a side of a tile, terms of a tile, and terms that it compares at once.
SOURCES, TERMS, CHUNK = 128, 4096, 64
#: Rows that wait for a skyband, and terms whose dominators are counted at once.
WAITING, BLOCK = 1 << 17, 256
#: A letter stands for itself in lower case, any other ASCII byte for a space; bytes beyond ASCII stay.
LETTERS = bytes(ord(chr(i).lower()) if chr(i).isalpha() and i < 128 else i if i > 127 else 32 for i in range(256))


def only_letters(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and every other ASCII character a space; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(ends) or ends[-1] == ends[0]:
        return texts
    data = texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().translate(LETTERS)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(data))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences in a group, and its rows that have the term; summed in each slice before the shuffle, stored."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_slices(batches, SLICE):
            lengths, numbers, distinct = split_tokens(only_letters(rows.column("text")))
            if not len(numbers):
                continue
            groups = pa.StructArray.from_arrays([rows.column("lang"), rows.column("source")], names=["lang", "source"])
            names: dict[tuple, int] = {}
            of_row = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
            of_doc, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * len(distinct) + numbers, return_counts=True)
            key, at = np.unique(of_row[of_doc // len(distinct)] * len(distinct) + of_doc % len(distinct), return_inverse=True)
            listed = list(names)
            group = (key // len(distinct)).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([listed[g][0] for g in group], pa.string()), pa.array([listed[g][1] for g in group], pa.string()),
                    pa.array(distinct, pa.binary()).take(pa.array(key % len(distinct))).cast(pa.string()),
                    pa.array(np.bincount(at, n, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key))),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    counted = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact; null where no term is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", (wide(count) + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kept) * ADDED) + 1).cast("long")


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square stays within a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def skyband(count: np.ndarray, other: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The rows that fewer than ``k`` others dominate: those with at least their count, at most their other count, and a lower place.

    In order of falling count, rising other count and place, every row comes after those
    that dominate it. If one of these has been left out, k kept ones dominate it and so the row.
    """
    order = np.lexsort((place, other, -count))
    other, place = other[order], place[order]
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), BLOCK):
        o, p = other[at : at + BLOCK], place[at : at + BLOCK]
        behind = ((other[kept][None, :] <= o[:, None]) & (place[kept][None, :] < p[:, None])).sum(axis=1)
        own = (o[None, :] <= o[:, None]) & (p[None, :] < p[:, None])
        behind += np.tril(own, -1).sum(axis=1)
        kept = np.concatenate([kept, at + np.flatnonzero(behind < k)])
    return order[kept]


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's rows (lang, source, term, n, total), those in the skyband of their group among those that the partition holds at once."""
    def cut(table: pa.Table) -> pa.Table:
        place = np.asarray(pc.rank(table.column("term"), tiebreaker="first")).astype(np.int64)
        group = np.asarray(pc.rank(table.column("lang"), tiebreaker="dense")).astype(np.int64) * (len(table) + 1) + np.asarray(pc.rank(table.column("source"), tiebreaker="dense")).astype(np.int64)
        n, total = np.asarray(table.column("n")), np.asarray(table.column("total"))
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
        kept = [order[a:b][skyband(n[order[a:b]], total[order[a:b]], place[order[a:b]], k)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return table.take(pa.array(np.concatenate(kept)))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            waiting.append(batch)
            size += batch.num_rows
            if size > WAITING:
                left = cut(pa.Table.from_batches(waiting))
                if len(left) > WAITING // 2:  # many groups: those before have had their say
                    yield from left.to_batches()
                    waiting, size = [], 0
                else:
                    waiting, size = left.to_batches(), len(left)
        if size:
            yield from cut(pa.Table.from_batches(waiting)).to_batches()

    return rows.mapInArrow(prune, rows.schema)


def leading_terms(rows: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The first ``k`` terms of each group (lang, source, term, n, p, total, q), in exact order: (lang, source, item, value, rank)."""
    fields = ["lang", "source", "term", "n", "total", "p", "q"]
    bands = skybands(rows.filter("p > q").select(*fields), k)
    bands = bands.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts))).repartition("lang", "source", "salt").select(*fields)
    bands = skybands(skybands(bands, k).repartition("lang", "source"), k)
    valued = bands.withColumn("value", difference(F.col("p"), F.col("q")))
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return valued.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= k).select("lang", "source", F.col("term").alias("item"), "value", "rank")


def tile_sums(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, a, b, value, seen): the differences of each pair of sources summed over the terms that a tile has, and their number.

    ``groups`` has lang, source, p0 (its share of a term that it lacks), block, blocks and
    parts; ``rows`` has the shares p of the terms that a source has.
    """
    lower = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def in_tiles(side: DataFrame) -> DataFrame:
        """A row for each tile that its block is a side of."""
        other = side.withColumn("other", lower)
        return other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    heads = in_tiles(groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).select("lang", "i", "j", "part", F.lit(None).cast("string").alias("term"), "source", "block", F.col("p0").alias("p"))
    terms = in_tiles(rows.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))).select("lang", "i", "j", "part", "term", "source", "block", "p")
    key = ["lang", "i", "j", "part"]
    dealt = heads.unionByName(terms).repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, found = None, None
        for batch in batches:
            columns = [batch.column(c) for c in key]
            cells = list(zip(*(c.to_pylist() for c in columns), strict=True))
            terms, sources, blocks, p = (batch.column(c).to_pylist() for c in ("term", "source", "block", "p"))
            for cell, term, source, block, x in zip(cells, terms, sources, blocks, p, strict=True):
                if cell != tile:
                    if found:
                        yield found.result()
                    tile, found = cell, Tile(*cell[:3])
                found.add(term, source, block, x)
        if found:
            yield found.result()

    return dealt.mapInArrow(compare, "lang string, a string, b string, value long, seen long")


class Tile:
    """The sources of two blocks, and the sums of their differences over the terms added so far; terms come one after another."""

    def __init__(self, lang: str, i: int, j: int):
        self.lang, self.i, self.j = lang, i, j
        self.sides: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.empty: tuple[list[int], list[int]] = ([], [])
        self.sums: np.ndarray | None = None
        self.cells: list[tuple[int, int, int, int]] = []
        self.term, self.chunk, self.seen = None, -1, 0

    def add(self, term: str | None, source: str, block: int, p: int | None) -> None:
        for side, own in enumerate((self.i, self.j)):
            if block == own:
                if term is None:
                    self.sides[side][source] = len(self.empty[side])
                    self.empty[side].append(0 if p is None else p)
                else:
                    if term != self.term:
                        self.term = term
                        self.chunk += 1
                        self.seen += 1
                    if self.chunk == CHUNK:
                        self.fold()
                        self.chunk = 0
                    self.cells.append((side, self.chunk, self.sides[side][source], p))

    def fold(self) -> None:
        if self.sums is None:
            self.sums = np.zeros((len(self.empty[0]), len(self.empty[1])), np.int64)
        if self.cells:
            cells = np.array(self.cells, np.int64)
            one, two = (np.tile(np.array(e, np.int64), (CHUNK, 1)) for e in self.empty)
            for side, shares in enumerate((one, two)):
                own = cells[cells[:, 0] == side]
                shares[own[:, 1], own[:, 2]] = own[:, 3]
            for t in range(int(cells[:, 1].max()) + 1):
                p, q = one[t][:, None], two[t][None, :]
                self.sums += (p - q) ** 2 // (p + q)
            self.cells = []

    def result(self) -> pa.RecordBatch:
        self.fold()
        a, b = list(self.sides[0]), list(self.sides[1])
        n = len(a) * len(b)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * n, pa.string()), pa.array([x for x in a for _ in b], pa.string()), pa.array(b * len(a), pa.string()), pa.array(self.sums.ravel()), pa.array(np.full(n, self.seen))],
            names=["lang", "a", "b", "value", "seen"],
        )


def source_distances(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) for each other source (item) of a source's lang."""
    one_way = tile_sums(groups, rows).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # Within a tile of one block each pair comes from both ends; across blocks it comes once.
    block = lambda x: groups.select("lang", F.col("source").alias(x), F.col("block").alias(f"block_{x}"), F.col("p0").alias(f"p0_{x}"), *(["terms"] if x == "a" else []))
    fit = fits(groups, 32 << 20, "lang", "source")
    known = one_way.filter("a <> b").join(small(block("a"), fit), ["lang", "a"]).join(small(block("b"), fit), ["lang", "b"])
    rest = (F.col("terms") - F.col("seen")) * difference(F.col("p0_a"), F.col("p0_b"))
    valued = known.select("lang", "a", "b", "block_a", "block_b", F.when(F.col("terms") > 0, F.col("value") + rest).otherwise(0).alias("value"))
    ends = F.when(F.col("block_a") == F.col("block_b"), F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")))).otherwise(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = valued.select("lang", "value", F.explode(ends).alias("e")).select("lang", "e.source", "e.item", "value")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence_audit(docs: DataFrame, least_docs: int = 10, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each (lang, source), all other sources of the lang (``pair``) and its ``k`` leading terms (``term``).

    Terms are runs of letters and non-ASCII characters, with A-Z lower-cased. Each lang
    keeps the terms that ``least_docs`` of its rows have. With counts smoothed by two, a
    term's share is one more than the billionfold, cut to a whole number, and a
    difference is floor((p - q)^2 / (p + q)). ``pair`` sums differences over all kept
    terms, zero where there are none; ``term`` has terms that occur in the group and have a
    greater share there than in the lang. Ranks go by falling value, then by the item's
    UTF-8 bytes.

    A null text, lang or source is an empty one. Groups without terms take part. Repeated
    rows each count; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = term_counts(docs)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "total")
    rows = materialise(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept-terms")
    of_lang = materialise(rows.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all")), "langs")
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    named = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").withColumn("sum", F.coalesce("sum", F.lit(0)))
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    blocks = F.ceil(F.col("sources") / SOURCES).cast("int")
    groups = named.join(sizes, "lang").join(of_lang, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    groups = groups.select(
        "lang", "source", "sum", "terms", "all", share(F.lit(0), F.col("sum"), F.col("terms")).alias("p0"),
        F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"), blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int").alias("parts"),
    )
    groups = materialise(groups, "groups")
    shares = rows.join(small(groups, fits(groups, 32 << 20, "lang", "source")), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("sum"), F.col("terms"))).withColumn("q", share(F.col("total"), F.col("all"), F.col("terms")))
    pairs = source_distances(groups, shares).withColumn("part", F.lit("pair"))
    terms = leading_terms(shares, k).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
