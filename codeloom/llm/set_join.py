"""Classes of texts by the Jaccard similarity of their word shingles, by an exact join in size-banded tiles.

A text is the set of its shingles, each told by 64 bits. All sets are put in one order:
shingles that are common come last. Two sets that are alike enough share one of the first
few shingles of both, their prefixes: of n shingles, so many as must meet if those that
may be missing are all there. A tile is one prefix shingle and one band of set sizes,
which doubles from band to band; a set is at home in the tiles of its own band, and a
guest in those of the next if its size is near enough to it. Sets that share a tile are a
pair, and one that shares too few tiles for the rest to make up is dropped. So is one
whose bitmaps leave too little room: a shingle sets one bit of its text's bitmap, so bits
that only one text has bound from above what two can share. Every pair left is verified
on its whole sorted sets. Order and bands decide how many pairs are compared, not which
are found.

The order comes in three steps. Shingles that a part of the texts shows to be common are
sent to the tasks, as many as a bounded array holds. If a shingle then still stands in
many prefixes, all shingles of the sets concerned are counted, those that many have get a
rank by their number, in a table that is joined, and the prefixes that hold one are cut
anew; so pages of one template meet nowhere unless they are nearly alike.

A tile that more than ``cap`` sets still share isn't paired outright: first all of its
sets outside its largest class are verified against one of that class, and again as long as
that links a good part of them, so a dense group of near copies costs a few rows each however
large it is. What is then left in different classes is paired block by block, so
that no shingle is one task; of these pairs only those are kept, once each, that share
enough crowded tiles and whose bitmaps allow it. No pair within the similarity is missed.

Where asked for, SimHash goes first (``near_dedup``): the sets of each class of its
fingerprints are verified against one of them, and pairs that this has linked aren't
compared by the tiles, which find what lies beyond the fingerprints' two bits.

Texts are read for the common shingles and for the prefixes; those of sets that have a
candidate, or whose prefix is cut anew, once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import near_dedup
from codeloom.llm.decontaminate import fits, fresh, small
from codeloom.llm.language_model import in_slices, split_tokens
from codeloom.operators.components import connected_components
from codeloom.sources.scratch import discard, materialise, scope

#: Most common shingles that are sent to the tasks; it bounds an array, not what is compared.
COMMON = 1 << 18
#: Bytes of text that a task cuts into shingles at once, and how many of its texts must hold a shingle for it to count as common there.
SLICE, HELD = 1 << 22, 3
#: Candidates' numbers that are sent to the tasks; more are joined.
SHIPPED = 1 << 22
#: Bits of a set's bitmap: a bit is set if a shingle's last bits are its number.
BITS = 1024
#: Rounds at least against one set of each crowded shingle before the rest is paired, the part that a further one must have linked (one in so many), and rows of a block of such a shingle.
ROUNDS, LINKED, BLOCK = 2, 4, 1024
#: Times that the order is mended by counted ranks where shingles crowd the prefixes.
MENDED = 2


class Likeness(NamedTuple):
    """A similarity of ``part / whole`` or more, over a half, in exact whole numbers."""

    part: int = 4
    whole: int = 5

    def prefix(self, n: int) -> int:
        """Shingles of n of which one must be shared with any set alike."""
        return n - -(-self.part * n // self.whole) + 1 if n else 0

    def holds(self, both: Column, n: Column, m: Column) -> Column:
        """Whether sets of n and m members with so many in common are alike."""
        return both * (self.part + self.whole) >= (n + m) * self.part

    def sizes(self, n: str, m: str) -> Column:
        """Whether sets of these sizes can be alike."""
        return self.holds(F.least(n, m), F.col(n), F.col(m))

    def rest(self, n: str) -> Column:
        """Members beyond the prefix."""
        return F.ceil(F.col(n) * self.part / self.whole) - 1

    def guest(self, n: Column, band: Column) -> Column:
        """Whether a set of a band below can be alike to one of ``band``."""
        return n * self.whole >= F.call_function("shiftleft", F.lit(1).cast("long"), band) * self.part


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text a number that equal words share (zero without words), and its sorted distinct shingles.

    Words are runs of other than space and ASCII white space, with A-Z lower-cased; fewer
    than ``shingle`` words are one shingle.
    """
    lengths, numbers, distinct = split_tokens(texts)
    words = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in distinct), np.uint64, len(distinct))[numbers]
    factors = [np.uint64(xxhash.xxh64_intdigest(str(i).encode(), 7) | 1) for i in range(shingle)]
    padded = np.concatenate([words, np.zeros(shingle, np.uint64)])
    mixed = np.zeros(len(words), np.uint64)
    for i, factor in enumerate(factors):
        mixed += padded[i : i + len(words)] * factor
    ids, sets, at = np.zeros(len(lengths), np.int64), [], 0
    for row, n in enumerate(lengths.tolist()):
        if n:
            ids[row] = np.uint64(xxhash.xxh64_intdigest(words[at : at + n].tobytes(), 42)).astype(np.int64)
        if n > shingle:
            found = mixed[at : at + n - shingle + 1]
        else:
            found = np.array([sum(int(w) * int(f) for w, f in zip(words[at : at + n], factors)) % (1 << 64)] if n else [], np.uint64)
        found = (found ^ (found >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        sets.append(np.unique((found ^ (found >> np.uint64(29))).view(np.int64)))
        at += n
    return ids, sets


def with_set_id(docs: DataFrame, shingle: int = 5, name: str = "set_id") -> DataFrame:
    """All columns of ``docs`` and a long that texts of equal words share, in place of a column of that name."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_slices(batches, SLICE):
            ids, _ = shingle_sets(rows.column(rows.schema.get_field_index("text")), shingle)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids)], names=[*rows.schema.names, name])

    return docs.mapInArrow(of_batch, schema)


def common_shingles(texts: DataFrame, shingle: int) -> np.ndarray:
    """The most common shingles, sorted: of those that ``HELD`` texts of a slice hold, counted over all slices of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_slices(batches, SLICE):
            ids, sets = shingle_sets(rows.column("text"), shingle)
            _, firsts = np.unique(ids, return_index=True)
            h, n = np.unique(np.concatenate([sets[i] for i in firsts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n >= HELD]), pa.array(n[n >= HELD])], names=["h", "n"])

    held = materialise(texts.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common-shingles")
    most, total = None, 0
    for r in sorted(held.groupBy(F.floor(F.log2("n")).alias("size")).count().collect(), reverse=True):
        if total + r["count"] > COMMON:
            break
        most, total = r["size"], total + r["count"]
    kept = held.filter(F.floor(F.log2("n")) >= most) if most is not None else held.limit(0)
    return np.sort(np.asarray(kept.select("h").toArrow().column("h"), np.int64))


def common_last(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set in the order that leaves the common shingles for the end."""
    last = np.zeros(len(s), bool)
    if len(common) and len(s):
        last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~last], s[last]])


def prefixes(docs: DataFrame, shingle: int, common: np.ndarray, like: Likeness, simhash: bool = False) -> DataFrame:
    """(doc_id, set_id, n, head, fp): each row's number, the size of its set, the shingles in its prefix, and with ``simhash`` its fingerprint; stored."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shipped.value
        for rows in in_slices(batches, SLICE):
            ids, sets = shingle_sets(rows.column("text"), shingle)
            heads = [common_last(s, common)[: like.prefix(len(s))] for s in sets]
            size = np.array([len(s) for s in sets], np.int32)
            prints = [pa.array(np.array([near_dedup.fingerprint(t.as_py(), shingle) for t in rows.column("text")], np.uint64).view(np.int64))] if simhash else []
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids), pa.array(size), pa.array(heads, pa.list_(pa.int64())), *prints], names=["doc_id", "set_id", "n", "head", *["fp"][: len(prints)]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(docs.select("doc_id", "text").mapInArrow(index, f"doc_id {kind}, set_id long, n int, head array<long>" + ", fp long" * simhash), "prefixes")


def simhash_pairs(index: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids to be verified: each set with one of its class of fingerprints (fp); stored."""
    prints = materialise(index.select("set_id", "fp").distinct(), "fingerprints")
    roots = connected_components(near_dedup.links(prints.select("fp").distinct())).withColumnRenamed("node", "fp")
    classes = materialise(prints.join(roots, "fp", "left").select("set_id", F.coalesce("root", "fp").alias("class_fp")), "fingerprint-classes")
    first = classes.groupBy("class_fp").agg(F.min("set_id").alias("a"), F.max("set_id").alias("most")).filter("a <> most").select("class_fp", "a")
    return materialise(classes.join(first, "class_fp").filter("a <> set_id").select("a", F.col("set_id").alias("b")), "candidates")


def shared_tiles(index: DataFrame, like: Likeness) -> DataFrame:
    """(key, h, id, n, guest, rows): the tiles that several sets share, each with the number of its sets; stored."""
    one = index.select(F.col("set_id").alias("id"), "n", F.explode_outer("head").alias("h")).filter("h is not null")
    shared = one.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least <> most").select("h")
    band = F.length(F.bin("n")) - 1
    own = F.struct(band.alias("band"), F.lit(False).alias("guest"))
    above = F.when(like.guest(F.col("n"), band + 1), F.struct((band + 1).alias("band"), F.lit(True).alias("guest")))
    hits = one.join(shared, "h").distinct().withColumn("at", F.explode(F.array_compact(F.array(own, above))))
    hits = materialise(hits.select(F.xxhash64("h", "at.band").alias("key"), "h", "id", "n", "at.guest"), "shared-tiles")
    sizes = hits.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(~F.col("guest"), 1)).alias("home")).filter("rows > 1 and home > 0")
    counted = materialise(hits.join(sizes.select("key", "rows"), "key"), "shared-tiles")
    discard(hits)
    return counted


def mended_prefixes(texts: DataFrame, index: DataFrame, crowded: DataFrame, ranked: DataFrame | None, common: np.ndarray, shingle: int, cap: int, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """``index`` and ``ranked`` (h, rank) after shingles are ranked by how many of the sets with a ``crowded`` shingle (h) in their prefix have them; stored.

    Shingles that ``cap`` of these sets have, or fewer, keep their place before all that are ranked, and ranks once given stay.
    So a prefix without a ranked shingle stays as it is, and all others are cut anew.
    """
    heads = index.select(F.col("set_id").alias("id"), F.explode("head").alias("h"))
    holders = materialise(heads.join(crowded, "h").select("id").distinct(), "wanted")
    counted = sets_of(texts, index, holders, shingle).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    new = counted.filter(F.col("df") > cap).select("h", F.floor(F.log2("df")).cast("int").alias("rank"))
    ranked = materialise(new if ranked is None else ranked.unionByName(new.join(ranked, "h", "left_anti")), "ranks")
    concerned = materialise(heads.join(ranked.select("h"), "h").select("id").distinct(), "wanted")
    sets = sets_of(texts, index, concerned, shingle)
    of_set = sets.select("id", F.explode("shingles").alias("h")).join(ranked, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "h"))).alias("last"))
    shipped = texts.sparkSession.sparkContext.broadcast(common)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shipped.value
        for batch in batches:
            found = []
            for s, last in zip(batch.column("shingles"), batch.column("last"), strict=True):
                s, ranked = np.asarray(s.values), np.asarray(last.values.field("h"))
                first = common_last(s[~np.isin(s, ranked, assume_unique=True)], common)
                found.append(np.concatenate([first, ranked])[: like.prefix(len(s))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["set_id", "cut"])

    anew = sets.select("id", "shingles").join(of_set, "id").select("id", "shingles", "last").mapInArrow(cut, "set_id long, cut array<long>")
    anew = materialise(anew, "cut-anew")
    return materialise(index.join(anew, "set_id", "left").select("doc_id", "set_id", "n", F.coalesce("cut", "head").alias("head")), "prefixes"), ranked


def sets_of(texts: DataFrame, index: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, n, bits, shingles) of the sets in ``wanted`` (id), once each; stored. Where they are few, only texts of those rows are read on."""
    few = wanted.count() <= SHIPPED
    if few:
        rows = index.select("doc_id", F.col("set_id").alias("id")).join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("doc_id").alias("doc_id")).select("doc_id").dropna().distinct()
        texts = texts.filter("doc_id is not null").join(small(rows, fits(rows, 256 << 20)), "doc_id", "left_semi").select("text").unionByName(texts.filter("doc_id is null").select("text"))
    shipped = texts.sparkSession.sparkContext.broadcast(np.sort(np.asarray(wanted.toArrow().column("id"), np.int64)) if few else None)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        for rows in in_slices(batches, SLICE):
            ids, sets = shingle_sets(rows.column("text"), shingle)
            _, firsts = np.unique(ids, return_index=True)
            kept = [i for i in firsts.tolist() if asked is None or np.searchsorted(asked, ids[i], "right") > np.searchsorted(asked, ids[i])]
            own = [sets[i] for i in kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.array([len(s) for s in own], pa.int32()), pa.array([bitmap(s) for s in own], pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], names=["id", "n", "bits", "shingles"])

    found = texts.select("text").mapInArrow(whole, "id long, n int, bits array<long>, shingles array<long>")
    found = found if few else found.join(wanted, "id", "left_semi")
    return materialise(found.dropDuplicates(["id"]), "candidate-sets")


def bitmap(s: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[s % BITS] = True
    return np.packbits(bits, bitorder="little").view("<i8")


def spare(n: str = "n", bits: str = "bits") -> Column:
    """Members of a set beyond the bits of its bitmap."""
    return F.col(n) - F.aggregate(bits, F.lit(0), lambda total, x: total + F.bit_count(x))


def near_bits(like: Likeness) -> Column:
    """Whether the bitmaps of a pair (n_a, spare_a, bits_a, n_b, spare_b, bits_b) leave room for the similarity: a bit that only one has stands for a shingle that only it has.

    So a set shares at most what its bitmap shares and what it has beyond its bits. Each word of the
    bitmaps is named once, as the JVM leaves larger code uncompiled.
    """
    shared = sum((F.bit_count(F.get("bits_a", F.lit(i)).bitwiseAND(F.get("bits_b", F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    return like.holds(F.least("spare_a", "spare_b") + shared, F.col("n_a"), F.col("n_b"))


def shared_members(pairs: DataFrame) -> DataFrame:
    """(a, b, n, m, both) of pairs with their sorted sets s and t: their sizes and what they have in common."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for s, t in zip(batch.column("s"), batch.column("t"), strict=True):
                s, t = np.asarray(s.values), np.asarray(t.values)
                s, t = (s, t) if len(s) <= len(t) else (t, s)
                found.append(int(np.count_nonzero(t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s)) if len(s) else 0)
            sizes = [pa.array([len(x) for x in batch.column(c)], pa.int64()) for c in "st"]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *sizes, pa.array(found, pa.int64())], names=["a", "b", "n", "m", "both"])

    return pairs.select("a", "b", "s", "t").mapInArrow(count, "a long, b long, n long, m long, both long")


def verified(sets: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike; stored."""
    pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
    marked = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), spare().alias(f"spare_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = materialise(pairs.join(marked("a"), "a").join(marked("b"), "b").filter(near_bits(like)).select("a", "b"), "near-pairs")
    full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("t")), "b")
    return materialise(shared_members(full).filter(like.holds(F.col("both"), F.col("n"), F.col("m"))).select("a", "b"), "links")


def rare_pairs(hits: DataFrame, cap: int, like: Likeness) -> DataFrame:
    """Pairs that share enough tiles, paired by those of ``cap`` sets at most.

    Common members up to the earlier prefix end are in both prefixes, so what two sets
    share is at most the shared tiles and the rest of one of them. Crowded tiles count as
    shared where both have them to spare. Two guests of a tile are at home in another.
    """
    crowded = hits.filter(F.col("rows") > cap).groupBy("id").agg(F.count(F.lit(1)).alias("crowded"))
    rows = hits.filter(F.col("rows") <= cap).join(crowded, "id", "left").select("key", "id", "n", "guest", F.coalesce("crowded", F.lit(0)).alias("crowded"))
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("n", "guest", "crowded")), F.col("id").alias(x)) for x in "ab")
    met = a.join(b, "key").filter((F.col("a") < F.col("b")) & ~(F.col("guest_a") & F.col("guest_b")) & like.sizes("n_a", "n_b"))
    shared = met.groupBy("a", "b", "n_a", "n_b", "crowded_a", "crowded_b").agg(F.count(F.lit(1)).alias("shared"))
    most = F.col("shared") + F.least("crowded_a", "crowded_b") + F.greatest(like.rest("n_a"), like.rest("n_b"))
    return shared.filter(like.holds(most, F.col("n_a"), F.col("n_b"))).select("a", "b")


def crowded_pairs(rows: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of different classes, by the crowded tiles (key, id, n, root) they share, that may be alike.

    ``sets`` has id, bits, crowded (all crowded tiles that it is in) and rare (how many
    others it shares with any set). A pair is made by the least crowded tile that both
    are in, and only if their bitmaps allow it.
    """
    blocked = rows.join(rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "key").join(sets, "id").withColumn("spare", spare())
    own, every = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    side = lambda x, one, two: blocked.withColumn(one, own).withColumn(two, every).select("key", "i", "j", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "root", "crowded", "rare", "spare", "bits")))
    both = F.array_intersect("crowded_a", "crowded_b")
    most = F.size(both) + F.least("rare_a", "rare_b") + F.greatest(like.rest("n_a"), like.rest("n_b"))
    a, b = side("a", "i", "j"), side("b", "j", "i")
    open_pair = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & like.sizes("n_a", "n_b")
    # The bitmaps come first: they cost a fraction of what finding the shared tiles does.
    meets = (a["key"] == b["key"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & open_pair & near_bits(like) & (F.array_min(both) == a["key"]) & like.holds(most, F.col("n_a"), F.col("n_b"))
    return a.join(b, meets).select("a", "b")


def star_pairs(rows: DataFrame, turn: int, like: Likeness) -> DataFrame:
    """Pairs (a, b) of one set of each crowded tile's largest class, another each turn, with the tile's sets (key, id, n, root) of other classes, once each."""
    one = F.struct(F.xxhash64("id", F.lit(turn)), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    classes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min(one).alias("x"))
    first = classes.groupBy("key").agg(F.max(F.struct("size", F.xxhash64("root", F.lit(turn)), "x")).alias("m")).select("key", "m.x.a", "m.x.n_a", "m.x.root_a")
    met = first.join(rows.select("key", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b")), "key").filter((F.col("root_a") != F.col("root_b")) & like.sizes("n_a", "n_b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of components after further links (a, b): what is linked already goes as one edge a node."""
    return roots if more.isEmpty() else connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def set_classes(texts: DataFrame, index: DataFrame, common: np.ndarray, shingle: int = 5, cap: int = 64, like: Likeness = Likeness(), simhash: bool = False) -> DataFrame:
    """(node, root) of all sets that are alike to another: the least set id that likenesses reach; stored. With ``simhash``, ``index`` has fingerprints, whose pairs come first."""
    likely = simhash_pairs(index) if simhash else None
    hits = shared_tiles(index, like)
    ranked = None
    for _ in range(MENDED):
        crowded = hits.filter(F.col("rows") > cap).select("h").distinct()
        crowded = materialise(crowded if ranked is None else crowded.join(ranked, "h", "left_anti"), "crowded-shingles")
        if crowded.isEmpty():
            break
        index, ranked = mended_prefixes(texts, index, crowded, ranked, common, shingle, cap, like)
        discard(hits)
        hits = shared_tiles(index, like)
    rare = materialise(rare_pairs(hits, cap, like), "candidates")
    members = materialise(hits.filter(F.col("rows") > cap).select("key", "id", "n"), "crowded-members")
    wide = hits.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("rows") > cap, F.col("key")))).alias("crowded"), F.count(F.when(F.col("rows") <= cap, 1)).alias("rare"))
    wide = materialise(wide, "crowded-sets")
    discard(hits)
    compared = rare if likely is None else rare.unionByName(likely)
    wanted = materialise(compared.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.select("id")).distinct(), "wanted")
    sets = sets_of(texts, index, wanted, shingle)
    if likely is None:
        roots = connected_components(verified(sets, rare, like))
    else:
        roots = connected_components(verified(sets, likely, like))
        of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        open_pairs = rare.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce(F.col("root_a") != F.col("root_b"), F.lit(True)))
        roots = joined(roots, verified(sets, open_pairs, like))
    rows, seen, turn, stars = None, None, 0, True
    while True:
        if roots is not seen:
            now = materialise(members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")), "crowded")
            mixed = now.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
            rows, seen = materialise(now.join(mixed, "key"), "crowded-classes"), roots
        if rows.isEmpty():
            return roots
        if not stars:
            return joined(roots, verified(sets, crowded_pairs(rows, wide.join(sets.select("id", "bits"), "id"), like), like))
        pairs = materialise(star_pairs(rows, turn, like), "pairs")
        links = verified(sets, pairs, like)
        roots, turn = joined(roots, links), turn + 1
        stars = turn < ROUNDS or links.count() * LINKED > pairs.count()


def similar_text_classes(docs: DataFrame, shingle: int = 5, cap: int = 64, like: Likeness = Likeness(), simhash: bool = False) -> DataFrame:
    """(doc_id, set_id, n, class_id) of each row, n the size of its set; a class is what likenesses (by default similarities of 4/5 or more) reach.

    With ``simhash``, near copies are sought by their fingerprints first, then by tiles; the classes are the same.

    Null and empty texts, and those of white space, have no shingles and are one class.
    Repeated rows are each reported; other columns are ignored. An empty table gives no
    rows. Only the result stays stored.
    """
    docs = docs.select("doc_id", "text")
    with scope(docs.sparkSession) as kept:
        common = common_shingles(docs, shingle)
        index = prefixes(docs, shingle, common, like, simhash)
        roots = set_classes(docs, index, common, shingle, cap, like, simhash).withColumnRenamed("node", "set_id")
        classes = materialise(index.select("doc_id", "set_id", "n").join(roots, "set_id", "left").select("doc_id", "set_id", "n", F.coalesce("root", "set_id").alias("class_id")), "classes")
        kept.append(classes)
    return classes


def jaccard_components(docs: DataFrame, shingle: int = 3, cap: int = 64, like: Likeness = Likeness(9, 10)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set of shingles, and the least doc_id that likenesses reach.

    Texts without words have empty sets and are linked with nothing, not even with each
    other. A null doc_id is never the least one unless its class has no other. Repeated rows
    are each reported and linked; other columns are ignored; an empty table gives no rows.
    """
    classes = similar_text_classes(docs, shingle, cap, like)
    linked = classes.filter("n > 0")
    least = linked.groupBy("class_id").agg(F.min("doc_id").alias("component_id"))
    found = linked.join(least, "class_id").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return found.unionByName(classes.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def without_near_copies(docs: DataFrame, shingle: int = 5, cap: int = 64, max_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, of each class of ``similar_text_classes`` the one of least doc_id; of several rows of that id with equal words, the one of least text and then of least other columns as JSON.

    Near copies are those of SimHash that verification confirms, and what the tiles find besides. Texts are shuffled only where what goes doesn't fit into ``max_bytes``, and those of
    repeated rows.
    """
    key = lambda: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(name).cast("string"))
    name = fresh(docs, "set_id")
    with scope(docs.sparkSession) as stored:
        classes = similar_text_classes(docs.select("doc_id", "text"), shingle, cap, simhash=True).withColumnRenamed("set_id", name).withColumn("key", key())
        first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select("class_id", "first.key")
        gone = materialise(classes.join(first.withColumnRenamed("key", "first"), "class_id").filter("key <> first").select("key").distinct(), "near-copies")
        again = materialise(classes.join(first.select("key"), "key", "left_semi").groupBy("key").count().filter("count > 1").select("key"), "repeated-rows")
        stored += [gone, again]
    mark = fresh(docs, "key")
    gone, again = gone.withColumnRenamed("key", mark), again.withColumnRenamed("key", mark)
    rows = with_set_id(docs, shingle, name).withColumn(mark, key())
    kept = rows.join(small(gone, fits(gone, max_bytes, mark)), mark, "left_anti")
    if not again.isEmpty():
        fit = fits(again, max_bytes, mark)
        row = F.struct(*docs.columns)
        order = F.struct("text", F.to_json(F.struct(*(c for c in docs.columns if c != "text"))))
        one = kept.join(small(again, fit), mark, "left_semi").groupBy(mark).agg(F.min_by(row, order).alias(mark + "row")).select(mark + "row.*")
        kept = kept.join(small(again, fit), mark, "left_anti").select(*docs.columns).unionByName(one)
    return kept.select(*docs.columns)
