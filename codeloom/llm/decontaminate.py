"""Benchmark decontamination by a positional inverted index, in SQL expressions only.

Test windows (ten consecutive words of an item) are looked up in the training
text by an index of postings (term, text, position). Corpus counts tell which
terms of a window are rarest; only postings of such anchor terms are stored. The
list of a window's rarest term, shifted by its offset, gives the possible starts;
each is kept if the next rarest term's list has its place too, or one up to ``slop``
words off. What is left is compared with the text word by word: an exact match has the
window's words side by side, a proximity match has them in order with up to ``slop``
other words between.

Texts are compared in blocks of words, so that a text with many candidates is read
once, however long it is. What is broadcast is derived from the test set and from the
contaminated texts; its bytes are checked, and beyond the bound the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.scratch import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_IN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a text that are compared at a time.
BLOCK = 128
#: A term that is more than one in so many words is joined apart where the terms are too many to ship; there are fewer of them than this.
HEAVY = 10_000


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, with A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD_IN_ANY_CASE), "")).cast("long")


def text_key(id_column: str) -> Column:
    """Identifies id and text of a row; repeated rows share it."""
    id_text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(id_text).cast("string"), F.lit("|"), id_text, F.coalesce(F.col("text"), F.lit("")))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table lacks."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fits(df: DataFrame, most: int, *texts: str) -> bool:
    """Whether a table of short rows with these text columns stays within ``most`` bytes as a broadcast hash table."""
    width = sum((F.octet_length(t) for t in texts), F.lit(96))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0] <= most


def small(df: DataFrame, fit: bool) -> DataFrame:
    """A broadcast side if it fits, else a plain one."""
    return F.broadcast(df) if fit else df


def test_windows(items: DataFrame, length: int) -> DataFrame:
    """item_id, wid, phrase (space-joined words), w (the words) and n: every window of ``length`` words, or a shorter item's words.

    ``wid`` is a hash of the phrase; should two phrases share one, both are compared with the text.
    """
    split = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.array("w"), lambda w: F.transform(starts_of(w, length), lambda i: F.slice(w, i, length)))[0]
    phrases = split.select("item_id", F.explode(cut).alias("w")).select("item_id", F.array_join("w", " ").alias("phrase"), "w", F.size("w").alias("n")).distinct()
    return phrases.withColumn("wid", F.xxhash64("phrase"))


def starts_of(w: Column, length: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(w) - (length - 1), F.lit(1)))


def anchored_windows(windows: DataFrame, docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(wid, n, term, offset, term2, offset2): the two rarest terms of each window by count over all the texts; and the counts of heavy terms, where the terms are too many to ship.

    Of a one-word window both are the same. Windows with a term that no text has are
    left out, for they cannot occur.
    """
    terms = windows.select("phrase", "wid", "n", "w").distinct().select("phrase", "wid", "n", F.posexplode("w").alias("offset", "term"))
    terms = materialise(terms, "test-terms")
    vocabulary = terms.select("term").distinct()
    spoken = docs.select(F.explode_outer(words(F.col("text"))).alias("term"))
    heavy = None
    if fits(vocabulary, most, "term"):
        counts = spoken.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))
    else:
        counts = materialise(spoken.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences")), "word-counts")
        heavy = counts.filter(F.col("occurrences") * HEAVY > counts.agg(F.sum("occurrences")).first()[0]).select("term")
    of_window = Window.partitionBy("phrase")
    ranked = (
        terms.join(counts, "term", "left")
        .withColumn("place", F.row_number().over(of_window.orderBy("occurrences", "offset")))
        .withColumn("known", F.count("occurrences").over(of_window) == F.count(F.lit(1)).over(of_window))
        .filter(F.col("known") & (F.col("place") <= 2))
    )
    at = lambda place, field: F.max(F.when(F.col("place") == F.least(F.lit(place), F.col("n")), F.col(field)))
    both = ranked.groupBy("phrase", "wid", "n").agg(at(1, "term").alias("term"), at(1, "offset").alias("offset"), at(2, "term").alias("term2"), at(2, "offset").alias("offset2"))
    return materialise(both.drop("phrase").distinct(), "anchors"), heavy


def postings(docs: DataFrame, anchors: DataFrame, heavy: DataFrame | None, most: int, id_column: str = "doc_id") -> DataFrame:
    """The index: key, term and position for each occurrence of the anchor terms, as a stored table."""
    # The key is a column before the words are exploded, else it would be hashed again for each
    # word; and an outer explode isn't led by a filter that splits each text once more.
    spoken = docs.select(text_key(id_column).alias("key"), words(F.col("text")).alias("w")).select("key", F.posexplode_outer("w").alias("pos", "term"))
    terms = anchors.select(F.explode(F.array("term", "term2")).alias("term")).distinct()
    if heavy is None:
        found = spoken.join(F.broadcast(terms), "term", "left_semi")
    else:
        rest = spoken.join(F.broadcast(heavy), "term", "left_anti")
        found = spoken.join(F.broadcast(terms.join(heavy, "term", "left_semi")), "term", "left_semi").unionByName(rest.join(terms, "term", "left_semi"))
    return materialise(found.select("term", "key", "pos"), "postings")


def phrase_candidates(index: DataFrame, anchors: DataFrame, length: int, slop: int, most: int) -> DataFrame:
    """key, wid, n, base, exact: where a window would start by its rarest term, with the next rarest one at its place (exact) or up to ``slop`` words off.

    Only windows of ``length`` words are looked for with other words between.
    """
    found = index.join(small(anchors, fits(anchors, most, "term", "term2")), "term").select("key", "wid", "n", (F.col("pos") - F.col("offset")).alias("base"), F.col("term2").alias("term"), "offset2", (F.col("offset2") - F.col("offset")).alias("after")).filter("base >= 0")
    low = F.when((F.col("n") < length) | (F.col("after") >= 0), 0).otherwise(-slop)
    high = F.when((F.col("n") < length) | (F.col("after") <= 0), 0).otherwise(slop)
    found = found.select("key", "wid", "n", "base", "term", "offset2", F.explode(F.sequence(low, high)).alias("off"))
    found = found.select("key", "wid", "n", "base", "off", "term", (F.col("base") + F.col("offset2") + F.col("off")).alias("pos"))
    found = found.join(index, ["key", "term", "pos"], "left_semi")
    return found.groupBy("key", "wid", "n", "base").agg(F.max(F.col("off") == 0).alias("exact"))


def blocks(docs: DataFrame, keys: DataFrame, wanted: DataFrame, size: int, fit: bool, id_column: str) -> DataFrame:
    """key, block and w: the wanted blocks of BLOCK words of the texts with these keys, with ``size`` words more of what follows."""
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    pieces = F.regexp_extract_all(lowered, F.lit(rf"(?:{WORD}+{NOT_WORD[:-1]}*+){{1,{BLOCK}}}"), F.lit(0))
    pairs = F.transform(F.array(pieces), lambda own: F.zip_with(own, F.slice(own, F.lit(2), F.size(own)), lambda a, b: F.struct(a.alias("own"), b.alias("more"))))[0]
    texts = docs.select(text_key(id_column).alias("key"), "text").join(small(keys, fit), "key", "left_semi")
    cut = texts.select("key", pairs.alias("pairs")).select("key", F.posexplode_outer("pairs").alias("block", "p")).join(small(wanted, fit), ["key", "block"], "left_semi").dropDuplicates(["key", "block"])
    return cut.select("key", "block", F.concat(words(F.col("p.own")), F.slice(words(F.col("p.more")), 1, size)).alias("w"))


def spread(pattern: Column, w: Column, first: Column, slop: int) -> Column:
    """How many other words lie between the pattern's words, taken in order and each as early as can be, from the place ``first`` (from 0) on; null if they aren't there."""
    step = lambda at, word: F.when(at >= -1, F.when(F.array_position(F.slice(w, at + 2, slop + 1), word) > 0, at + F.array_position(F.slice(w, at + 2, slop + 1), word).cast("int")).otherwise(-2)).otherwise(-2)
    last = F.aggregate(pattern, first - 1, step)
    starts_here = F.try_element_at(w, first + 1) == F.element_at(pattern, 1)
    return F.when(starts_here, F.transform(F.array(last), lambda end: F.when(end >= 0, end - first + 1 - F.size(pattern)))[0])


def matches(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 2, most: int = 64 << 20, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, phrase, n, start, others) of each match, and the windows of the items; both stored.

    ``others`` counts the words between: 0 for an exact match, which starts at ``start``.
    The key is ``text_key``.
    """
    windows = materialise(test_windows(items, length), "windows")
    anchors, heavy = anchored_windows(windows, docs, most)
    index = postings(docs, anchors, heavy, most, id_column)
    low = F.greatest(F.col("base") - slop, F.lit(0))
    found = phrase_candidates(index, anchors, length, slop, most)
    found = materialise(found.withColumn("block", F.floor(low / BLOCK).cast("int")), "candidates")
    wanted = found.select("key", "block").distinct()
    keys = found.select("key").distinct()
    cut = blocks(docs, keys, wanted, length + 2 * slop, fits(wanted, most // 2), id_column)
    phrases = windows.select("wid", "phrase", F.col("w").alias("pattern")).distinct()
    told = found.join(cut, ["key", "block"]).join(small(phrases, fits(phrases, most // 2, "phrase")), "wid")
    base = F.col("base") - F.col("block") * BLOCK
    exact = F.col("exact") & (F.slice("w", base + 1, F.col("n")) == F.col("pattern"))
    near = (F.col("n") == length) & (F.size(F.array_except("pattern", F.slice("w", F.greatest(base - slop, F.lit(0)) + 1, length + 2 * slop))) == 0)
    ways = F.array_min(F.transform(F.sequence(F.greatest(base - slop, F.lit(0)), base), lambda s: spread(F.col("pattern"), F.col("w"), s, slop)))
    # What is exact from another start is found from there.
    others = F.when(exact, 0).when(near & (ways <= slop), F.greatest(ways, F.lit(1)))
    matched = told.select("key", "phrase", "n", F.col("base").alias("start"), others.cast("int").alias("others")).filter("others is not null")
    return materialise(matched, "matches"), windows


def items_of(found: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """(key, ids): the sorted ids of the items that a text has windows of."""
    named = windows.select("phrase", "item_id")
    return found.select("key", "phrase").distinct().join(small(named, fits(named, most, "phrase", "item_id")), "phrase").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 10, slop: int = 2, max_bytes: int = 64 << 20) -> DataFrame:
    """Which texts hold windows of test items.

    Returns every row of ``docs`` with its own columns and n_words, n_hit (words inside
    any exactly matched window), n_items, items_sha256 (of the sorted, comma-joined ids of
    items with an exactly matching window), contaminated (n_hit > 0) and n_near_items
    (items with a window that matches exactly or, being of full length, with up to
    ``slop`` other words between). An item of fewer than ``length`` words, but not none,
    is one window; empty and null items have none. Null and empty texts have no words and
    no hits. Repeated rows are each reported. Null item ids count as an empty id. Columns
    of ``docs`` named like the added ones are replaced, all others kept. An empty table on
    either side gives no hits.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    matched, windows = matches(docs, items, length, slop, max_bytes)
    exact = matched.filter("others = 0")
    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    new_words = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hits = exact.select("key", "start", "n").distinct().select("key", new_words.alias("new")).groupBy("key").agg(F.sum("new").cast("long").alias("n_hit"))
    per_item = items_of(exact, windows, max_bytes).select("key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    near = items_of(matched, windows, max_bytes).select("key", F.size("ids").cast("long").alias("n_near_items"))
    found = materialise(near.join(hits.join(per_item, "key"), "key", "left"), "contaminated")

    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")
    kept = docs.drop(*added)
    key = fresh(kept, "key")
    rows = kept.withColumns({key: text_key("doc_id"), "n_words": word_count(F.col("text"))})
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return (
        rows.join(small(found.withColumnRenamed("key", key), fits(found, max_bytes, "items_sha256")), key, "left").drop(key)
        .withColumns({"n_hit": zero("n_hit"), "n_items": zero("n_items"), "items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "n_near_items": zero("n_near_items")})
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
