import hashlib
import re
import time

from codeloom.llm import decontaminate as dc
from tests.llm.data import documents, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows_of(body, length):
    v = words(body)
    return [v[i : i + length] for i in range(max(len(v) - length + 1, 1))] if v else []


def slow(text, items, length=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        for x in windows_of(body, length):
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def in_order(pattern, w, first, slop):
    """Whether the pattern's words stand in order from ``first`` on, with up to ``slop`` other words between."""
    at = first
    for word in pattern[1:]:
        nxt = next((i for i in range(at + 1, len(w)) if w[i] == word), None)
        if nxt is None:
            return False
        at = nxt
    return at - first + 1 - len(pattern) <= slop


def slow_near(text, items, length=10, slop=2):
    w, found = words(text), set()
    for item, body in items:
        for x in windows_of(body, length):
            if any(w[i] == x[0] and in_order(x, w, i, slop if len(x) == length else 0) for i in range(len(w))):
                found.add(str(item))
    return len(found)


ITEMS = [(1, prose(3, 41)), (2, prose(5, 30)), (10, "One TWO"), (11, None), (12, ""), (13, "..."), (14, prose(9, 12)), (15, prose(3, 41)), (16, "never seen words here")]


def test_matches_brute_force(spark):
    docs = documents(spark)
    near = prose(9, 12).split()
    broken = [(900, " ".join([*near[:5], "zzz", *near[5:]]), None, None, 1), (901, "x " * 126 + " ".join([*near[:9], "zzz", "yyy", *near[9:]]), None, None, 1), (902, " ".join([*near[:4], "a", "b", "c", *near[4:]]), None, None, 1), (903, "one x two", None, None, 1)]
    docs = docs.unionByName(documents(spark, broken))
    docs = docs.withColumnsRenamed({"w": "Key", "shard": "wid", "n_hit": "N_Hit"}).withColumn("_key", docs["doc_id"])
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, phrase string")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((-1 if d is None else d, *slow(t, ITEMS), slow_near(t, ITEMS) if t is None or len(t) < 20_000 else -1) for d, t in texts)
    for most in (64 << 20, 0):  # broadcast, and shuffled
        got = dc.decontaminate(docs, items, max_bytes=most)
        assert set(docs.columns) - {"N_Hit"} <= set(got.columns) and "_key" in got.columns
        rows = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["n_near_items"] if len(r["text"] or "") < 20_000 else -1) for r in got.collect())
        assert rows == want
    assert any(r[5] for r in rows) and {r[0]: r[6] for r in rows}[901] == 1 and {r[0]: r[6] for r in rows}[902] == 0


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b x c y d e f"), (3, "f e d c b a"), (4, "d x x x x x x x x a b c"), (5, "b b c d"), (6, "b c c d d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    near = lambda slop: {r["doc_id"] for r in dc.decontaminate(docs, items, length=3, slop=slop).filter("n_near_items > 0").collect()}
    assert near(0) == {1, 5} and near(1) == {1, 5, 6} and near(2) == {1, 2, 5, 6}


def test_one_text_of_repeated_items_is_linear(spark):
    body = prose(7, 10)
    docs = spark.createDataFrame([(1, " ".join([body] * 30_000)), (2, "nothing")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in dc.decontaminate(docs, spark.createDataFrame([(1, body)], "item_id long, text string")).collect()}
    assert got[1]["n_words"] == got[1]["n_hit"] == 300_000 and got[2]["n_hit"] == 0
    assert time.time() - began < 60


def test_empty_tables(spark):
    docs = documents(spark)
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(docs, items).filter("contaminated").count() == 0
    assert dc.decontaminate(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
