import random
import re

import numpy as np

import corpus_pipeline
from codeloom.llm import near_dedup, set_join
from codeloom.llm.set_join import Likeness, jaccard_components, similar_text_classes
from codeloom.sources.tables import table
from tests.llm.data import documents


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow_kept(rows):
    """Least doc_ids of the classes by brute-force Jaccard."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({rows[find(i)][0] for i in range(len(rows))})


def altered(words, n, seed):
    pick = random.Random(seed)
    out = list(words)
    for at in pick.sample(range(len(out)), n):
        out[at] = f"new{pick.random()}"
    return " ".join(out)


def test_stage_keeps_one_text_of_each_jaccard_class(spark):
    rows = []
    for base in range(12):
        words = [f"w{random.Random(base * 1000 + i).randrange(400)}" for i in range(60 + 30 * base)]
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 2, 3, 4, 6, 8, 12, 20):
            rows.append((len(rows), altered(words, changes, base * 50 + changes)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == slow_kept(rows)


def test_stage_takes_fingerprints_first(spark, monkeypatch):
    """Copies within two bits are linked by SimHash, and the tiles compare only what it left apart."""
    words = [f"w{random.Random(i).randrange(5000)}" for i in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:-1], "other"])), (2, " ".join(["new", *words])), (3, altered(words, 8, 3)), (4, "quite another text of few words")]
    bits = lambda a, b: bin(near_dedup.fingerprint(rows[a][1], 5) ^ near_dedup.fingerprint(rows[b][1], 5)).count("1")
    assert max(bits(0, 1), bits(0, 2)) <= 2 < min(bits(i, 3) for i in range(3))
    probed, compared = [], []
    monkeypatch.setattr(near_dedup, "links", lambda fps, own=near_dedup.links: (probed.append(fps.count()), own(fps))[1])
    monkeypatch.setattr(set_join, "verified", lambda sets, pairs, like, own=set_join.verified: (compared.append({frozenset((r["a"], r["b"])) for r in pairs.collect()}), own(sets, pairs, like))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    ids = {r["doc_id"]: r["set_id"] for r in set_join.with_set_id(df).collect()}
    near = {frozenset((ids[a], ids[b])) for a, b in ((0, 1), (0, 2), (1, 2))}
    assert kept == slow_kept(rows) == [0, 4]
    assert len(probed) == 1 and len(compared[0] & near) == 2 and not compared[1] & near and compared[1]


def test_crowded_shingles_miss_nothing(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, altered(words, i % 4, i)) for i in range(60)]
    rows += [(100 + i, " ".join(words[:70]) + " " + altered(words[:20], i % 3, i)) for i in range(40)]
    rows += [(200 + i, " ".join(words[50:]) + f" end{i % 5}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cap in (2, 64):
        classes = similar_text_classes(df, cap=cap).groupBy("class_id").agg({"doc_id": "min"}).collect()
        assert sorted(r[1] for r in classes) == slow_kept(rows)


def test_awkward_rows_and_sample_match_brute_force(spark):
    docs = documents(spark).filter("doc_id is not null")
    for df in (docs, table(spark, "/root/testdata/sf0.001", "documents")):
        got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
        assert got == slow_kept({(r["doc_id"], r["text"]) for r in df.collect()})


def slow_components(rows, k=3):
    """(doc_id, set size, least doc_id reached) by brute-force Jaccard of 0.9; texts without words reach themselves."""
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((repr(d), len(sets[i]), repr(least.get(find(i)))) for i, (d, _) in enumerate(rows))


def test_components_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = [f"w{i}" for i in range(120)]
    more = [(1000 + i, altered(words[: 60 + i % 60], i % 5, i)) for i in range(150)]
    df = docs.select("doc_id", "text", "shard").unionByName(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, shard int"))
    for cap in (3, 64):
        got = sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in jaccard_components(df, cap=cap).collect())
        assert got == slow_components(rows + more)
    assert jaccard_components(df.limit(0)).count() == 0


def template_pages(n):
    """Pages of one template, a third of whose words are their own, in ten places; no two are alike."""
    words = [f"w{i}" for i in range(300)]
    def page(i):
        pick = random.Random(i)
        return " ".join(w if at % 30 < 20 else f"own{pick.random()}" for at, w in enumerate(words))
    return [(i, page(i)) for i in range(n)]


def test_template_pages_meet_nowhere(spark, monkeypatch):
    """Shingles that every page has are ranked out of the prefixes, so what is compared doesn't grow with the pages."""
    monkeypatch.setattr(set_join, "COMMON", 0)
    compared = []
    monkeypatch.setattr(set_join, "verified", lambda sets, pairs, like, own=set_join.verified: (compared.append(pairs.count()), own(sets, pairs, like))[1])
    for n in (150, 600):
        df = spark.createDataFrame(template_pages(n) + [(n, template_pages(1)[0][1] + " x")], "doc_id long, text string")
        classes = similar_text_classes(df, like=Likeness(4, 5)).groupBy("class_id").count().collect()
        assert sorted(r["count"] for r in classes) == [1] * (n - 1) + [2]
    assert sum(compared) < 20


def test_bitmaps_bound_a_pair_in_code_that_the_jvm_compiles(spark):
    pick, like, rows, want = np.random.default_rng(3), set_join.Likeness(), [], set()
    for i in range(60):
        s = pick.choice(4000, 300, replace=False)
        t = np.concatenate([s[: 300 - 3 * (i % 30)], 4000 + pick.choice(4000, 3 * (i % 30), replace=False)])
        a, b = (set_join.bitmap(x).tolist() for x in (s, t))
        one, other = ({x % set_join.BITS for x in y.tolist()} for y in (s, t))
        if min(300 - len(one - other), 300 - len(other - one)) * 9 >= 600 * 4:
            want.add(i)
        rows.append((i, 300, a, 300, b))
    pairs = spark.createDataFrame(rows, "i int, n_a int, bits_a array<long>, n_b int, bits_b array<long>")
    near = pairs.withColumns({f"spare_{x}": set_join.spare(f"n_{x}", f"bits_{x}") for x in "ab"}).repartition(2).filter(set_join.near_bits(like))
    assert {r["i"] for r in near.collect()} == want and 0 < len(want) < 60
    code = spark._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "codegen")
    assert 0 < max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000


def test_dense_groups_are_linked_by_a_few_rows_each(spark, monkeypatch):
    """What is compared of a large group of near copies grows with its rows, and with fingerprints first no class is lost."""
    compared = []
    monkeypatch.setattr(set_join, "verified", lambda sets, pairs, like, own=set_join.verified: (compared.append(pairs.count()), own(sets, pairs, like))[1])
    words = [f"w{i}" for i in range(100)]
    rows = [(i, altered(words, 1, i)) for i in range(150)] + [(1000 + i, altered(words, 7, i)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = similar_text_classes(df, cap=8, simhash=True).groupBy("class_id").agg({"doc_id": "min"}).collect()
    assert sorted(r[1] for r in classes) == slow_kept(rows)
    assert sum(compared) < 8 * len(rows)


def test_a_star_leaves_out_the_largest_class(spark):
    """In a round a tile's sets outside its largest class meet one of that class; before, all met one of any class."""
    rows = spark.createDataFrame([(1, i, 100, 7) for i in range(50)] + [(1, 100 + i, 100, 100 + i) for i in range(4)], "key long, id long, n int, root long")
    for turn in range(4):
        pairs = [tuple(r) for r in set_join.star_pairs(rows, turn, Likeness()).collect()]
        assert {b for _, b in pairs} == {100, 101, 102, 103} and len({a for a, _ in pairs}) == 1 and len(pairs) == 4
