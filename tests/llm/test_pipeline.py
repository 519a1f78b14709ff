import zlib

import numpy as np

import corpus_pipeline
from codeloom.llm.quality import held_out
from codeloom.sources.tables import table
from tests.llm.data import documents
from tests.llm.test_decontaminate import slow, slow_near
from tests.llm.test_set_join import slow_kept

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark):
    docs = table(spark, SF, "documents").cache()
    good = corpus_pipeline.quality(spark, docs, SF).cache()
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    told = [(d in kept) == bool(q) for d, q in labels.items()]
    assert np.mean(told) > 0.95

    one = corpus_pipeline.near_duplicates(spark, good, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == slow_kept([(r["doc_id"], r["text"]) for r in good.collect()])

    clean = corpus_pipeline.benchmark_leaks(spark, one, SF).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect() if not slow(r["text"], items)[4] and not slow_near(r["text"], items)}

    private = corpus_pipeline.private_data(spark, clean, SF)
    assert private.count() == clean.count() and private.columns == docs.columns
    pieces = corpus_pipeline.packing(spark, private, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in clean.collect()}
    # The whole run gives the tokens of these stages, which brute force has confirmed.
    assert whole_ids(corpus_pipeline.run(spark, SF).collect()) == whole_ids(pieces)


def whole_ids(pieces):
    found = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        found[p["doc_id"]] = found.get(p["doc_id"], b"") + bytes(p["ids"])
    return found


def test_stages_take_awkward_and_empty_tables(spark):
    awkward = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, SF)
        assert out.columns == awkward.columns, name
        assert out.count() <= awkward.count()
        assert stage(spark, awkward.limit(0), SF).count() == 0
    copies = corpus_pipeline.near_duplicates(spark, awkward, SF)
    assert copies.groupBy("text").count().filter("count > 1").count() == 0


def test_repeated_rows_have_a_defined_survivor(spark):
    """Of rows of one id with equal words, the one of least text stays, then the one of least other columns."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text.upper(), "b"), (1, text, "a"), (1, text.upper() + " ", "a"), (1, text.upper(), "a"), (2, text + " x", "a"), (None, "Q", "z"), (None, "q", "a")]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, SF).collect()), key=repr)
        assert got == sorted([(1, text.upper(), "a"), (None, "Q", "z")], key=repr)


def test_held_out_is_a_checksum(spark):
    got = spark.range(50).select("id", held_out("id", 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)
