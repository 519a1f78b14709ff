import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom.llm import language_model as lm
from codeloom.llm.language_model import language_model_scores
from codeloom.llm.quality import held_out
from codeloom.sources.tables import table
from tests.llm.data import documents


def test_base_scores_match_brute_force(spark):
    docs = documents(spark)
    train = ~held_out("doc_id", 7, 2)
    all_rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    is_held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = {}
    for d, words in all_rows:
        if not is_held(d):
            for w in [*words, "end"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    base = lambda w: sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in [*w, "end"])
    want = sorted((-1 if d is None else d, is_held(d), len(w) + 1, sum(x in counts for x in [*w, "end"]), n, round(base(w), 4)) for d, w in all_rows)
    for frequent in (262_144, 20):  # all tokens sent to the tasks, and most of them joined
        got = language_model_scores(docs, train, frequent=frequent).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model_scores(docs.limit(0), train).count() == 0


def small_model(spark, frequent=262_144):
    """A vocabulary, its tree and weights that some training moved, from small documents."""
    docs = documents(spark)
    counts = lm.count_tokens(docs)
    words, tree, _ = lm.vocabulary(counts, docs.count(), frequent)
    texts = lm.numbered_texts(docs.select("doc_id", "text"), words, ["doc_id"])
    weights = lm.train_round(texts, tree, np.zeros(1 << 12, np.float32), 0.3, 1000)
    return words, tree, texts, weights


def slow_leaf_log(tree, weights, back, leaf):
    """log10 probability of a leaf after the two leaves ``back`` (nearest first), step by step down its path."""
    bits, full = len(weights).bit_length() - 1, (1 << 32) - 1
    mix = [int(m) for m in lm.MIX]
    marks = [((back[0] + 1) * mix[0] + 1) & full, ((back[1] + 1) * mix[1] + 7) & full]
    total = 0.0
    for i in range(tree.starts[leaf], tree.starts[leaf + 1]):
        node = int(tree.nodes[i]) * mix[2] & full
        odds = float(tree.odds[tree.nodes[i]])
        for m in marks:
            x = (m ^ node ^ (node >> 16)) * mix[3] & full
            odds += float(weights[((x ^ (x >> 15)) * mix[4] & full) >> (32 - bits)])
        total -= math.log1p(math.exp(-odds if tree.second[i] else odds))
    return total / math.log(10)


def test_probabilities_of_all_tokens_sum_to_one(spark):
    for frequent in (262_144, 20):
        words, tree, _, weights = small_model(spark, frequent)
        leaves = len(tree.starts) - 1
        assert leaves == len(words.hashes) + 2 and np.abs(weights).max() > 0.1
        for back in ((-1, -1), (2, -1), (leaves - 1, 3), (1, 1)):
            assert abs(sum(10 ** slow_leaf_log(tree, weights, back, k) for k in range(leaves)) - 1) < 1e-3


def test_scores_equal_a_slow_scorer(spark):
    for frequent in (262_144, 20):
        _, tree, texts, weights = small_model(spark, frequent)
        kept = {r["rid"]: r["leaves"] for r in texts.collect()}
        for r in lm.model_scores(texts, tree, weights, ["rid"]).collect():
            seen = kept[r["rid"]]
            if len(seen) < 300:
                padded = [-1, -1, *seen]
                want = sum(slow_leaf_log(tree, weights, (padded[i + 1], padded[i]), k) - (tree.other_log if k == lm.OTHER else 0) for i, k in enumerate(seen))
                assert abs(r["model"] - want) < 1e-3 * max(1, abs(want))


def test_without_weights_the_model_is_the_unigram_model(spark):
    docs = documents(spark)
    for frequent in (262_144, 20):
        for r in language_model_scores(docs, ~held_out("doc_id", 7, 2), frequent=frequent, rounds=0).collect():
            assert abs(r["score"] - r["base_score"]) < 1e-4 * max(1, abs(r["base_score"]))
    for r in language_model_scores(docs, F.lit(False)).collect():
        assert r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) and r["score"] <= 0


def test_gradient_is_that_of_the_likelihood():
    pick = np.random.default_rng(4)
    tree = lm.class_tree(np.arange(40), pick.integers(1, 50, 40), 5, 3)
    c = np.concatenate([[-1] * 2, pick.integers(0, 42, 30)])
    at = np.arange(2, 32)
    weights = pick.normal(0, 0.2, 1 << 9).astype(np.float32)

    def loss(w):
        _, odds, second, _ = lm.decisions(tree, w, c, at)
        return -np.log(lm.taken(odds.astype(np.float64), second)).sum()

    errors, steps = np.zeros(1 << 9, np.float32), np.zeros(1 << 9, np.float32)
    assert abs(lm.add_errors(tree, weights, c, at, errors, steps) - loss(weights)) < 1e-3
    _, _, _, rows = lm.decisions(tree, weights, c, at)
    assert (steps == np.bincount(rows.ravel(), minlength=1 << 9)).all()
    for r in rows[:, 7]:
        up, down = weights.copy(), weights.copy()
        up[r] += 0.01
        down[r] -= 0.01
        assert abs((loss(up) - loss(down)) / 0.02 - errors[r]) < 0.05
    moved = lm.moved(weights, errors, steps, 0.5, 2.0)
    assert loss(moved) < loss(weights)
    assert (np.abs(moved - weights)[steps == 1] <= 0.5 / 0.75 + 1e-6).all()  # what was met once moves little


def test_every_place_trains(spark):
    """The features of every place of every training text are seen, however the texts are cut."""
    docs = documents(spark)
    words, tree, _ = lm.vocabulary(lm.count_tokens(docs), docs.count(), 262_144)
    texts = lm.numbered_texts(docs.select("doc_id", "text"), words, ["doc_id"])
    lengths, c = lm.flat_leaves(pa.array([r["leaves"] for r in texts.collect()], pa.list_(pa.int32())))
    weights = np.zeros(1 << 22, np.float32)
    rows = np.unique(lm.decisions(tree, weights, c, lm.places_of(lengths))[3])
    weights = lm.train_round(texts, tree, weights, 0.3, 1000)
    assert set(np.flatnonzero(weights)) <= set(rows) and len(np.flatnonzero(weights)) > 0.99 * len(rows)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = language_model_scores(table(spark, "/root/testdata/sf0.01", "documents"), ~held_out("doc_id", 7, 2)).toPandas()
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() * 0.97
    assert (held["score"] > held["base_score"]).mean() >= 0.6


def test_sums_are_the_same_however_texts_are_dealt(spark, monkeypatch):
    """Errors are added up over tasks, salts and parts, and every batch is some pass's."""
    monkeypatch.setattr(lm, "PART", 1 << 10)
    monkeypatch.setattr(lm, "SALTS", 3)
    docs = documents(spark)
    words, tree, _ = lm.vocabulary(lm.count_tokens(docs), docs.count(), 262_144)
    texts = lm.numbered_texts(docs.select("doc_id", "text").repartition(7), words, ["doc_id"])
    weights = np.random.default_rng(1).normal(0, 0.1, 1 << 12).astype(np.float32)
    one = lm.summed_errors(texts.coalesce(1), tree, weights, 1000)
    many = lm.summed_errors(texts.repartition(6), tree, weights, 1 << 40)
    assert np.abs(one[0] - many[0]).max() < 0.01 and (one[1] == many[1]).all() and abs(one[2] - many[2]) < 1e-6 * one[2]
    assert {r["batch"] for r in texts.select("batch").distinct().collect()} == {0, lm.WATCHED}


def test_the_method_is_the_same_for_any_size(spark, monkeypatch):
    """However many tokens there are said to be, the same rows make the same steps."""
    docs = documents(spark)
    words, tree, _ = lm.vocabulary(lm.count_tokens(docs), docs.count(), 262_144)
    steps = {}
    for tokens in (words.tokens, 1 << 23, 1 << 40):
        texts = lm.numbered_texts(docs.select("doc_id", "text"), words._replace(tokens=tokens), ["doc_id"])
        seen = []
        monkeypatch.setattr(lm, "train_round", lambda part, tree, weights, *_, seen=seen: seen.append(sorted(r["rid"] for r in part.select("rid").collect())) or weights)
        lm.train(texts, tree, 12, tokens)
        steps[tokens] = seen
    assert steps[words.tokens] == steps[1 << 23] == steps[1 << 40]
    assert len(seen) == lm.TURNS and sorted(sum(seen, [])) == sorted(r["rid"] for r in texts.select("rid").collect())
