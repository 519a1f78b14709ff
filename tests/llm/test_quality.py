import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import quality as q
from codeloom.sources.tables import table
from tests.llm.data import documents


def test_fit_minimises_the_pairwise_logistic_loss():
    pick = np.random.default_rng(2)
    y = np.array([0, 1] * 30)
    x = pick.normal(size=(60, 3)) + y[:, None] * [1.0, 0.5, 0.0]
    model = q.fit(x, y, pairs=4_000, at=0.3)
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    again = np.random.default_rng(11)
    d = z[again.choice(good, 4_000)] - z[again.choice(bad, 4_000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 5e-4 * w @ w
    best = loss(model["weights"])
    for step in np.concatenate([np.eye(3), -np.eye(3)]) * 0.02:
        assert loss(model["weights"] + step) >= best
    slow = np.zeros(3)
    for _ in range(3_000):  # plain gradient descent comes to the same place
        p = 1 / (1 + np.exp(d @ slow))
        slow += 0.3 * ((d * p[:, None]).mean(axis=0) - 1e-3 * slow)
    assert np.allclose(slow, model["weights"], atol=1e-2)
    # The threshold is the quantile of the scores at the share of label 0.
    assert abs((q.apply_model(x, model) >= 0.3).sum() - 30) <= 1


def test_held_out_rows_are_told_apart(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    out = q.held_out("doc_id", 5, 0)
    got = q.quality_scores(docs, labels, train_on=~out).filter(out).join(labels, "doc_id").select("quality", "score", "predicted").toPandas()
    assert len(got) > 300
    assert (got["quality"] == got["predicted"]).mean() > 0.97
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_scores_depend_on_the_text_alone_and_labels_of_held_out_rows_on_nothing(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    train = ~q.held_out("doc_id", 5, 0)
    first = {r["doc_id"]: r["score"] for r in q.quality_scores(docs, labels, train_on=train).collect()}
    turned = labels.withColumn("quality", F.when(q.held_out("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("else")})
    assert first == {r["doc_id"]: r["score"] for r in q.quality_scores(moved, turned, train_on=train).collect()}


def test_awkward_rows_and_labels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 20)] + [(1, 0, 0), (1, 1, 0), (None, 1, 0), (5, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.quality_scores(docs, labels)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 < r["score"] < 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]  # equal texts tie; null is scored as empty
    assert q.quality_scores(docs.limit(0), labels).count() == 0
    for kind in (0, 1):  # one kind of label, and none
        assert {r["score"] for r in q.quality_scores(docs, labels.filter(F.col("quality") == kind)).collect()} == {0.5}
    assert {r["score"] for r in q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
