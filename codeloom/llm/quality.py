"""Quality scores by Bradley-Terry ranking.

Labelled texts give preference pairs: a text of label 1 is preferred to one of
label 0. A linear score of text features is learnt by logistic loss on the feature
differences of the pairs. The decision threshold is a quantile of the training
scores, at the share of label 0, and scores are shifted so that it lies at a fixed
value. Features come from the text alone.

Fitting takes a bounded sample of labelled rows; every row is scored, in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
LETTERS_UPPER, LETTERS_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
CHUNK = 100


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text has the given remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds == fold


def features(text: bytes) -> list[float]:
    """Ratios over the whole text: characters by kind, repetition of words and lines, word and line shapes."""
    size = max(len(text), 1)

    def share(kind: bytes) -> float:
        return (len(text) - len(text.translate(None, kind))) / size

    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    upper, lower = share(LETTERS_UPPER), share(LETTERS_LOWER)
    distinct = [len(set(words[i : i + CHUNK])) / len(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)] or [1.0]
    base = [
        share(SYMBOLS),
        share(b"!?"),
        share(b"|"),
        share(b"0123456789"),
        upper / max(upper + lower, 1e-9) if upper + lower else 0.0,
        1 - sum(distinct) / len(distinct),
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(x[-1] in SYMBOLS or x[-2:] == b"!!" for x in words) / n,
        share(b".,;:"),
        sum(map(len, words)) / n / 20,
        min(n / max(len(lines), 1), 200) / 200,
        np.log1p(len(words)) / 12,
        float(not words),
    ]
    return base + [float(np.log1p(50 * x)) for x in base[:10]]


def with_arrays(docs: DataFrame, of_text: callable, name: str, kind: T.DataType) -> DataFrame:
    """Add a column computed from the text's bytes, batch by batch."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            values = of_text([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])

    return docs.mapInArrow(of_batch, schema)


def fit(x: np.ndarray, y: np.ndarray, pairs: int, at: float, penalty: float = 1e-3, steps: int = 40) -> dict[str, np.ndarray | float]:
    """Weights from ``pairs`` random preference pairs by Newton steps, and the shift that puts the threshold at ``at``."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights, shift = np.zeros(x.shape[1]), np.log(at / (1 - at))
    if len(good) and len(bad):
        pick = np.random.default_rng(11)
        d = z[pick.choice(good, pairs)] - z[pick.choice(bad, pairs)]
        for _ in range(steps):
            p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
            gradient = -(d * p[:, None]).mean(axis=0) + penalty * weights
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(weights))
            move = np.linalg.solve(hessian, gradient)
            weights -= move
            if np.abs(move).max() < 1e-6:
                break
        scores = np.sort(z @ weights)
        below = min(max(round(len(bad) / len(y) * len(scores)), 1), len(scores) - 1)
        shift -= (scores[below - 1] + scores[below]) / 2
    else:
        shift = 0.0
    return {"mean": mean, "scale": scale, "weights": weights, "shift": shift}


def apply_model(x: np.ndarray, model: dict[str, np.ndarray | float]) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return 1 / (1 + np.exp(-np.clip(z @ model["weights"] + model["shift"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, sample: int, pairs: int, at: float) -> dict[str, np.ndarray | float]:
    """Fit on at most ``sample`` labelled rows, those of lowest hash of doc_id."""
    one = labels.filter(train_on).dropna(subset=["doc_id", "quality"]).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    chosen = one.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = with_arrays(picked, lambda texts: [features(t) for t in texts], "x", T.ArrayType(T.DoubleType())).select("quality", "x")
    rows = found.orderBy(F.xxhash64("x"), "quality").limit(sample).toPandas()
    if rows.empty:
        width = len(features(b""))
        return fit(np.zeros((1, width)), np.zeros(1), pairs, at)
    return fit(np.array(rows["x"].tolist()), rows["quality"].to_numpy(), pairs, at)


def quality_scores(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, sample: int = 20_000, pairs: int = 60_000, threshold: float = 0.3) -> DataFrame:
    """All rows of ``docs`` with score (0 to 1, higher for label 1) and predicted (1 if score >= threshold).

    Learns from the ``sample`` labelled rows of lowest id hash for which ``train_on``
    holds; of an id's conflicting labels the majority counts, label 1 on a draw, and null
    labels are none. With labels of one kind only, all scores are 0.5. Null and empty
    texts are scored by their features, like any text. Repeated rows are each scored;
    columns named like the added ones are replaced. An empty table gives no rows.
    """
    model = train(docs, labels, F.lit(True) if train_on is None else train_on, sample, pairs, threshold)
    scored = with_arrays(docs, lambda texts: apply_model(np.array([features(t) for t in texts]).reshape(len(texts), -1), model) if texts else [], "score", T.DoubleType())
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
