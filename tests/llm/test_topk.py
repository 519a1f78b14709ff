import math
from fractions import Fraction

import numpy as np

from codeloom.llm.topk import exact_top_k

LONG = 2**63


def slow(rows, k, every):
    ints = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in {(i, tuple(v)) for i, v in ints if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(x))[:k]
        out |= {(q, n + 1, i, min(max(-s, -LONG), LONG - 1)) for n, (s, i) in enumerate(found)}
    return out


#: Queries sent to all tasks, and tiles of both sides joined.
WAYS = ({}, {"ship_bytes": 0, "group_bytes": 200, "shard_bytes": 3000, "tile_rows": 16, "tile_queries": 3}, {"tile_rows": 7, "tile_queries": 2})


def test_matches_brute_force(spark):
    rows = [(i, [((i * 37 + j * 11) % 17 - 8) / 7 for j in range(8)]) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [1.0, None] * 4), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (210, [0.5] * 4), (211, [0.25] * 4), (None, rows[0][1]), (5, rows[5][1]), (220, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for options in WAYS:
        got = {tuple(r) for r in exact_top_k(df, k=10, every=10, **options).collect()}
        assert got == slow(exact, 10, 10)


def test_values_beyond_exact_doubles(spark):
    rows = [(i, [float(2**40 + i), 3.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in WAYS:
        assert {tuple(r) for r in exact_top_k(df, k=3, every=10, **options).collect()} == slow(rows, 3, 10)


def test_all_sizes_of_components_in_one_batch(spark):
    sizes = [10.0**e for e in (-320, -300, -3, 0, 3, 8, 15, 16, 100, 200, 300, 305, 306, 308)]
    rows = [(i, [sign * s * (1 + i % 3), 0.75 - i % 2, -s if i % 5 == 0 else 0.5]) for i, (s, sign) in enumerate((s, sign) for s in sizes if s < 5e307 for sign in (1, -1))]
    rows += [(100, [1.0, 1.0, 0.0]), (101, [0.75, 0.5, 0.0]), (102, [1e306, 0.5, 0.0]), (103, [0.25, 0.0, 0.0]), (104, [1.7e308, -1.7e308, 1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    for options in WAYS:
        assert {tuple(r) for r in exact_top_k(df, k=10, every=4, **options).collect()} == slow(rows, 10, 4)


def test_empty_table(spark):
    for options in WAYS:
        assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), **options).count() == 0
