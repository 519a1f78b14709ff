import numpy as np
import pandas as pd
import pytest
import xxhash

from codeloom.llm import near_dedup as nd
from codeloom.operators.components import connected_components
from tests.llm.data import documents


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(ids, prints):
    x = np.array([p % (1 << 64) for p in prints], np.uint64)
    parent = list(range(len(x)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 2):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(x))]
    least = {}
    for r, d in zip(roots, ids, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(r) for r in roots]


def test_fingerprints_match_bit_by_bit(spark):
    docs = documents(spark)
    got = nd.fingerprints(docs).collect()
    texts = [r["text"] for r in docs.collect()]
    assert [r["fp"] % (1 << 64) for r in got] == [slow_fingerprint(t) for t in texts]


def test_classes_match_brute_force(spark):
    got = nd.near_duplicate_classes(documents(spark)).toPandas()
    want = slow_classes([None if pd.isna(d) else int(d) for d in got["doc_id"]], got["fp"].tolist())
    assert [None if pd.isna(c) else int(c) for c in got["component_id"]] == want
    assert len(got) == documents(spark).count()


@pytest.mark.parametrize("cap", [1, 3, 64])
def test_links_connect_all_near_pairs(spark, cap):
    pick = np.random.default_rng(7)
    base = pick.integers(0, 2**63, 40, dtype=np.uint64)
    near = [int(b) ^ (1 << int(pick.integers(64))) ^ (1 << int(pick.integers(64))) for b in base for _ in range(6)]
    values = sorted({*map(int, base), *near, 0, 1, 3, 7, 15, 2**64 - 1, 2**64 - 2})
    fps = spark.createDataFrame([(nd.signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(nd.links(fps, cap=cap)).collect()}
    got = [roots.get(nd.signed(v), nd.signed(v)) for v in values]
    want = slow_classes(list(range(len(values))), values)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_thresholds_are_the_cheapest_that_sum():
    costs = [[0, 5, 50, 500], [0, 9, 10, 11], [0, 100, 1000, 9999]]
    assert nd.allocate(costs, 0) == [-1, 2, -1]
    groups = nd.group_bits(100, np.diag(np.full(64, 50)), 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_empty_table(spark):
    assert nd.near_duplicate_classes(documents(spark, [])).count() == 0
