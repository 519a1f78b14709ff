import hashlib

import numpy as np
import pytest

from codeloom.llm import vector_codes as vc
from codeloom.llm.vector_codes import vector_codes
from codeloom.sources.tables import table

FIELDS = "vec_id long, label int, embedding array<double>, code string, label_error int"


def slow_codes(rows, parts, entries, rounds, scale=1024):
    """Plain Lloyd in Python integers: (vec_id, code, error, label_error) of each row, and the codebooks' digest."""
    floor = lambda x: int(np.floor(x * scale)) if np.isfinite(x * scale) else int(x) * scale
    valid = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    valid.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    valid = [r for r in valid if len(r[2]) == len(valid[0][2])]
    d = len(valid[0][2]) if valid else parts
    cut = [i * d // parts for i in range(parts + 1)]
    vectors = [[floor(x) for x in r[2]] for r in valid]
    books, codes, errors = [], [[] for _ in valid], [0] * len(valid)
    for a, b in zip(cut[:-1], cut[1:]):
        points = [v[a:b] for v in vectors]
        book = [list(p) for p in points[:entries]]
        gap = lambda p, c: sum((x - y) ** 2 for x, y in zip(p, c))
        assign = lambda: [min(range(len(book)), key=lambda e: (gap(p, book[e]), e)) for p in points]  # noqa: B023, E731
        for _ in range(rounds):
            to = assign()
            for e in range(len(book)):
                own = [p for p, t in zip(points, to) if t == e]
                if own:
                    book[e] = [sum(x) // len(own) for x in zip(*own)]
        for i, e in enumerate(assign()):
            codes[i].append(f"{e:02x}")
            errors[i] += gap(points[i], book[e])
        books += [str(x) for c in book for x in c]
    most = 2**63 - 1
    of_label = lambda r: min(sum(min(e, most) for e, o in zip(errors, valid) if o[1] == r[1]), most)
    return sorted((repr(r[0]), "".join(c), min(e, most), of_label(r)) for r, c, e in zip(valid, codes, errors)), hashlib.sha256(",".join(books).encode()).hexdigest()


def compare(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], FIELDS).repartition(3)
    found = vector_codes(df, **options).collect()
    want, digest = slow_codes(rows, options["parts"], options["entries"], options["rounds"])
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in found) == want
    assert {r["codebooks_sha256"] for r in found} <= {digest}


def test_codes_match_plain_lloyd_rounds(spark, monkeypatch):
    monkeypatch.setattr(vc, "TILE", 64)
    pick = np.random.default_rng(2)
    middles = pick.normal(0, 0.3, (6, 8))
    rows = [(i, int(i % 3) if i % 7 else None, (middles[i % 6] + pick.normal(0, 0.02 if i % 2 else 0.3, 8)).tolist()) for i in range(300)]
    rows += [rows[5]] * 20 + [(300 + i, 1, rows[9][2]) for i in range(90)]
    compare(spark, rows, parts=4, entries=16, rounds=4)
    compare(spark, rows, parts=3, entries=5, rounds=2)


def test_awkward_vectors(spark):
    rows = [(3, 1, [0.5, 1.0, -2.0, 0.25]), (1, None, [0.1, 0.2, 0.3, 0.4]), (1, None, [0.1, 0.2, 0.3, 0.4]), (2, 1, None), (4, 0, [1.0, None, 0.0, 0.0]), (5, 0, [float("nan")] * 4), (6, 0, [float("inf"), 0.0, 0.0, 0.0]), (7, 0, [1.0, 2.0]), (None, 2, [9.0, 9.0, 9.0, 9.0]), (8, 2, [1e300, -1e300, 1e18, 3.0]), (9, 2, [1e300, 5.0, 1e18, 3.5]), (10, 2, [1e9, 5.0, 1e12, 3.5]), (11, 0, [])]
    compare(spark, rows, parts=4, entries=3, rounds=3)
    compare(spark, [(i, None, [0.0, 0.0]) for i in range(9)], parts=4, entries=4, rounds=1)
    compare(spark, [(i, 1, [0.0] * (i // 5)) for i in range(9)], parts=4, entries=4, rounds=1)
    df = spark.createDataFrame([], FIELDS)
    assert vector_codes(df).count() == 0
    with pytest.raises(ValueError):
        vector_codes(df, entries=300)


def test_sample_matches_plain_lloyd_rounds(spark):
    df = table(spark, "/root/testdata/sf0.001", "embeddings")
    found = vector_codes(df, rounds=2).collect()
    want, digest = slow_codes([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()], 4, 256, 2)
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in found) == want and {r["codebooks_sha256"] for r in found} == {digest}


def test_trees_cover_their_points_and_subtrees_go_whole():
    pick = np.random.default_rng(7)
    points = np.floor(np.concatenate([pick.normal(m, 0.02, (100, 4)) for m in pick.normal(0, 1, (8, 1))]) * 1024)
    points = np.concatenate([points, points[:50]])
    tree = vc.cover_tree(points)
    assert sorted(tree.rows.tolist()) == list(range(len(points))) and (tree.points == points[tree.rows]).all()
    for n in range(len(tree.begin)):
        below = tree.points[tree.begin[n] : tree.end[n]]
        assert np.sqrt(((below - tree.points[tree.own[n]]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-9
        kids = range(tree.child[n], tree.child[n] + tree.children[n])
        if len(kids):
            assert tree.begin[kids[0]] == tree.begin[n] and tree.end[kids[-1]] == tree.end[n]
            own = tree.points[tree.own[list(kids)]]
            apart = np.sqrt(((own[:, None] - own[None]) ** 2).sum(axis=2))
            assert (apart[~np.eye(len(own), dtype=bool)] > tree.radius[n] / 2).all()
    book = np.concatenate([points[:40:5], points[:8:2]])  # some entries twice: the first is taken
    d = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (vc.entries_of(tree, book) == d.argmin(axis=1)).all()
    whole, _, alone, _ = vc.nearest(tree, points[0:800:100])  # one entry for each heap of points
    assert len(alone) < len(points) / 2 and (tree.end[whole] - tree.begin[whole]).max() > 50
    counts, sums = vc.entry_sums(tree, book)
    assert (counts == np.bincount(d.argmin(axis=1), minlength=len(book))).all() and sums.sum() == points.sum()
