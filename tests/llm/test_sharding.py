import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.llm.sharding import cut_points, hilbert_index, hilbert_shards, write_shards
from tests.llm.data import documents


def test_curve_visits_each_cell_once_and_moves_one_step(spark):
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = spark.range(side**n).selectExpr(*(f"cast(id div {side**i} % {side} as int) as x{i}" for i in range(n)))
        rows = hilbert_index(cells, [f"x{i}" for i in range(n)], bits, "h").orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(side**n))
        for a, b in zip(rows, rows[1:], strict=False):
            assert sum(abs(a[f"x{i}"] - b[f"x{i}"]) for i in range(n)) == 1


def test_shards_hold_all_rows_evenly(spark):
    docs = documents(spark)
    for shards in (8, 3):
        got = hilbert_shards(docs, shards=shards, groups=4).collect()
        by = defaultdict(list)
        for r in got:
            by[r["shard"]].append(r)
        counts = [len(by[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == docs.count()
        assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
        along = [r["hilbert"] for s in range(shards) for r in sorted(by[s], key=lambda r: r["slot"])]
        assert along == sorted(along)
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_curve_keeps_alike_metadata_together(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "concat('l', id % 4) as lang", "concat('s', id % 7) as source", "id % 100 as n_chars")
    spread = hilbert_shards(docs).join(docs.drop("text"), "doc_id").groupBy("shard").agg({"lang": "approx_count_distinct"}).toPandas()
    assert spread.iloc[:, 1].mean() <= 3
    assert math.isclose(len(spread), 8)


def test_empty_table(spark):
    assert hilbert_shards(documents(spark, [])).count() == 0


def test_whole_strings_and_fractions_are_cut(spark):
    docs = spark.range(800).selectExpr("id as doc_id", "'t' as text", "concat('https://a.long.common.prefix/of/all/paths/', lpad(id, 5, '0')) as url", "id / 1e9 as share")
    for dim in ("url", "share"):
        cuts = cut_points(docs, [dim], 3)[dim]
        assert len(cuts) == 7
        assert [docs.filter(F.col(dim) <= c).count() for c in cuts] == [100 * i for i in range(1, 8)]
        along = hilbert_shards(docs, dims=(dim,), bits=3).join(docs, "doc_id").groupBy("shard").agg(F.min(dim).alias("a"), F.max(dim).alias("b")).orderBy("a").collect()
        assert all(x["b"] < y["a"] for x, y in zip(along, along[1:], strict=False))


def test_null_and_repeated_ids_spread(spark):
    docs = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as doc_id", "cast(id as string) as text", "'en' as lang", "'s' as source", "1 as n_chars")
    got = hilbert_shards(docs, groups=16).toPandas()
    assert len(got) == 3000 and got.groupby("shard").size().tolist() == [375] * 8
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_too_many_cells_are_refused(spark):
    with pytest.raises(ValueError):
        hilbert_shards(documents(spark), bits=6)


def test_files_are_skipped_on_every_dimension(spark, tmp_path):
    docs = spark.range(8000).selectExpr("id as doc_id", "cast(id as string) as text", "concat('l', lpad(id % 16, 2, '0')) as lang", "concat('common-prefix-', lpad(hash(id) % 50 + 50, 3, '0')) as source", "abs(hash(id, 1)) % 1000 as n_chars", "'kept' as cell")
    path = str(tmp_path / "shards")
    write_shards(docs, path, shards=32)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    for dim, value in (("lang", "l03"), ("source", "common-prefix-040"), ("n_chars", 500)):
        files = back.groupBy(F.input_file_name().alias("f")).agg(F.min(dim).alias("a"), F.max(dim).alias("b")).collect()
        hit = sum(r["a"] <= value <= r["b"] for r in files)
        assert len(files) == 32 and hit <= 20, (dim, hit)
