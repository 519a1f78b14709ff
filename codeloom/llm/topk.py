"""Exact top-k search by tiled matrix products.

Queries and vectors are cut into tiles. Every task multiplies the query tiles that
it is given with the tiles of its shard of vectors, keeps the best k of each tile
for each query, folds them into its running lists, and emits one list a query. The
lists are merged in a tree: by query and a salt first, then by query.

Query tiles travel to all tasks at once where their bytes are within a bound.
Beyond it queries are dealt into groups and vectors into shards. Each pair of a group and
a shard is a stretch of rows in one task, the queries first: the task reads these, scores
the shard's tiles as they come, and sends a list for each query. No side passes through
the driver, no row carries two tiles, and a task holds one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT, LONG = 2**53, 2**63
#: Shift and width of the text that orders scores beyond a long; components are below 2**1034 and vectors below 2**60 long.
SHIFT, WIDTH = 10**660, 661
FOUND = "query_id long, length int, vec_id long, score long, beyond string"


def whole_vectors(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as doubles, one pair for each vector length; those null or with null or non-finite components are left out."""
    if not len(column):
        return
    valid = ~np.asarray(column.is_null())
    starts = np.asarray(column.offsets, np.int64)
    values = column.values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = np.diff(starts)
    for n in np.unique(lengths[valid]):
        rows = np.flatnonzero(valid & (lengths == n))
        x = values[starts[rows][:, None] + np.arange(n)[None, :]] if n else np.zeros((len(rows), 0))
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            yield ids[rows[fine]], x[fine]


def scaled(ids: np.ndarray, x: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``floor(scale * x)`` in order of id: as doubles where products of such rows are exact in them, else as Python integers."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    with np.errstate(over="ignore"):
        v = np.floor(x * scale)
    most = np.abs(v).max(axis=1, initial=0)
    small = np.maximum(x.shape[1], 1) * most * most < EXACT
    if small.any():
        yield ids[small], v[small]
    if not small.all():
        # A double so large that scaling it overflows is a whole number.
        yield ids[~small], np.array([[int(a) if np.isfinite(a) else int(b) * scale for a, b in zip(row, raw, strict=True)] for row, raw in zip(v[~small], x[~small], strict=True)], object)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no partial sum can leave the exact range."""
    if q.dtype != object and x.dtype != object:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)
    return np.dot(whole(q), whole(x).T)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of its k highest scores, of equal scores the smaller ids; ids ascend along columns."""
    n = scores.shape[1]
    if n <= k or scores.dtype == object or max(abs(int(scores.min())), abs(int(scores.max()))) >= 2**62 // n:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    keys = scores * n + (n - 1 - np.arange(n))  # no two alike
    top = np.argpartition(keys, n - k, axis=1)[:, n - k :]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(keys, top, 1), axis=1), 1)


class Lists:
    """The running top lists of a task, by query tile; a list has no place for the query itself."""

    def __init__(self, k: int):
        self.k = k
        self.kept: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def fold(self, name: tuple, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Take in the products of a query tile and a vector tile; ``ids`` ascend."""
        scores = products(q, x)
        own = query_ids[:, None] == ids[None, :]
        at = best_of(scores, ids, min(self.k + int(own.sum(axis=1).max(initial=0)), len(ids)))
        rows, cols = np.nonzero(~np.take_along_axis(own, at, 1))
        flat_ids, flat = ids[at[rows, cols]], scores[rows, at[rows, cols]]
        name = (*name, scores.dtype == object)
        if name in self.kept:
            old = self.kept[name]
            rows, flat_ids, flat = np.concatenate([old[0], rows]), np.concatenate([old[1], flat_ids]), np.concatenate([old[2], flat])
        if flat.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -flat[i], flat_ids[i])), np.int64)
        else:
            order = np.lexsort((flat_ids, -flat, rows))
        rows, flat_ids, flat = rows[order], flat_ids[order], flat[order]
        starts = np.searchsorted(rows, rows)
        first = np.arange(len(rows)) - starts < self.k
        self.kept[name] = (rows[first], flat_ids[first], flat[first])

    def batches(self, query_ids: dict[tuple, np.ndarray], lengths: dict[tuple, int]) -> Iterator[pa.RecordBatch]:
        for (*name, _), (rows, ids, scores) in self.kept.items():
            name = tuple(name)
            flat = scores.tolist()
            beyond = [None if -LONG < s < LONG - 1 else f"{SHIFT + s:0{WIDTH}d}" for s in flat]
            cut = [min(max(s, -LONG), LONG - 1) for s in flat]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[name][rows], pa.int64()), pa.array(np.full(len(rows), lengths[name]), pa.int32()), pa.array(ids, pa.int64()), pa.array(cut, pa.int64()), pa.array(beyond, pa.string())], names=["query_id", "length", "vec_id", "score", "beyond"])


def tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """(length, ids, cells): the valid vectors of (vec_id, embedding) in tiles of one length, as bytes of longs and doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in whole_vectors(np.asarray(batch.column("vec_id"), np.int64), batch.column("embedding")):
                step = max(1, min(tile_rows, (4 << 20) // max(8 * x.shape[1], 1)))
                parts = range(0, len(ids), step)
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(parts), pa.int32()), pa.array([ids[i : i + step].tobytes() for i in parts], pa.binary()), pa.array([x[i : i + step].tobytes() for i in parts], pa.binary())], names=["length", "ids", "cells"])

    return rows.mapInArrow(pack, "length int, ids binary, cells binary")


def unpacked(ids: bytes, cells: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    return own, np.frombuffer(cells, np.float64).reshape(len(own), length)


def search_shipped(queries: DataFrame, rows: DataFrame, k: int, scale: int, tile_rows: int, tile_queries: int) -> DataFrame:
    """Lists of every query from each task's vectors; the query tiles go to all tasks."""
    shipped = rows.sparkSession.sparkContext.broadcast([(r["length"], bytes(r["ids"]), bytes(r["cells"])) for r in tiles(queries, tile_queries).collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_length: dict[int, list[tuple]] = {}
        query_ids, lengths, lists = {}, {}, Lists(k)
        for n, (length, ids, cells) in enumerate(shipped.value):
            for part, (own, q) in enumerate(scaled(*unpacked(ids, cells, length), scale)):
                of_length.setdefault(length, []).append(((n, part), own, q))
                query_ids[n, part], lengths[n, part] = own, length
        for batch in batches:
            for ids, x in whole_vectors(np.asarray(batch.column("vec_id"), np.int64), batch.column("embedding")):
                if x.shape[1] in of_length:
                    for own, v in scaled(ids, x, scale):
                        for at in range(0, len(own), tile_rows):
                            for name, q_ids, q in of_length[x.shape[1]]:
                                lists.fold(name, q_ids, q, own[at : at + tile_rows], v[at : at + tile_rows])
        yield from lists.batches(query_ids, lengths)

    return rows.mapInArrow(search, FOUND)


def search_dealt(queries: DataFrame, rows: DataFrame, k: int, scale: int, tile_rows: int, tile_queries: int, groups: int, shards: int) -> DataFrame:
    """The same lists where the queries are too many to ship: their tiles go to every shard, each vector tile to every group, and a task takes pairs of a group and a shard."""
    name = F.xxhash64("ids", "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["length", "group", "shard"]
    q = tiles(queries, tile_queries).select("length", F.pmod(name, F.lit(groups)).cast("int").alias("group"), every(shards).alias("shard"), F.lit(0).alias("side"), "ids", "cells")
    x = tiles(rows, tile_rows).select("length", every(groups).alias("group"), F.pmod(name, F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("side"), "ids", "cells")
    dealt = q.unionByName(x).repartition(*key).sortWithinPartitions(*key, "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, query_ids, lengths, lists = None, [], {}, {}, Lists(k)
        for batch in batches:
            for r in batch.to_pylist():
                pair = (r["length"], r["group"], r["shard"])
                if pair != own:
                    yield from lists.batches(query_ids, lengths)
                    own, held, query_ids, lengths, lists = pair, [], {}, {}, Lists(k)
                for ids, v in scaled(*unpacked(r["ids"], r["cells"], r["length"]), scale):
                    if r["side"] == 0:
                        query_ids[(len(held),)], lengths[(len(held),)] = ids, r["length"]
                        held.append(((len(held),), ids, v))
                    else:
                        for place, q_ids, q_v in held:
                            lists.fold(place, q_ids, q_v, ids, v)
        yield from lists.batches(query_ids, lengths)

    return dealt.mapInArrow(search, FOUND)


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, ship_bytes: int = 64 << 20, group_bytes: int = 16 << 20, shard_bytes: int = 256 << 20, tile_rows: int = 4096, tile_queries: int = 1024, salts: int = 16) -> DataFrame:
    """The k nearest rows, by integer inner product, of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; repeated rows with
    one id and vector are one query. Candidates are all rows with another vec_id, of
    the query's length, and a repeated row counts as often as it is there. Equal
    scores are ordered by vec_id. Vectors null or with null or non-finite components,
    and rows with a null vec_id, take no part. Scores are exact and ranked as such,
    however large; those beyond a long are shown as its nearest value. Other columns are
    ignored; an empty table gives no rows. Queries of up to ``ship_bytes`` are sent to
    all tasks; more are dealt into groups of ``group_bytes``, and vectors into shards of
    ``shard_bytes``.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null")
    queries = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "embedding"])
    bytes_of = lambda side: side.agg(F.coalesce(F.sum(8 * (F.size("embedding").cast("long") + 1)), F.lit(0))).first()[0]
    size = bytes_of(queries)
    options = partial(dict, k=k, scale=scale, tile_rows=tile_rows, tile_queries=tile_queries)
    if size <= ship_bytes:
        found = search_shipped(queries, rows, **options())
    else:
        found = search_dealt(queries, rows, **options(groups=-(-size // group_bytes), shards=max(1, -(-bytes_of(rows) // shard_bytes))))
    order = (F.desc("score"), F.desc("beyond"), "vec_id")
    by_query = Window.partitionBy("query_id", "length", "salt").orderBy(*order)
    merged = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    last = Window.partitionBy("query_id", "length").orderBy(*order)
    return merged.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
