"""Sharding along a Hilbert curve.

Several metadata columns are quantised, each row gets the index of its cell on a
Hilbert curve, and the curve is cut into runs of equal row counts. A shard then
covers a compact box of the metadata space, so minimum and maximum statistics of
its files prune well on every one of the columns.

Plan: one scan of the metadata columns for the quantiles, one for the counts per
cell, and one of everything. Texts are measured in the scan and never shuffled.
A cell may hold any share of the rows; it is dealt out over as many sub-cells as
its count asks for, so no task sorts a whole cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.decontaminate import fresh
from codeloom.sources.scratch import discard, materialise


#: Bits of the index at most, so that there are at most 65,536 cells whatever the table holds.
MOST_BITS = 16


def as_value(df: DataFrame, name: str) -> Column:
    """The column as a long, a double or a string that orders like it."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.col(name).cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.col(name).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("string")


def text_cuts(df: DataFrame, name: str, steps: list[float]) -> list[str]:
    """Quantiles of whole strings: counts of distinct values in ranges, summed up range by range."""
    counts = df.select(as_value(df, name).alias("value")).filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialise(counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()), "text-counts")
    sums = ranged.groupBy("range").agg(F.sum("n").alias("m"))
    before = sums.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("total"))  # a row for each range
    placed = ranged.join(F.broadcast(before), "range").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("value")))
    row = placed.agg(*(F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("value"))).alias(f"q{i}") for i, q in enumerate(steps))).first()
    discard(ranged)
    return [v for v in row if v is not None]


def cut_points(df: DataFrame, dims: list[str], bits: int) -> dict[str, list]:
    """Quantile boundaries for each dimension: ``2**bits - 1`` values at most."""
    steps = [i / 2**bits for i in range(1, 2**bits)]
    texts = [d for d in dims if isinstance(df.select(as_value(df, d)).schema[0].dataType, T.StringType)]
    numbers = [d for d in dims if d not in texts]
    row = df.agg(*(F.percentile_approx(as_value(df, d), steps, 100_000).alias(d) for d in numbers)).first() if numbers else {}
    return {d: text_cuts(df, d, steps) if d in texts else list(row[d] or []) for d in dims}


def quantised(df: DataFrame, name: str, cuts: list) -> Column:
    """The number of boundaries below the value, so common values spread over the range; null counts as lowest."""
    value = as_value(df, name)
    if not cuts:
        return F.lit(0)
    return F.coalesce(sum(((value > F.lit(cut)).cast("int") for cut in cuts), F.lit(0)), F.lit(0))


def hilbert_index(df: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """Add the Hilbert index of integer coordinates in ``[0, 2**bits)``, in SQL expressions.

    The coordinates are turned into the transposed index by exclusive-or steps,
    one projection for each bit, and the bits of the axes are then interleaved.
    """
    n = len(axes)
    x = [f"_h{i}" for i in range(n)]
    out_df = df.withColumns({x[i]: F.col(a).cast("long") for i, a in enumerate(axes)})
    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            is_set = F.col(x[i]).bitwiseAND(F.lit(q)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(p))
            first = F.when(is_set, F.col(x[0]).bitwiseXOR(F.lit(p))).otherwise(F.col(x[0]).bitwiseXOR(swap))
            other = F.when(is_set, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            out_df = out_df.withColumns({x[0]: first} if i == 0 else {x[0]: first, x[i]: other})
    for i in range(1, n):
        out_df = out_df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[n - 1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)))
    out_df = out_df.withColumn("_turn", turn)
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("_turn")), level).bitwiseAND(F.lit(1))
            index = index * 2 + bit
    return out_df.withColumn(out, index).drop("_turn", *x)


def coordinates(docs: DataFrame, dims: tuple[str, ...], bits: int) -> tuple[list[str], dict[str, Column], Column]:
    """Names and columns of the quantised dimensions that the table has, and the number of their cell."""
    here = [d for d in dims if d in docs.columns] or ["doc_id"]
    if bits * len(here) > MOST_BITS:
        raise ValueError(f"{bits} bits for each of {len(here)} dimensions are more than {MOST_BITS}")
    cuts = cut_points(docs, here, bits)
    axes = [f"_q{i}" for i in range(len(here))]
    coded = {a: quantised(docs, d, cuts[d]) for a, d in zip(axes, here, strict=True)}
    packed = F.lit(0)
    for a in axes:
        packed = packed * (1 << bits) + coded[a]
    return axes, coded, packed


def write_shards(docs: DataFrame, path: str, shards: int = 8, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4) -> None:
    """Write all columns of ``docs`` as ``shards`` Parquet files, cut and sorted along the curve.

    A file's statistics then bound every dimension, and a filter on any of them skips files.
    Rows of a cell are spread by a hash of doc_id and text, so no cell is one task.
    """
    axes, coded, packed = coordinates(docs, dims, bits)
    cell, at, order = fresh(docs, "cell"), fresh(docs, "hilbert"), fresh(docs, "spread")
    cells = hilbert_index(docs.select(packed.cast("int").alias(cell), *(coded[a].alias(a) for a in axes)).distinct(), axes, bits, at).select(cell, at)
    rows = docs.withColumns({cell: packed.cast("int"), order: F.xxhash64("doc_id", "text")}).join(F.broadcast(cells), cell)
    rows.repartitionByRange(shards, at, order).sortWithinPartitions(at, order).drop(cell, at, order).write.parquet(path)


def hilbert_shards(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 4, groups: int = 4096, max_group: int = 1_000_000) -> DataFrame:
    """Deal all rows into ``shards`` runs of the curve.

    Returns doc_id, size (UTF-8 bytes of text plus 1), text_crc32, hilbert, shard
    and slot (gapless from 0 in each shard). Shard sizes differ by one row at
    most. Dimensions that the table lacks are left out; with none, all rows are
    in one cell. Null metadata is quantised as lowest and null text as empty.
    Rows of a cell are ordered by a hash of doc_id, size and checksum, then by these; rows alike in all of these are interchangeable. Other columns are
    ignored. An empty table gives no rows.
    """
    axes, coded, packed = coordinates(docs, dims, bits)

    # At most 2**MOST_BITS cells, so all of this is small.
    counts = docs.select(packed.cast("int").alias("cell"), *(coded[a].alias(a) for a in axes)).groupBy("cell", *axes).agg(F.count(F.lit(1)).alias("cell_rows"))
    along = Window.orderBy("hilbert")
    cells = (
        hilbert_index(counts, axes, bits, "hilbert")
        .withColumn("cell_start", F.sum("cell_rows").over(along) - F.col("cell_rows"))
        .withColumn("all_rows", F.sum("cell_rows").over(Window.partitionBy(F.lit(1))))
        .select("cell", "hilbert", "cell_start", "all_rows", F.ceil(F.col("cell_rows") / F.greatest(F.lit(1), F.least(F.lit(max_group), F.col("all_rows") / groups))).cast("long").alias("subs"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), packed.cast("int").alias("cell"))
    number = F.xxhash64("doc_id", "size", "text_crc32")
    rows = rows.join(F.broadcast(cells), "cell").withColumn("sub", F.pmod(number, F.col("subs"))).drop("subs")

    inside = Window.partitionBy("cell", "sub")
    ranked = rows.withColumn("_n", F.row_number().over(inside.orderBy("doc_id", "size", "text_crc32")))
    sub_counts = rows.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sub_counts.withColumn("sub_start", F.sum("_rows").over(Window.partitionBy("cell").orderBy("sub")) - F.col("_rows")).drop("_rows")
    rank = F.col("cell_start") + F.col("sub_start") + F.col("_n") - 1
    shard = F.floor(rank * shards / F.col("all_rows"))
    return (
        ranked.join(starts, ["cell", "sub"])
        .withColumn("_rank", rank.cast("long"))
        .withColumn("shard", F.expr(f"(_rank * {shards}) div all_rows").cast("int"))
        .withColumn("slot", F.expr(f"_rank - (shard * all_rows + {shards} - 1) div {shards}").cast("long"))
        .select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot")
    )
