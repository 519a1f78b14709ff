"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text has a 64-bit fingerprint. Texts are linked when their fingerprints differ
in two bits at most, and a class is what links reach. Equal fingerprints are merged
first, so copies cost one row each and no pairs.

The bits are grouped into partitions, correlated ones together. Each partition gets
its own threshold, -1 (not searched) or more, with the thresholds summing to
``distance - partitions + 1``: two fingerprints within the distance then agree within
the threshold of at least one partition. Dynamic programming picks the thresholds of
least estimated cost. Fingerprints are stored by partition value, probed with every
value within the threshold, and each candidate is verified.

A partition value may be common. Those whose holders times probers are more than
``cap`` squared are left out of the probe; all fingerprints that hold or probe one are linked through
hubs instead: each is sent to the 65 values within one bit of it, and two meet in a
hub exactly if they differ in two bits at most. A hub has 65 members at most, so this
exact way stays linear however dense a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.components import connected_components
from codeloom.sources.scratch import materialise

BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' 64-bit xxHash (seed 42); zero without words.

    Words are runs of other than space and ASCII white space, with A-Z lower-cased;
    fewer than ``shingle`` words are one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, name: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of its text as a signed long, in place of a column of that name."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            values = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(of_batch, schema)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of each row."""
    return with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bit i and bit j: 64 x 64, summed by Spark."""
    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(np.asarray(batch.column("fp")).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                total += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    both = np.zeros(BITS * BITS, np.int64)
    for row in fps.mapInArrow(of_batch, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        both[row["cell"]] = row["n"]
    return fps.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, partitions: int) -> list[list[int]]:
    """Split the bits into partitions of near equal width, each grown by the most correlated free bit."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(correlation, 0)
    free, groups = set(range(BITS)), []
    for i in range(partitions):
        width = BITS // partitions + (i < BITS % partitions)
        first = max(sorted(free), key=lambda b: correlation[b, sorted(free)].sum())
        group = [first]
        free.remove(first)
        while len(group) < width:
            best = max(sorted(free), key=lambda b: correlation[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(agree: list[float], most: int) -> list[float]:
    """P(differing bits <= t) for t up to ``most``, of independent bits that agree with the given probabilities."""
    dist = [1.0] + [0.0] * most
    for a in agree:
        dist = [dist[t] * a + (dist[t - 1] * (1 - a) if t else 0) for t in range(most + 1)]
    return list(np.cumsum(dist))


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds from -1 on, summing to ``total``, of least summed cost; ``costs[i][t + 1]`` is that of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for done, (spent, chosen) in best.items():
            for t in range(-1, len(cost) - 1):
                option = (spent + cost[t + 1], [*chosen, t])
                if done + t not in step or option < step[done + t]:
                    step[done + t] = option
        best = step
    return best[total][1]


def masked(fp: Column, group: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(signed(sum(1 << b for b in group))))


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def thresholds(fps: DataFrame, n: int, both: np.ndarray, groups: list[list[int]], distance: int) -> list[int]:
    """Allocate by counted pairs of equal value per partition, carried on to wider thresholds by the bits' agreement."""
    keys = F.array(*(F.struct(F.lit(i).alias("part"), masked(F.col("fp"), g).alias("value")) for i, g in enumerate(groups)))
    counted = fps.select(F.explode(keys).alias("key")).groupBy("key").count()
    equal = {r["part"]: r["pairs"] for r in counted.groupBy("key.part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1)).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    costs = []
    for i, g in enumerate(groups):
        near = within([p[b] ** 2 + (1 - p[b]) ** 2 for b in g], distance)
        costs.append([0.0] + [equal.get(i, 0) * near[t] / max(near[0], 1e-300) + n * sum(comb(len(g), k) for k in range(t + 1)) for t in range(distance + 1)])
    return allocate(costs, distance - len(groups) + 1)


def links(fps: DataFrame, distance: int = 2, partitions: int = 3, cap: int = 64) -> DataFrame:
    """Pairs (a, b) of fingerprints, enough of them to connect all that differ in ``distance`` bits at most.

    ``fps`` has distinct longs in ``fp``. The hubs need a distance of two.
    """
    if distance != 2:
        raise ValueError("the exact way for common values is built for a distance of 2")
    n, both = bit_counts(fps)
    groups = group_bits(n, both, partitions)
    limits = thresholds(fps, n, both, groups, distance)

    def keys(probe: bool) -> Column:
        found = []
        for i, (g, t) in enumerate(zip(groups, limits, strict=True)):
            flips = [0] if t >= 0 else []
            if probe:
                flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(g, k)]
            found += [F.struct(F.lit(i).alias("part"), masked(F.col("fp"), g).bitwiseXOR(F.lit(signed(f))).alias("value")) for f in flips]
        return F.array(*found)

    index = fps.select("fp", F.explode(keys(False)).alias("key"))
    probe = fps.select("fp", F.explode(keys(True)).alias("key"))
    if max(limits) == 0:
        sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.count(F.lit(1)).alias("asked"))
    else:  # a key that few hold may be asked for by many
        ends = index.select("key", F.lit(1).alias("h"), F.lit(0).alias("p")).unionByName(probe.select("key", F.lit(0).alias("h"), F.lit(1).alias("p")))
        sizes = ends.groupBy("key").agg(F.sum("h").alias("held"), F.sum("p").alias("asked")).filter("held > 0")
    met = F.col("held") * F.col("asked")
    rare, common = sizes.filter((met > 1) & (met <= cap * cap)).select("key"), sizes.filter(met > cap * cap).select("key")
    one, two = index.join(rare, "key"), probe.join(rare, "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    probed = one.withColumnRenamed("fp", "a").join(two.withColumnRenamed("fp", "b"), "key").filter("a < b").filter(near).select("a", "b")

    crowded = index.join(common, "key").select("fp").unionByName(probe.join(common, "key").select("fp")).distinct()
    hubs = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)))
    met = crowded.select("fp", F.explode(hubs).alias("hub")).groupBy("hub").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    through = met.select("a", F.explode("all").alias("b")).filter("a <> b")
    return probed.unionByName(through).distinct()


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, distance: int = 2, partitions: int = 3, cap: int = 64) -> DataFrame:
    """(doc_id, fp, component_id, class_fp) of each row: its fingerprint as a long, the least doc_id of its class, and the class's least fingerprint.

    Null and empty texts, and those of white space, have fingerprint zero and are
    linked like any other. Repeated rows are each reported. A null doc_id is never the
    least one unless the class has no other. Other columns are ignored; an empty table
    gives no rows.
    """
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), distance, partitions, cap)).withColumnRenamed("node", "fp")
    linked = materialise(distinct.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(least, "root").select("fp", "component_id", "root")
    of_all = distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("class_fp"))
    return prints.join(of_all, "fp").select("doc_id", "fp", "component_id", "class_fp")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
