"""URL rules in a sorted digest array.

Each rule (host and path prefix) is keyed by the 64-bit xxHash of its string. The
keys are sorted into one array, with the offsets of the full strings beside it.
Executors memory-map the array and probe it by vectorised binary search with
those host suffixes and path prefixes of a URL that have as many labels and characters
as some rule has, then compare the stored string, so a hash collision never decides. A
URL costs what the rules' shapes ask for, however long its host is.

A list above ``max_bytes`` is cut into several arrays by key range. Each is
shipped and probed in turn, and the longest match over all of them wins, so what
is broadcast at once stays bounded.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Shapes(NamedTuple):
    """Lengths of paths and numbers of host labels that an array's rules have, and the most characters of a host."""

    paths: list[int]
    labels: list[int]
    longest: int


def digest_arrays(rules: DataFrame, max_bytes: int) -> Iterator[tuple[bytes, Shapes]]:
    """Sorted arrays of the rules (host, path, verdict), each at most ``max_bytes`` long, and the shapes in it.

    Layout: the count, then keys, then end offsets, then verdicts (1: block) and the strings.
    Of equal rules with different verdicts, block stands. Rules with a null are no rules.
    """
    rule = F.concat("host", "path")
    kept = (
        rules.dropna(subset=["host", "path", "verdict"])
        .groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"))
        .select(F.xxhash64(rule).alias("key"), F.concat("host", F.lit("\x00"), "path").alias("text"), F.length("path").alias("path_length"), "block")
        .withColumn("bytes", F.octet_length("text") + 32)
    )
    size = kept.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = -(-size // (max_bytes // 2)) if size > max_bytes else 1
    for part in range(parts):
        one = kept if parts == 1 else kept.filter(F.pmod("key", F.lit(parts)) == part)
        rows = one.select("key", "text", "path_length", "block").toPandas()
        yield pack(rows)


def pack(rows: pd.DataFrame) -> tuple[bytes, Shapes]:
    """One array from the columns key, text (host, a null character and path), path_length and block."""
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys, kind="stable")
    texts = [rows["text"].iloc[i].encode() for i in order]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    block = rows["block"].to_numpy(np.int64)[order] if len(rows) else np.zeros(0, np.int64)
    blob = np.int64(len(texts)).tobytes() + keys[order].tobytes() + ends.astype(np.int64).tobytes() + block.tobytes() + b"".join(texts)
    hosts = {t.split("\x00")[0] for t in rows["text"]}
    return blob, Shapes(sorted(set(map(int, rows["path_length"]))), sorted({h.count(".") + 1 for h in hosts}), max(map(len, hosts), default=0))


class DigestArray:
    """A memory-mapped array. The file is unlinked at once; the mapping keeps it until the worker ends."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = self.n = int(np.frombuffer(self.map, np.int64, 1)[0])
        self.keys = np.frombuffer(self.map, np.uint64, n, 8)
        self.ends = np.frombuffer(self.map, np.int64, n, 8 + 8 * n)
        self.block = np.frombuffer(self.map, np.int64, n, 8 + 16 * n)
        self.text_at = 8 + 24 * n

    def text(self, i: int) -> bytes:
        return self.map[self.text_at + (int(self.ends[i - 1]) if i else 0) : self.text_at + int(self.ends[i])]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The place of each ``host\\0path`` in the array, or -1."""
        keys = np.fromiter((xxhash.xxh64_intdigest(t.replace(b"\x00", b"", 1), 42) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1, np.int64)
        for j in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, max(self.n - 1, 0))] == keys) if self.n else np.zeros(len(texts), bool)):
            i = int(at[j])
            while i < self.n and self.keys[i] == keys[j]:  # colliding keys lie side by side
                if self.text(i) == texts[j]:
                    found[j] = i
                    break
                i += 1
        return found


def suffixes(host: str, shapes: Shapes) -> Iterator[str]:
    """The last labels of the host, for each number of labels that a rule's host has, if no longer than the longest of these."""
    at, labels = len(host), 0
    for wanted in shapes.labels if host else ():
        while labels < wanted and at >= 0:
            at = host.rfind(".", 0, at)
            labels += 1
        if labels < wanted or len(host) - at - 1 > shapes.longest:
            return
        yield host[at + 1 :]


def match_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = 64 << 20) -> DataFrame:
    """Judge each URL: page_id, host, path, rule (host and path prefix, or null), verdict.

    A rule fits its host and the subdomains of it where the path starts with its
    own; the longest fitting rule wins, of equal lengths the one with the longer
    host. With none, the verdict is ``default``: a URL outside the list is not
    blocked. Null URLs and those without ``://`` have an empty host and path and
    fit no rule. Repeated rows are each judged; an empty table gives no rows.
    """
    spark = pages.sparkSession
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(-1).alias("rule_length"), F.lit(-1).alias("host_length"))
    schema = out.schema
    for blob, shapes in digest_arrays(rules, max_bytes):
        shipped = spark.sparkContext.broadcast(blob)

        def probe(batches: Iterator[pd.DataFrame], shipped=shipped, shapes=shapes) -> Iterator[pd.DataFrame]:
            array = DigestArray(shipped.value)
            for batch in batches:
                hosts, paths = batch["host"].tolist(), batch["path"].tolist()
                texts, owner, host_len, path_len = [], [], [], []
                for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                    for s in suffixes(host, shapes):
                        for n in shapes.paths:
                            if n <= len(path):
                                texts.append(f"{s}\x00{path[:n]}".encode())
                                owner.append(i)
                                host_len.append(len(s))
                                path_len.append(n)
                best = {i: (r, h) for i, (r, h) in enumerate(zip(batch["rule_length"].tolist(), batch["host_length"].tolist(), strict=True))}
                rule, verdict = batch["rule"].tolist(), batch["verdict"].tolist()
                for j, at in enumerate(array.find(texts)):
                    if at >= 0 and (score := (host_len[j] + path_len[j], host_len[j])) > best[owner[j]]:
                        best[owner[j]] = score
                        rule[owner[j]] = texts[j].decode().replace("\x00", "", 1)
                        verdict[owner[j]] = "block" if array.block[at] else "allow"
                yield batch.assign(rule=pd.Series(rule, batch.index, object), verdict=pd.Series(verdict, batch.index, object), rule_length=[best[i][0] for i in range(len(batch))], host_length=[best[i][1] for i in range(len(batch))])

        out = out.mapInPandas(probe, schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
