"""Packing by concatenating and cutting.

Documents are tokenised once, and the ids are stored with each row's place in its
partition. The first pass sums tokens by partition, and the prefix sums of these
totals give every document a global offset. The second pass cuts the one long
sequence into windows of equal length; a document that crosses windows leaves one
piece in each, marked at its boundaries. Only the last window can be short.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.scratch import materialise


@lru_cache(maxsize=1)
def encoder(vocabulary: str):
    """The byte-level BPE of a rank file; ids equal those of the same vocabulary's JSON file, and it is several times faster."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


@lru_cache(maxsize=1)
def slow_encoder(vocabulary: str):
    """The JSON file of the same vocabulary, for texts that the fast one's pattern gives up on, such as very long runs of spaces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary.rpartition(".")[0] + ".json"))


def token_ids(text: str, vocabulary: str) -> list[int]:
    try:
        return encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        return slow_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, part, first (tokens before it in its partition), n and ids (little-endian 16-bit, the end id included), stored."""
    kept = docs.select("doc_id", "text")

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder(vocabulary).n_vocab > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                rows = batch.slice(begin, 512)
                ids, first, n = [], [], []
                for text in rows.column("text"):
                    tokens = token_ids(text.as_py() or "", vocabulary)
                    tokens.append(end_id)
                    ids.append(np.array(tokens, "<u2").tobytes())
                    first.append(at)
                    n.append(len(tokens))
                    at += len(tokens)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "first", "n", "ids"])

    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, part int, first long, n long, ids binary"
    return materialise(kept.mapInArrow(of_batch, schema), "tokens")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", length: int = 2048, end_id: int = 1, max_parts: int = 1_000_000) -> DataFrame:
    """The pieces of all documents in windows of ``length`` tokens.

    Returns doc_id, start (tokens of the document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, and continued and
    continues: whether the piece goes on from or into another window. A null text is
    empty and has its end id only. Repeated rows are each packed; other columns are
    ignored. An empty table gives no rows.
    """
    rows = tokenised(docs, vocabulary, end_id)
    totals = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("tokens"))
    bases = materialise(totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base")), "bases")
    # One row for each task of the first pass, so this is small unless there are millions.
    side = F.broadcast(bases) if bases.count() <= max_parts else bases
    placed = rows.join(side, "part").select("doc_id", (F.col("base") + F.col("first")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                sub = batch.slice(begin, 512)
                row, start, size, ids, total, sequence, offset = [], [], [], [], [], [], []
                for i, (at, n, blob) in enumerate(zip(sub.column("at").to_pylist(), sub.column("n").to_pylist(), sub.column("ids"), strict=True)):
                    tokens = np.frombuffer(blob.as_buffer(), "<u2").astype("<u4").tobytes()
                    done = 0
                    while done < n:
                        where = at + done
                        take = min(n - done, length - where % length)
                        row.append(i)
                        start.append(done)
                        size.append(take)
                        ids.append(tokens[4 * done : 4 * (done + take)])
                        total.append(n)
                        sequence.append(where // length)
                        offset.append(where % length)
                        done += take
                begins, sizes, totals = np.array(start, np.int64), np.array(size, np.int64), np.array(total, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [sub.column("doc_id").take(pa.array(row, pa.int32())), pa.array(begins), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(totals), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(begins > 0), pa.array(begins + sizes < totals)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "continued", "continues"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, continued boolean, continues boolean")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids and doc_ids of each window, its pieces joined in order; a window bounds the group."""
    ordered = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return ordered.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
