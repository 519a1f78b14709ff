import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from codeloom.llm.packing import pack, sequences, token_ids
from tests.llm.data import documents


def test_pieces_round_trip_and_fill_windows(spark):
    docs = documents(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d if d is not None else -1), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    pieces = sorted(pack(docs, length=512).collect(), key=lambda p: (p["sequence_id"], p["offset"]))
    stream, got = [], []
    for p in pieces:
        assert p["sequence_id"] * 512 + p["offset"] == len(stream)
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0 and p["continued"] == (p["start"] > 0) and p["continues"] == (p["start"] + p["length"] < p["doc_tokens"])
        stream += ids
        if not p["continued"]:
            got.append((-1 if p["doc_id"] is None else p["doc_id"], []))
        assert len(got[-1][1]) == p["start"]
        got[-1][1].extend(ids)
    assert sorted(got) == want
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sequences(pack(docs, length=512)).collect()}
    assert [t for k in sorted(whole) for t in whole[k]] == stream
    assert all(len(whole[k]) == 512 for k in sorted(whole)[:-1])
    assert zlib.crc32(pieces[0]["ids"]) >= 0


def test_very_long_runs():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 400_000 + "x", "a" * 50_000, "\n" * 50_000, "1" * 50_000, "x" + " " * 50_000, "\u3000" * 20_000):
        assert token_ids(text, "byte_bpe_50k.tiktoken") == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert pack(documents(spark, [])).count() == 0
