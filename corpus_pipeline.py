"""A corpus pipeline: quality, near duplicates, benchmark leaks, private data, packing.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``; the last returns the
packed pieces. Columns named like those that an operator adds are kept from ``docs``.
Empty tables pass through every stage as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.decontaminate import decontaminate
from codeloom.llm.packing import pack
from codeloom.llm.pseudonyms import pseudonymise
from codeloom.llm.quality import quality_scores
from codeloom.llm.queries import PSEUDONYM_KEY
from codeloom.llm.set_join import without_near_copies
from codeloom.sources.scratch import materialise
from codeloom.sources.tables import table

#: SQL can't express hashing, learning and tokenising here; tests hold the stages against brute force.
ORACLE_SQL = None


def packed_columns(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but text in one, so that names added by an operator can't clash."""
    return docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), "doc_id", "text")


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of ``sf_dir``."""
    scored = quality_scores(packed_columns(docs), table(spark, sf_dir, "labels"))
    return unpacked(scored.filter("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more: that of the least doc_id; of repeated rows of that id, one.

    Operator 5's fingerprints are probed and verified first; an exact join then finds the near copies that lie beyond their two bits.
    """
    return unpacked(without_near_copies(packed_columns(docs)), docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark, be it exact or with up to two other words between."""
    found = decontaminate(packed_columns(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.filter("not contaminated and n_near_items = 0"), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with private values replaced by pseudonyms."""
    return unpacked(pseudonymise(packed_columns(docs), PSEUDONYM_KEY), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, length=2048, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("private_data", private_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each on the stored rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
