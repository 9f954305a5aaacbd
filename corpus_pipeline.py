"""Cleaning and packing a corpus: quality rules, line dedup, near-duplicate documents, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept,
and returns the columns of ``documents``; the last returns the pieces of the packed
sequences. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import jaccard, lines, packing, quality
from credence.llm.common import materialise, table
from credence.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy rejects go."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of equal or nearly equal lines one stays; documents without lines left go."""
    out = lines.drop_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays."""
    return jaccard.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram jaccard join", jaccard_join), ("packing", pack)]

#: SQL cannot express MinHash buckets, byte-pair ids or bin packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
