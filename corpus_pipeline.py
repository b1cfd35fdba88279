"""A corpus pipeline over ``documents``: quality, near-duplicates, mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``documents``; the last gives each row's ids.

Other columns go along under any name. Null, empty and blank texts score the share of good labels, are near-duplicates of nothing, have
no words to mix and no ids. Null ids, langs and sources are values like others. Of repeated rows and of texts that tie the smallest id stays,
once. Texts of any length are worked on whole. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vocalith.llm.bagminhash import keep_one
from vocalith.llm.common import cut, table
from vocalith.llm.mixing import mix
from vocalith.llm.pieces import encode
from vocalith.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote predicts good; the others go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for: rows repeat up to three times or go."""
    return mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, restored, parity) of every row."""
    return encode(docs, kept=("doc_id", "lang", "source"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", dedup), ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", tokenise)]

#: Votes, signatures and dependent rounding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"stage{i + 1}")
    return docs
