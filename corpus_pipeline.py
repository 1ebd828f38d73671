"""From raw documents to token ids in five stages, each written before the next one reads it.

Rows with nulls in any column, repeated rows, columns of any further name and tables without rows go through all
stages: null texts fail the quality rules, null labels, sources and ids are values of their own. Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockstrata.llm.mixing import mix_documents
from blockstrata.llm.near_dup import drop_near_dups
from blockstrata.llm.pieces import encode_documents
from blockstrata.llm.quality import keep_documents
from blockstrata.llm.queries import PIECES
from blockstrata.llm.store import settle
from blockstrata.llm.suffix_dedup import clean


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; a null text has no words, and too few words are a rejection."""
    return keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar to 0.8 or more: that with the least id,
    null ids last; rows that repeat id and text are one document."""
    return drop_near_dups(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 200 or more that occur more than once; a text of nothing else stays, empty."""
    return clean(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the token budget takes them; a null source is one, empty texts
    cost nothing."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, round_trip and ids; no pieces for an empty text."""
    return encode_documents(docs, PIECES, keep=("doc_id", "source"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Sets of shingles, suffix arrays and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' last result, from documents and labels in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
