"""The queries of the operators on training text, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockstrata.llm import oracle
from blockstrata.llm.automaton_dedup import report as automaton_report
from blockstrata.llm.hnsw import nearest
from blockstrata.llm.mixing import mix_report
from blockstrata.llm.near_dup import near_dups
from blockstrata.llm.pieces import encode_digests
from blockstrata.llm.quality import judge_documents
from blockstrata.llm.sharding import shard_documents
from blockstrata.llm.suffix_dedup import report as suffix_report
from blockstrata.llm.toxicity import score_documents
from blockstrata.llm.warc import archive_pages

#: Vocabulary file of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(_table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(_table(spark, sf_dir, "documents"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents"), PIECES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton_report(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
