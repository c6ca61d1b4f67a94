"""The corpus pipeline: five stages from raw documents to token blocks.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents, and any further ones with their values, whatever their
names. Rows with a null doc_id, null texts, repeated rows and texts of any length
take part in every stage as its operator's docstring says; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate, mixing, quality, simhash, tokens
from orrery.llm.common import shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's bounds, each row by its own text. Null and empty texts go; ties at a bound stay."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates. All rows of that doc_id stay, and so do rows without one."""
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark. Rows of a doc_id go together, null ones too; null and empty texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate draws them, in a global random order. Rows of a doc_id are drawn equally often; a null source is one source."""
    return mixing.mix(docs, names=("__mix_copy", "__mix_key")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token file, read back from its blocks: a row for each copy, those of a null doc_id first. Null texts have the end id alone."""
    return tokens.round_trip(docs)


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token blocks", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := shared_path(spark))
        docs = spark.read.parquet(path)
    return docs


#: A SimHash component, an n-gram model and a tokenizer are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None
