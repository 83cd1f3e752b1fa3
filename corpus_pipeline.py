"""Corpus pipeline: quality rules, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldtrends.llm.common import documents, table
from fieldtrends.llm.exact_dedup import drop_copies
from fieldtrends.llm.ngram_join import drop_near_copies
from fieldtrends.llm.packing import pack
from fieldtrends.llm.pii import mask
from fieldtrends.llm.quality import keep_good
from fieldtrends.llm.suite import query
from fieldtrends.llm.tokens import public_path
from fieldtrends.session import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word sequences."""
    return drop_near_copies(docs)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return mask(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 1024 ids."""
    return pack(docs, public_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("personal data", personal_stage),
    ("packing", packing_stage),
]

#: Stages 1, 3 and 5 (a learned list, MinHash, a tokenizer) have no SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
