"""The training-text pipeline: filters, one document of each near-duplicate group, mixing, packing.

Each stage works on all rows that the one before it kept; all but the last return the columns of
``documents``. Models and limits are fitted on the stage's own input. SQL can't express the stages (training,
hash signatures, a tokenizer), so there is no SQL counterpart; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import minhash, mixing, packing, toxicity, word_quality
from llm.common import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.clean_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity keeps to their language's limit."""
    return word_quality.good_documents(docs, table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return minhash.one_of_each(docs, percent=minhash.STAGE_PERCENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("quality", good), ("near-duplicates", different), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to all documents; each result is written as Parquet and read again. Null texts are
    empty and pass the filters; documents without words end at the mix, which takes words. Repeated rows are
    near-duplicates of each other; ids may be null or repeat, and other columns play no part. An empty table
    gives no rows; without labels the two filters keep everything."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
