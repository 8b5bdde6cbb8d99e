"""A corpus pipeline: language ID, toxicity, near duplicates, mixing, packing. Counted as part of tidemark.llm.

Every stage takes (spark, docs, sf_dir) and returns the rows the next one reads; all but the last return the columns of docs, whatever
they are called. No stage fails on an empty table: its result is empty too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import lang_id, mixing, ngram_jaccard, packing, toxicity
from tidemark.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; null, empty and letterless texts go. Equal rows stay as they are."""
    return lang_id.keep_known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay, null and empty texts among them."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id; of equal rows one. Rows without id and texts without
    words belong to no group and stay, but for equal rows of one id."""
    return ngram_jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; empty texts have no size and are taken as their source's share says, null sources are a
    source. Equal rows are documents of their own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each row, whatever it holds; a null text has length 0."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("packing", pack)]
#: The first stages learn models and the third walks a graph: no SQL says that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = materialize(docs) if k < len(STAGES) - 1 else docs
    return docs
