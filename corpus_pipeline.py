"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of documents. No stage is expressible in SQL as a whole, so ORACLE_SQL is None and the stages are
tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from murmur.llm._shared import materialise
from murmur.llm.decontamination import decontaminate
from murmur.llm.exact_dedup import exact_dedup
from murmur.llm.packing import pack
from murmur.llm.simhash import simhash_dedup
from murmur.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the classifier learns from the labels of these documents."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return exact_dedup(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of their 5-word shingles of 0.8 or more, that with the smallest doc_id."""
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, placed in sequences of 2048."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash", near), ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
