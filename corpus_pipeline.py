"""A training-data pipeline over documents: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet in the shared
folder and reads again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import exact_dedup, packing, quality, simhash, toxicity
from quernel.llm.common import shared_folder, table
from quernel.llm.queries import LISTED, PATTERN

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this stage's labelled documents, accepts."""
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on this stage's labelled documents, doesn't reject."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.deduplicate(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return simhash.keep_one(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents with its sequence and its place there."""
    return packing.pack(packing.pieces(docs, LISTED, PATTERN)).withColumnRenamed("id", "doc_id")


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: SQL can express neither the classifiers nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
