"""The operators' queries over the whole driver tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import byte_bpe, exact_dedup, html_text, packing, quality, sharding, simhash, token_counts, toxicity, vptree
from quernel.llm.common import table

MULTI, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LISTED = public_tokenizers.path("byte_bpe_50k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), MULTI, PATTERN, decoded=True)
    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8)


def edits(text: F.Column) -> F.Column:
    """Three edits of every text: an insertion in its middle, a tenth of it cut out, its first characters replaced."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), removed.cast("long").alias("removed"), F.lit(inserted).alias("inserted"))
    return F.array(edit(F.floor(n / 2), F.lit(0), " (revised) "), edit(F.floor(n / 4), F.floor(n / 10), ""), edit(F.lit(0), F.lit(5), "New text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs.withColumn("edits", edits(F.col("text"))), MULTI, PATTERN, edits_col="edits")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vptree.index(vectors), vectors.where("vec_id % 100 = 0"), k=10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), LISTED, PATTERN)
    return packing.pack(cut).withColumnRenamed("id", "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_sharding, op3_token_counts, op4_quality, op5_toxicity, op6_nearest, op7_packing, op8_simhash, op9_html_text, op10_exact_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
}
