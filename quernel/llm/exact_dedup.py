"""Exact duplicates by content hash, in DataFrame operations only (operator 10).

Rows are grouped by the 128-bit MD5 of the normalised text together with the text itself, so bytes are
compared inside each hash group and texts whose hashes collide stay apart.  The grouping combines rows
before the shuffle: a group of copies sends one row from each input partition, however large it is.
The marks go back to the rows by a join on both digests, of which Spark splits skewed partitions.

Defined cases: null counts as empty; all empty texts are one group; null ids are larger than any other,
and a group without any id keeps its rows' id null; rows repeated with one id get the same marks;
an empty table gives an empty result; other columns are ignored by ``mark`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import BLANKS


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; nothing else changes."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row: id_col, keep_id, group_size long, kept boolean, text_sha256 (hex of the normalised text).

    hash_of: 128-bit content hash; tests pass a weak one to make collisions.
    """
    rows = df.select(df[id_col].alias("id"), normalised(df[text_col]).alias("content"))
    rows = rows.select("id", "content", hash_of(F.col("content")).alias("hash"))
    groups = rows.groupBy("hash", "content").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    digest = F.unhex(F.sha2(F.col("content").cast("binary"), 256))
    groups = groups.select("hash", digest.alias("digest"), "keep_id", "group_size")
    narrow = rows.select("id", F.col("hash").alias("own_hash"), digest.alias("own_digest"))
    both = narrow.join(groups, (F.col("own_hash") == F.col("hash")) & (F.col("own_digest") == F.col("digest")))
    return both.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("own_digest")).alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows repeated with one id and text one stays."""
    kept = mark(df, id_col, text_col).where("kept").select(F.col(id_col).alias("__keep"), F.unhex("text_sha256").alias("__digest"))
    own = F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256))
    rows = df.withColumn("__own", own)
    joined = rows.join(kept.distinct(), rows["__own"].eqNullSafe(kept["__digest"]) & rows[id_col].eqNullSafe(kept["__keep"]))
    # The join has dealt the rows by id and digest already, so this moves nothing.
    return joined.dropDuplicates(["__keep", "__digest"]).select(*[F.col(f"`{c}`") for c in df.columns])
