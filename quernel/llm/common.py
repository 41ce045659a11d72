"""What the operators share: tables, lineage cuts and sizes that are checked before a broadcast."""

from __future__ import annotations

import tempfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts have it: space, tab, line feed, vertical tab, form feed, carriage return.
#: Runs of it that aren't one plain space already, which would be replaced by itself.
BLANKS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
#: Rows of a narrow table (some tens of bytes each) that may be broadcast; beyond it a shuffled join is used.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only in local mode, where executors see the driver's disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quernel-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows in the shared folder, with their lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast a narrow table if it was counted and is small; else the table as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *keys) -> DataFrame:
    """Rows dealt evenly by a hash of the keys, into as many partitions as the session shuffles to."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def held_out(doc_id) -> bool:
    """The fold that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
