"""Scans of columnar files: checked pages, projection by path, row groups by ordinal, bytes in memory."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from quernel.errors import InvalidColumnData, InvalidParquetFile
from quernel.operators import nested
from quernel.sources import metadata

MAGIC = b"PAR1"
SMALLEST_FILE = 12
#: Files whose footers are looked at, one by one, before the vectorised reader is used.
CHECKED_FILES = 100


def scan(spark: SparkSession, path: str, paths: list[str] | None = None, row_groups: list[int] | None = None, verify_crc: bool = True, flat: bool = False, columnar: bool | None = None) -> DataFrame:
    """A file as a DataFrame.

    paths: dotted leaf paths, in order, repeated ones too; only what they need is read.  row_groups: ordinals;
    others aren't returned.  verify_crc: a page whose checksum is wrong is an error.  flat: repeated leaves
    are refused.  columnar: whether Spark's vectorised reader may be used; by default the footers of all files
    tell (see ``needs_row_reader``), and where it may not, or there are more than ``CHECKED_FILES`` files, the
    session reads by rows from then on, which is right for all.
    """
    reader = spark.read.option("parquet.page.verify-checksum.enabled", str(verify_crc).lower())
    df = reader.parquet(path)
    if columnar is None:
        files = df.inputFiles()
        columnar = len(files) <= CHECKED_FILES and not any(needs_row_reader(spark, f) for f in files)
    if not columnar:
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    if row_groups is not None:
        df = only_row_groups(df, path, row_groups)
    if paths is not None:
        return nested.select_leaves(df, paths, flat)
    if flat:
        nested.select_leaves(df, [x.name for x in nested.leaves(df.schema)], flat=True)
    return df


def needs_row_reader(spark: SparkSession, path: str) -> bool:
    """Whether a file has pages that Spark's vectorised reader refuses (byte stream split) or misreads.

    It misreads uncompressed pages of delta-encoded bytes: such values came back shifted in our tests, while the
    row reader and Arrow read them right.
    """
    return bool(metadata.footer(spark, path).where("encodings like '%BYTE_STREAM_SPLIT%' or (codec = 'UNCOMPRESSED' and encodings like '%DELTA_BYTE_ARRAY%')").limit(1).count())


def only_row_groups(df: DataFrame, path: str, row_groups: list[int]) -> DataFrame:
    """Rows of the row groups with these ordinals, by their places in the file."""
    ranges = metadata.row_ranges(df.sparkSession, path)
    if any(not 0 <= g < len(ranges) for g in row_groups):
        raise InvalidColumnData(f"row groups {row_groups} of {len(ranges)}")
    at = F.col("_metadata.row_index")
    wanted = F.lit(False)
    for g in sorted(set(row_groups)):
        start, rows = ranges[g]
        wanted = wanted | ((at >= start) & (at < start + rows))
    return df.where(wanted)


def pages(df: DataFrame, column: str, position: F.Column, page_rows: int) -> DataFrame:
    """A column's values page by page: page, and its values in order."""
    rows = df.select(position.alias("at"), F.col(f"`{column}`").alias("value"))
    return nested.assemble(rows.withColumn("page", F.floor(F.col("at") / page_rows).cast("long")), "page", "at", "value", "items")


def check_bytes(content: bytes) -> None:
    """Raises if this isn't a whole columnar file."""
    if len(content) < SMALLEST_FILE or content[:4] != MAGIC or content[-4:] != MAGIC:
        raise InvalidParquetFile("magic bytes or footer are missing")
    if int.from_bytes(content[-8:-4], "little") > len(content) - SMALLEST_FILE:
        raise InvalidParquetFile("the footer is longer than the file")


def read_bytes(spark: SparkSession, content: bytes, columns: list[str] | None = None) -> DataFrame:
    """A file that is held in memory."""
    check_bytes(content)
    try:
        table = pq.read_table(io.BytesIO(content), columns=columns)
    except (pa.ArrowInvalid, OSError) as e:
        raise InvalidParquetFile(str(e)) from None
    return spark.createDataFrame(table)


def read_binary(df: DataFrame, schema: T.StructType, content: str = "content") -> DataFrame:
    """Rows of the files that a binary column holds (as the binaryFile source gives them), decoded where they are."""
    names = [f.name for f in schema.fields]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for value in part.column(0):
                check_bytes(value.as_py())
                yield from pq.read_table(io.BytesIO(value.as_py()), columns=names).to_batches()

    return df.select(content).mapInArrow(run, schema)


def schema_of(content: bytes) -> T.StructType:
    check_bytes(content)
    return from_arrow_schema(pq.read_schema(io.BytesIO(content)))
