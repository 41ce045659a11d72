"""Footers and page indexes as data.

Both are read by the JVM's own file reader, so any store that Spark reads will do and no values are decoded.
``footers`` is a data source with one task for each file where many are to be read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernel.errors import CorruptMetadata, InvalidParquetFile

COLUMNS = (
    "file string, row_group int, row_start long, rows long, column string, physical string, codec string, encodings string, "
    "values long, nulls long, least string, most string, compressed long, uncompressed long, data_offset long"
)
PAGES = "row_group int, column string, page int, offset long, compressed long, row_start long, rows long, nulls long, least binary, most binary"
PAGE_NAMES = [x.split()[0] for x in PAGES.split(", ")]
#: Indexes of several chunks, one after another as they are stored, deflated; and the bytes, as stored, after which a slab is full.
SLABS = "chunks array<struct<row_group: int, column: string, rows: long, stats: boolean>>, indexes binary"
SLAB_BYTES = 1 << 19
#: struct formats and widths of the physical types with numbers of a fixed width (fixed values).
WIDTHS = {"INT32": ("<i", 4), "INT64": ("<q", 8), "FLOAT": ("<f", 4), "DOUBLE": ("<d", 8)}


def decode(physical: str, raw: bytes | None):
    """A statistic's value from its bytes."""
    if raw is None:
        return None
    if physical == "BOOLEAN":
        if len(raw) != 1:
            raise CorruptMetadata("a boolean statistic isn't one byte")
        return raw[0] != 0
    if physical in WIDTHS:
        shape, width = WIDTHS[physical]
        if len(raw) != width:
            raise CorruptMetadata(f"a statistic of {physical} has {len(raw)} bytes")
        return struct.unpack(shape, raw)[0]
    return raw


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    try:
        return jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    except Exception as e:
        raise InvalidParquetFile(f"{path}: {str(e).splitlines()[0]}") from None


def row_ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First row and number of rows of each row group of one file."""
    reader = _open(spark, path)
    try:
        out, start = [], 0
        for block in reader.getFooter().getBlocks():
            out.append((start, block.getRowCount()))
            start += block.getRowCount()
        return out
    finally:
        reader.close()


def _text(stats, side: str) -> str | None:
    if not stats.hasNonNullValue():
        return None
    return stats.minAsString() if side == "least" else stats.maxAsString()


def footer(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk of one file (COLUMNS)."""
    reader = _open(spark, path)
    try:
        rows, start = [], 0
        for g, block in enumerate(reader.getFooter().getBlocks()):
            for c in block.getColumns():
                stats = c.getStatistics()
                codings = ", ".join(sorted(str(e) for e in c.getEncodings()))
                rows.append((
                    path, g, start, block.getRowCount(), c.getPath().toDotString(), str(c.getPrimitiveType().getPrimitiveTypeName()), str(c.getCodec()), codings,
                    c.getValueCount(), stats.getNumNulls() if stats.isNumNullsSet() else None, _text(stats, "least"), _text(stats, "most"),
                    c.getTotalSize(), c.getTotalUncompressedSize(), c.getFirstDataPageOffset(),
                ))
            start += block.getRowCount()
    finally:
        reader.close()
    return spark.createDataFrame(rows, COLUMNS)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each page that the file's indexes name (PAGES); statistics are null where there is only an offset index.

    The driver asks the reader for each column chunk's indexes, whatever its number of pages, and passes them on as
    they are stored, deflated, in slabs of about SLAB_BYTES; a task for each slab decodes them.
    """
    jvm = spark.sparkContext._jvm
    stored, convert = jvm.org.apache.parquet.format.Util, jvm.org.apache.parquet.format.converter.ParquetMetadataConverter

    def slab(held: list[tuple]) -> tuple[list[tuple], bytearray]:
        out = jvm.java.io.ByteArrayOutputStream()
        deflated = jvm.java.io.BufferedOutputStream(jvm.java.util.zip.DeflaterOutputStream(out))
        for *_, offsets, stats in held:
            stored.writeOffsetIndex(offsets, deflated)
            if stats is not None:
                stored.writeColumnIndex(stats, deflated)
        deflated.close()
        return [(g, column, rows, stats is not None) for g, column, rows, _, stats in held], out.toByteArray()

    reader = _open(spark, path)
    try:
        slabs, held, size = [], [], 0
        for g, block in enumerate(reader.getFooter().getBlocks()):
            rows = block.getRowCount()
            for c in block.getColumns():
                offsets = reader.readOffsetIndex(c)
                if offsets is None:
                    continue
                stats = convert.toParquetColumnIndex(c.getPrimitiveType(), reader.readColumnIndex(c))
                held.append((g, c.getPath().toDotString(), rows, convert.toParquetOffsetIndex(offsets), stats))
                size += sum(r.getLength() for r in (c.getOffsetIndexReference(), c.getColumnIndexReference()) if r is not None)
                if size >= SLAB_BYTES:
                    slabs.append(slab(held))
                    held, size = [], 0
        if held:
            slabs.append(slab(held))
    finally:
        reader.close()
    if not slabs:
        return spark.createDataFrame([], PAGES)
    return spark.createDataFrame(spark.sparkContext.parallelize(slabs, len(slabs)), SLABS).mapInArrow(_pages, PAGES)


def _pages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAGES from rows of SLABS, a batch for each chunk."""
    for slab in (row for part in parts for row in part.to_pylist()):
        raw, at = zlib.decompress(slab["indexes"]), 0
        for chunk in slab["chunks"]:
            # Fields by their numbers in parquet.thrift: OffsetIndex 1 page_locations of 1 offset, 2 compressed_page_size, 3 first_row_index;
            # ColumnIndex 1 null_pages, 2 min_values, 3 max_values, 5 null_counts.
            offsets, at = _compact(raw, at)
            stats, at = _compact(raw, at) if chunk["stats"] else ({}, at)
            places = offsets[1]
            n = len(places)
            empty, nulls = stats.get(1, [True] * n), stats.get(5, [None] * n)
            least, most = ([None if e else v for e, v in zip(empty, stats.get(k, [None] * n), strict=True)] for k in (2, 3))
            starts = [p[3] for p in places]
            counts = [b - a for a, b in zip(starts, [*starts[1:], chunk["rows"]], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk["row_group"]] * n, pa.int32()), pa.array([chunk["column"]] * n, pa.string()), pa.array(range(n), pa.int32()),
                    pa.array([p[1] for p in places], pa.int64()), pa.array([p[2] for p in places], pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(nulls, pa.int64()), pa.array(least, pa.binary()), pa.array(most, pa.binary()),
                ],
                PAGE_NAMES,
            )


def _compact(raw: bytes, at: int) -> tuple[dict, int]:
    """A struct of Thrift's compact protocol (values by field number, structs as such dicts), and where it ends."""

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 0x7F) << shift
            if byte < 0x80:
                return out
            shift += 7

    def value(kind: int):
        nonlocal at
        if kind in (4, 5, 6):  # zigzag numbers
            n = varint()
            return (n >> 1) ^ -(n & 1)
        if kind == 8:  # bytes
            n = varint()
            at += n
            if at > len(raw):
                raise IndexError(at)
            return raw[at - n : at]
        if kind == 9:  # list
            head = raw[at]
            at += 1
            n = head >> 4
            n = varint() if n == 15 else n
            return [item(head & 15) for _ in range(n)]
        if kind == 12:
            return struct_()
        raise CorruptMetadata(f"an index holds a value of kind {kind}")

    def item(kind: int):
        nonlocal at
        if kind in (1, 2):  # booleans of a list are a byte each
            at += 1
            return raw[at - 1] == 1
        return value(kind)

    def struct_() -> dict:
        nonlocal at
        out, field = {}, 0
        while raw[at]:
            head = raw[at]
            at += 1
            field = field + (head >> 4) if head >> 4 else value(4)
            out[field] = head & 15 == 1 if head & 15 in (1, 2) else value(head & 15)
        at += 1
        return out

    try:
        return struct_(), at
    except IndexError:
        raise CorruptMetadata("an index ends early") from None


def validate(spark: SparkSession, path: str) -> DataFrame:
    """The footer of a file, after checks that its counts and places make sense."""
    made = footer(spark, path)
    bad = made.where("rows < 0 or values < 0 or compressed < 0 or data_offset < 4 or nulls > values")
    if bad.limit(1).count():
        raise CorruptMetadata(path)
    return made


class FooterSource(DataSource):
    """``spark.read.format("quernel_footers").option("paths", "a,b").load()``: footers of many files, a task for each.

    Workers open the files by Arrow's file systems, so paths must be ones that those know.
    """

    @classmethod
    def name(cls) -> str:
        return "quernel_footers"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return FooterReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class FooterReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        found = pq.ParquetFile(partition.value).metadata
        start = 0
        for g in range(found.num_row_groups):
            group = found.row_group(g)
            for k in range(group.num_columns):
                c = group.column(k)
                s = c.statistics
                known = s is not None and s.has_min_max
                yield (
                    partition.value, g, start, group.num_rows, c.path_in_schema, c.physical_type, c.compression, ", ".join(sorted(c.encodings)), c.num_values,
                    s.null_count if s is not None and s.has_null_count else None, str(s.min) if known else None, str(s.max) if known else None,
                    c.total_compressed_size, c.total_uncompressed_size, c.data_page_offset,
                )
            start += group.num_rows


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(FooterSource)
    return spark.read.format("quernel_footers").option("paths", ",".join(paths)).load()
