"""Writing columnar files: checks before anything is written, and the writer's options by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernel.errors import InvalidColumnData, InvalidSchema, UnsupportedCompression

#: Names of codecs as callers know them, and as the writer does (fixed values).
CODECS = {"none": "none", "uncompressed": "none", "snappy": "snappy", "gzip": "gzip", "lz4_raw": "lz4_raw", "zstd": "zstd"}
MAX_PRECISION = 38


def check_schema(schema: T.StructType) -> None:
    """Raises for a schema that can't be written: no columns, empty or repeated names, decimals out of bounds."""
    if not schema.fields:
        raise InvalidSchema("there are no columns")

    def walk(kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            names = [f.name for f in kind.fields]
            if not all(names) or len(set(names)) < len(names):
                raise InvalidSchema(f"empty or repeated names: {names}")
            for f in kind.fields:
                walk(f.dataType)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType)
        elif isinstance(kind, T.MapType):
            walk(kind.keyType)
            walk(kind.valueType)
        elif isinstance(kind, T.DecimalType) and not 0 <= kind.scale <= kind.precision <= MAX_PRECISION:
            raise InvalidSchema(str(kind))

    walk(schema)


def write(df: DataFrame, path: str, codec: str = "none", page_rows: int = 65_536, page_version: int = 1, crc: bool = False, dictionary: bool = True, row_group_bytes: int | None = None, max_rows_a_file: int | None = None, mode: str = "errorifexists") -> None:
    """Writes the rows; columns may be flat, lists, maps and any nesting of them."""
    check_schema(df.schema)
    if codec not in CODECS:
        raise UnsupportedCompression(codec)
    if page_rows < 1 or page_version not in (1, 2):
        raise InvalidColumnData("page options are out of range")
    options = {
        "compression": CODECS[codec],
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": f"PARQUET_{page_version}_0",
        "parquet.page.write-checksum.enabled": str(crc).lower(),
        "parquet.enable.dictionary": str(dictionary).lower(),
    }
    if row_group_bytes:
        options["parquet.block.size"] = row_group_bytes
    if max_rows_a_file:
        options["maxRecordsPerFile"] = max_rows_a_file
    df.write.mode(mode).options(**options).parquet(path)
