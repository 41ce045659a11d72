"""Digests of whole tables, for comparing what was written with what was read."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell(c: Column, kind: T.DataType) -> Column:
    """A value's canonical bytes: a mark for null, numbers in big-endian hex of their bits, texts and bytes with their length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        made = F.concat(F.lit("b"), F.octet_length(raw).cast("string"), F.lit(":"), F.hex(raw))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # Text of a double reads back as the same bits; a NaN is one value.
        made = F.concat(F.lit("f"), c.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        made = F.concat(F.lit("j"), F.to_json(c))
    else:
        made = F.concat(F.lit("v"), c.cast("string"))
    return F.coalesce(made, F.lit("0"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's cells, hex."""
    return F.sha2(F.concat_ws("|", *[cell(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields]).cast("binary"), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and two sums over the rows' digests that don't depend on their order.  Combined before the shuffle, so of any size."""
    d = df.select(row_digest(df).alias("d"))
    part = lambda a: F.conv(F.substring("d", a, 15), 16, 10).cast("decimal(38,0)")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.sum(part(1)).alias("sum_head"), F.sum(part(16)).alias("sum_tail"))


def ordered_digest(df: DataFrame) -> str:
    """SHA-256 over the schema and all rows in the DataFrame's order, streamed a partition at a time; for tables that one process can walk."""
    total = hashlib.sha256(df.schema.json().encode())
    for r in df.select(row_digest(df).alias("d")).toLocalIterator():
        total.update(bytes.fromhex(r.d))
    return total.hexdigest()
