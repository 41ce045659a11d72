"""Statistics of column chunks and pages, computed as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_ROWS = 4096


def least_and_most(df: DataFrame, column: str) -> tuple[Column, Column]:
    """Aggregates for a column's smallest and largest value: and/or for booleans, none for floats with a NaN, bytes as unsigned."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.bool_and(c), F.bool_or(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        bad = F.coalesce(F.bool_or(F.isnan(c)), F.lit(False))
        return F.when(~bad, F.min(c)), F.when(~bad, F.max(c))
    return F.min(c), F.max(c)


def chunk_stats(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row for each column (and group): column, rows, nulls, least, most as text; one pass over the data."""
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for c in columns:
        low, high = least_and_most(df, c)
        aggregates += [F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"__n_{c}"), low.cast("string").alias(f"__a_{c}"), high.cast("string").alias(f"__z_{c}")]
    wide = df.groupBy(*(by or [])).agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.coalesce(F.col(f"`__n_{c}`"), F.lit(0)).alias("nulls"), F.col(f"`__a_{c}`").alias("least"), F.col(f"`__z_{c}`").alias("most")) for c in columns]
    return wide.select(*(by or []), F.explode(F.array(*rows)).alias("s")).select(*(by or []), "s.*")


def page_stats(df: DataFrame, column: str, position: Column, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row for each page of ``page_rows`` rows: page, row_start, rows, nulls, least, most.  position: the row's place in its file."""
    low, high = least_and_most(df, column)
    pages = df.withColumn("__at", position).groupBy(F.floor(F.col("__at") / page_rows).cast("long").alias("page"))
    return pages.agg(F.min("__at").alias("row_start"), F.count(F.lit(1)).alias("rows"), F.sum(F.col(f"`{column}`").isNull().cast("long")).alias("nulls"), low.alias("least"), high.alias("most"))


def dictionary_useful(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, distinct, present, useful: a dictionary saves space if some value comes twice."""
    counts = [F.struct(F.lit(c).alias("column"), F.col(f"`__d_{c}`").alias("distinct_values"), F.col(f"`__p_{c}`").alias("present")) for c in columns]
    wide = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"__d_{c}") for c in columns], *[F.count(F.col(f"`{c}`")).alias(f"__p_{c}") for c in columns])
    return wide.select(F.explode(F.array(*counts)).alias("s")).select("s.*", (F.col("s.distinct_values") < F.col("s.present")).alias("useful"))


def overlay(index: DataFrame, header: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """Page statistics where a value of the index stands before that of the header, field by field."""
    a, b = index.alias("a"), header.alias("b")
    both = a.join(b, on, "full_outer")
    return both.select(*on, *[F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}")).alias(f) for f in fields])
