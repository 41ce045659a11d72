"""Connected components of an edge table, in DataFrame operations only.

Rounds of two star steps (every vertex hangs its larger neighbours, then its smaller ones, on the
smallest vertex it sees) turn each component into one star around its smallest vertex.  The number of
edges never grows, rounds grow with the logarithm of the longest path, and nothing is collected but two
numbers a round, which tell if the table has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import durable


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns, any names, no nulls.  Returns (node, root) for every vertex; root is the smallest vertex reachable."""
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, seen = seen, _print(now)
        if last == seen:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
