"""Ordered tables: bounds, ranges, cursors and positions, without sorting everything in one task.

Rows are dealt into ranges of the order by approximate quantiles; windows run inside a range, and a table
with one row for each range carries what the next or previous range has at its edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 64


def range_edges(df: DataFrame, order: Column, ranges: int = RANGES) -> list:
    """At most ``ranges - 1`` rising values that cut the order into parts of about equal size."""
    values = df.select(order.alias("o")).where("o is not null")
    if dict(values.dtypes)["o"] in ("string", "binary"):
        # Text has no quantile sketch: the rows with the smallest hashes are an even sample of a fixed size.
        sample = sorted(r.o for r in values.orderBy(F.xxhash64("o", F.lit("edge"))).limit(ranges * 20).collect())
        return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    cuts = values.agg(F.percentile_approx("o", [k / ranges for k in range(1, ranges)], 1000).alias("c")).first().c
    return sorted(set(cuts or []))


def range_of(order: Column, edges: list) -> Column:
    """How many edges are at or below the value."""
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= order))


def bound(table: DataFrame, key: str, probes: DataFrame, probe: str, strict: bool = False, ranges: int = RANGES) -> DataFrame:
    """Each probe row with ``bound``: the smallest key at or above it (above it, if strict), null past the end.

    Keys and probes of a range are sorted together; past a range's last key the first key of the next range
    that has any is taken.
    """
    edges = range_edges(table, F.col(f"`{key}`"), ranges)
    names = [F.col(f"`{c}`") for c in probes.columns]
    kind = table.schema[key].dataType
    keys = table.select(F.col(f"`{key}`").alias("o"), F.lit(None).cast(probes.schema).alias("row"), F.lit(0 if strict else 1).alias("turn"))
    asked = probes.select(F.col(f"`{probe}`").cast(kind).alias("o"), F.struct(*names).alias("row"), F.lit(1 if strict else 0).alias("turn"))
    both = keys.unionByName(asked).withColumn("range", range_of(F.col("o"), edges)).withColumn("is_key", F.col("row").isNull())
    # From the top down, the last key seen is the next one above; a running frame costs one step a row.
    above = Window.partitionBy("range").orderBy(F.desc("o"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("next", F.last(F.when(F.col("is_key"), F.struct("o")), ignorenulls=True).over(above))
    firsts = table.select(F.col(f"`{key}`").alias("o")).groupBy(range_of(F.col("o"), edges).alias("range")).agg(F.min("o").alias("first"))
    every = table.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("range")).join(firsts, "range", "left")
    later = F.min("first").over(Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing))  # one row for each range
    lookup = every.select("range", later.alias("later"))
    out = found.where(~F.col("is_key")).join(F.broadcast(lookup), "range")
    made = F.when(F.col("o").isNotNull(), F.when(F.col("next").isNotNull(), F.col("next.o")).otherwise(F.col("later")))
    return out.select("row.*", made.alias("bound"))


def lower_bound(table: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    return bound(table, key, probes, probe, strict=False)


def upper_bound(table: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    return bound(table, key, probes, probe, strict=True)


def range_scan(table: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """Entries with low <= key < high in order; the bounds reach the file scan."""
    if low is not None:
        table = table.where(F.col(f"`{key}`") >= F.lit(low))
    if high is not None:
        table = table.where(F.col(f"`{key}`") < F.lit(high))
    return table.orderBy(key)


def positions(table: DataFrame, key: str, ranges: int = RANGES, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Adds ``position``, from 1, in the order of the key (then of tie)."""
    edges = range_edges(table, F.col(f"`{key}`"), ranges)
    rows = table.withColumn("__range", range_of(F.col(f"`{key}`"), edges))
    side = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    sizes = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(side("__range")).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    order = [side(f"`{key}`")] + ([F.col(f"`{tie}`")] if tie else [])
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = rows.withColumn("__inside", inside).join(F.broadcast(starts), "__range")
    return placed.withColumn("position", F.col("__start") + F.col("__inside")).drop("__range", "__start", "__inside")


def neighbours(table: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``prev`` and ``next``: the keys before and after each unique key, null at the ends."""
    edges = range_edges(table, F.col(f"`{key}`"), ranges)
    rows = table.withColumn("__range", range_of(F.col(f"`{key}`"), edges))
    inside = Window.partitionBy("__range").orderBy(key)
    ends = rows.groupBy("__range").agg(F.min(f"`{key}`").alias("low"), F.max(f"`{key}`").alias("high"))
    over = Window.orderBy("__range")  # one row for each range
    ends = ends.select("__range", F.lag("high").over(over).alias("__below"), F.lead("low").over(over).alias("__above"))
    near = rows.withColumn("__lag", F.lag(key).over(inside)).withColumn("__lead", F.lead(key).over(inside)).join(F.broadcast(ends), "__range")
    near = near.withColumn("prev", F.coalesce("__lag", "__below")).withColumn("next", F.coalesce("__lead", "__above"))
    return near.drop("__range", "__lag", "__lead", "__below", "__above")


def running_sum(table: DataFrame, key: str, amount: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before each one in the order of a unique key."""
    edges = range_edges(table, F.col(f"`{key}`"), ranges)
    rows = table.withColumn("__range", range_of(F.col(f"`{key}`"), edges)).withColumn("__n", amount)
    sums = rows.groupBy("__range").agg(F.sum("__n").alias("s"))
    before = F.sum("s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__n").over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__inside", inside).join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__inside")).drop("__range", "__n", "__start", "__inside")


def ends(table: DataFrame, key: str) -> DataFrame:
    """The first and the last entry, with ``side`` begin or end; no rows for an empty table.  Two aggregates, no sort."""
    entry = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    both = table.agg(F.min_by(entry, f"`{key}`").alias("begin"), F.max_by(entry, f"`{key}`").alias("end"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("e")) for s in ("begin", "end")]))
    return both.select(sides.alias("s")).where("s.e is not null").select("s.side", "s.e.*")


def find(table: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """Each probe with the position of the entry that has exactly this key, null past the end."""
    placed = positions(table.select(F.col(f"`{key}`").alias("__key")), "__key")
    return probes.join(placed, F.col(f"`{probe}`") == F.col("__key"), "left").drop("__key")


def steps(table: DataFrame, key: str, start, count: int, back: bool = False) -> DataFrame:
    """Up to ``count`` entries from the bound at ``start`` on, or before it going back; each task sorts no more than that."""
    at = F.col(f"`{key}`")
    if back:
        return table.where(at < F.lit(start)).orderBy(at.desc()).limit(count)
    return table.where(at >= F.lit(start)).orderBy(at.asc()).limit(count)


def same_order(table: DataFrame, key: str) -> DataFrame:
    """Entries whose key isn't above the one before it in the order, or is null: what breaks an ordered table (empty for a good one)."""
    return neighbours(table, key).where(F.col(f"`{key}`").isNull() | (F.col("prev") >= F.col(f"`{key}`")))
