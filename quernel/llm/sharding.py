"""Shards of nearly equal bytes by sampled splitters, in DataFrame operations only (operator 2).

1. A narrow table (id, size, checksum, 64-bit key of the text) is made once and written durably.
2. Key samples are drawn with a chance proportional to a row's size, and their quantiles become range
   boundaries.  The number of ranges follows the input (``RANGE_ROWS`` rows each), so does the sample; both
   stay tables, summed inside the key's leading bits, so neither meets in one task or on the driver.
3. Rows are put into ranges; ranges that hold too many rows (one text with a third of all rows has one
   key) are subdivided by a hash of the row, so that no task sorts an unbounded range.
4. Exact sums of the ranges give each row its place in the total order, in bytes; a shard is an equal
   part of that, so shards differ by less than a document and ``WHOLE_GROUPS`` of a shard.  Slots are
   places in a shard.

Equal texts have equal keys and so lie side by side; a group of copies is parted only where it is large
and a shard ends in it, or where its range was overfull.

Defined cases: null texts have size 1 and checksum 0, as empty ones; a row larger than a shard's part
takes the shard that its middle lies in; ties (equal text and id) are ordered by the row's place in the
durable table; with fewer rows than shards some shards are empty; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.llm.common import durable, small

#: Rows that one range should hold; a range with more than twice as many is subdivided.
RANGE_ROWS = 100_000
MIN_RANGES = 64
#: Samples for each range; the largest sum of sampling errors stays far below a range.
SAMPLES = 40
#: A group of equal texts isn't parted at a shard's border if it is at most this share of a shard.
WHOLE_GROUPS = 0.005
#: Ranges are found by the leading bits of the key, so that a row is compared with few boundaries only.
PREFIX_BITS = 12


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"))
    return durable(rows.withColumn("row", F.monotonically_increasing_id()))


def _prefix(key: Column) -> Column:
    return F.shiftright(key, 64 - PREFIX_BITS)


def _summed(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before each one in the order of prefix, then ``order``.

    A window runs inside one prefix only; one row for each prefix, 2^PREFIX_BITS at most, carries the sums on.
    """
    whole = df.groupBy("prefix").agg(F.sum(amount).alias("__whole"))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("prefix", F.coalesce(F.sum("__whole").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("prefix").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(F.broadcast(starts), "prefix")
    return summed.withColumn(name, F.col("__start") + F.col("__inside")).drop("__start", "__inside")


def splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Boundaries (prefix, edge) of about equal bytes from a size-weighted sample, at most twice ``ranges``.

    A boundary is the first key of a range.  A key that several quantiles fall on gets a range of its own.
    """
    want = ranges * SAMPLES
    chance = F.col("size") * F.lit(want / total)
    draw = F.xxhash64(F.col("key"), F.col("row"), F.lit("draw")) / F.lit(2.0**64) + 0.5
    # A row whose size is more than one step counts once for each whole step it covers.
    steps = F.floor(chance) + F.when(draw < chance - F.floor(chance), 1).otherwise(0)
    # Copies are combined, so that a hot key is one row of the sample.
    sample = rows.select("key", steps.cast("long").alias("steps")).where("steps > 0").groupBy("key").agg(F.sum("steps").alias("steps"))
    sample = durable(sample.withColumn("prefix", _prefix(F.col("key"))))
    drawn = int(sample.agg(F.sum("steps")).first()[0] or 0)
    cell = lambda at: F.floor(at * F.lit(ranges) / F.lit(max(drawn, 1)))
    placed = _summed(sample, ["key"], "steps", "at").select("key", cell(F.col("at")).alias("first"), cell(F.col("at") + F.col("steps")).alias("last"))
    starts = placed.where("last > first").select("key", "first", "last")
    last_key = F.lit(2**63 - 1).cast("long")
    own = F.when((F.col("last") > F.col("first") + 1) & (F.col("key") < last_key), F.array("key", F.col("key") + 1)).otherwise(F.array("key"))
    edges = starts.select(F.explode(own).alias("edge")).distinct()
    return durable(edges.select(_prefix(F.col("edge")).alias("prefix"), "edge"))


def _ranged(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds prefix and ``range``: how many boundaries of the prefix are at or below the row."""
    listed = edges.groupBy("prefix").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    joined = rows.withColumn("prefix", _prefix(F.col("key"))).join(small(listed, edges.count()), "prefix", "left")
    mine = F.expr("size(filter(coalesce(edges, cast(array() as array<bigint>)), e -> e <= key))")
    return joined.select("id", "size", "crc", "key", "row", "prefix", mine.alias("range"))


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """id_col, size long, text_crc32 long, law string, shard int, slot long, grown_shard int for every row."""
    rows = _narrow(df, id_col, text_col)
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 1
    ranges = max(MIN_RANGES, -(-count // range_rows))
    placed = _ranged(rows, splitters(rows, total, ranges))
    held = durable(placed.groupBy("prefix", "range").agg(F.count(F.lit(1)).alias("n")))
    # Overfull ranges are subdivided by the row's hash; the parts follow each other in the total order.
    most = max(1, -(-count // ranges))
    parts = held.where(F.col("n") > 2 * most).select("prefix", "range", F.ceil(F.col("n") / most).alias("parts"))
    placed = placed.join(small(parts, parts.count()), ["prefix", "range"], "left")
    placed = placed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts")), F.lit(0)))
    sums = placed.groupBy("prefix", "range", "part").agg(F.sum("size").alias("bytes"))
    starts = durable(_summed(sums, ["range", "part"], "bytes", "start").select("prefix", "range", "part", "start"))
    pieces = starts.count()
    inside = Window.partitionBy("prefix", "range", "part").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ordered = ordered.join(small(starts, pieces), ["prefix", "range", "part"])
    # A small group of equal texts goes where its middle lies, a large one is parted at the border.
    texts = Window.partitionBy("prefix", "range", "part", "key")
    ordered = ordered.withColumn("group_bytes", F.sum("size").over(texts)).withColumn("group_ahead", F.min("ahead").over(texts))
    whole = F.col("group_bytes") <= F.lit(WHOLE_GROUPS * total / shards)
    middle = F.col("start") + F.when(whole, F.col("group_ahead") + F.col("group_bytes") / 2).otherwise(F.col("ahead") + F.col("size") / 2)
    ordered = ordered.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))
    slot = F.row_number().over(Window.partitionBy("prefix", "range", "part", "shard").orderBy("key", "id", "row"))
    ordered = durable(ordered.select("id", "size", "crc", "prefix", "range", "part", "shard", slot.alias("place")))
    counts = ordered.groupBy("shard", "prefix", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    # A shard's slots run through its prefixes: sums inside a prefix, and of whole prefixes before it.
    inner = Window.partitionBy("shard", "prefix").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("shard").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    whole = counts.groupBy("shard", "prefix").agg(F.sum("n").alias("n"))
    whole = whole.select("shard", "prefix", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(whole, ["shard", "prefix"])
    offsets = durable(offsets.select("prefix", "range", "part", "shard", (F.col("before") + F.col("ahead")).alias("offset")))
    done = ordered.join(small(offsets, pieces + shards), ["prefix", "range", "part", "shard"])
    return done.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of df as one folder of Parquet files for each shard, in slot order within a file."""
    shards = placed.select(id_col, F.col("shard").alias("shard"), F.col("slot").alias("slot"))
    # Many files a shard: rows of a shard are dealt on by blocks of slots, so no task writes a whole shard.
    block = F.floor(F.col("slot") / 50_000)
    df.join(shards, id_col).repartition("shard", block).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
