"""Nested columns as flat tables, and back: level triplets, list and map views, assembly.

A leaf is named by its path: list elements are ``list.element``, map parts ``key_value.key`` and
``key_value.value``.  Rows are named by an id column; every output has it, so nothing is numbered globally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quernel.errors import CorruptPage, InvalidColumnData, UnsupportedNestedSchema


@dataclass(frozen=True)
class Leaf:
    """A leaf column: its path, type, and how deep optional and repeated levels go on the way to it."""

    path: tuple[str, ...]
    kind: T.DataType
    max_definition: int
    max_repetition: int
    repeated: tuple[tuple[str, ...], ...]
    ancestors: tuple[tuple[str, tuple[str, ...]], ...]

    @property
    def name(self) -> str:
        return ".".join(self.path)


def leaves(schema: T.StructType) -> list[Leaf]:
    """All leaves in order, with levels from the schema's nullability."""
    out: list[Leaf] = []

    def walk(kind: T.DataType, optional: bool, path: tuple, d: int, r: int, repeated: tuple, above: tuple) -> None:
        d += optional
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f.nullable, (*path, f.name), d, r, repeated, above)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, kind.containsNull, (*path, "list", "element"), d + 1, r + 1, (*repeated, (*path, "list")), (*above, ("list", path)))
        elif isinstance(kind, T.MapType):
            at = (*path, "key_value")
            walk(kind.keyType, False, (*at, "key"), d + 1, r + 1, (*repeated, at), (*above, ("map", path)))
            walk(kind.valueType, kind.valueContainsNull, (*at, "value"), d + 1, r + 1, (*repeated, at), (*above, ("map", path)))
        else:
            out.append(Leaf(path, kind, d, r, repeated, above))

    for f in schema.fields:
        walk(f.dataType, f.nullable, (f.name,), 0, 0, (), ())
    return out


def leaf(schema: T.StructType, path: str) -> Leaf:
    """The leaf with this dotted path; the first one counts."""
    for x in leaves(schema):
        if x.name == path:
            return x
    raise InvalidColumnData(f"no leaf column {path}")


def leaf_index(schema: T.StructType, path: str) -> int:
    return leaves(schema).index(leaf(schema, path))


def leaf_column(df: DataFrame, path: str) -> Column:
    """The values of a leaf, with one array around them for each repeated level."""
    found = leaf(df.schema, path)

    def go(c: Column, rest: tuple[str, ...]) -> Column:
        if not rest:
            return c
        if rest[:2] == ("list", "element"):
            return F.transform(c, lambda x: go(x, rest[2:])) if rest[2:] else c
        if rest[0] == "key_value":
            parts = F.transform(F.map_entries(c), lambda e: e.getField(rest[1]))
            return F.transform(parts, lambda x: go(x, rest[2:])) if rest[2:] else parts
        return go(c.getField(rest[0]), rest[1:])

    return go(df[f"`{found.path[0]}`"], found.path[1:])


def select_leaves(df: DataFrame, paths: list[str], flat: bool = False) -> DataFrame:
    """Leaves as columns named by their paths, in the order given, repeated names included; flat refuses repeated leaves."""
    if flat:
        for p in paths:
            if leaf(df.schema, p).max_repetition:
                raise UnsupportedNestedSchema(p)
    return df.select(*[leaf_column(df, p).alias(p) for p in paths])


def triplets(df: DataFrame, path: str, row: str) -> DataFrame:
    """One row for each level entry of a leaf: row, entry (from 0 in its row), rep, def, value (null unless def is the largest).

    Each repeated level is one outer explosion; rows are numbered inside their own row only.
    """
    found = leaf(df.schema, path)
    now = df.select(F.col(f"`{row}`").alias("row"), F.col(f"`{found.path[0]}`").alias("v"), F.lit(0).alias("def"), F.lit(0).alias("rep"), F.array().cast("array<int>").alias("at"), F.lit(True).alias("open"))
    kind, optional = df.schema[found.path[0]].dataType, df.schema[found.path[0]].nullable
    rest, level = list(found.path[1:]), 0

    def step_in(now: DataFrame, optional: bool) -> DataFrame:
        """A level that may be null: there it counts and goes on, else it ends."""
        there = F.col("open") & F.col("v").isNotNull()
        return now.withColumn("def", F.col("def") + F.when(there, int(optional)).otherwise(0)).withColumn("open", there)

    now = step_in(now, optional)
    while isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        if isinstance(kind, T.StructType):
            f = kind[rest.pop(0)]
            now = now.withColumn("v", F.when(F.col("open"), F.col("v").getField(f.name)))
            kind, optional = f.dataType, f.nullable
        else:
            level += 1
            if isinstance(kind, T.ArrayType):
                items, kind, optional, rest = F.col("v"), kind.elementType, kind.containsNull, rest[2:]
            else:
                part = rest[1]
                items = _map_part(F.col("v"), part)
                kind, optional, rest = (kind.keyType, False, rest[2:]) if part == "key" else (kind.valueType, kind.valueContainsNull, rest[2:])
            items = F.when(F.col("open"), items)
            now = now.select("row", "def", "rep", "at", F.posexplode_outer(items).alias("p", "v"))
            now = now.withColumn("open", F.col("p").isNotNull())
            now = now.withColumn("def", F.col("def") + F.col("open").cast("int")).withColumn("rep", F.when(F.coalesce("p", F.lit(0)) > 0, level).otherwise(F.col("rep")))
            now = now.withColumn("at", F.concat("at", F.array(F.coalesce("p", F.lit(0))))).drop("p")
        now = step_in(now, optional)
    entry = F.row_number().over(Window.partitionBy("row").orderBy("at")) - 1
    return now.select("row", entry.alias("entry"), "rep", "def", F.when(F.col("open"), F.col("v")).alias("value"))


def _map_part(c: Column, part: str) -> Column:
    return F.transform(F.map_entries(c), lambda e: e.getField(part))


def level_starts(levels: DataFrame, level: int) -> DataFrame:
    """The entries of a triplet table at which an item of a repeated level begins (level 0: a row)."""
    return levels.where(F.col("rep") <= level)


def check_levels(levels: DataFrame, max_definition: int, max_repetition: int) -> None:
    """Raises if a row doesn't begin at repetition 0, goes on at it, or has levels out of range."""
    bad = levels.where((F.col("rep") > max_repetition) | (F.col("def") > max_definition) | ((F.col("entry") == 0) != (F.col("rep") == 0)))
    if bad.limit(1).count():
        raise CorruptPage("levels contradict each other")


def list_view(df: DataFrame, column: str, row: str) -> DataFrame:
    """row, valid, length of every list; null lists have length 0."""
    c = F.col(f"`{column}`")
    return df.select(F.col(f"`{row}`").alias("row"), c.isNotNull().alias("valid"), F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long").alias("length"))


def list_elements(df: DataFrame, column: str, row: str) -> DataFrame:
    """row, pos, valid, value of every list element."""
    return df.select(F.col(f"`{row}`").alias("row"), F.posexplode(f"`{column}`").alias("pos", "value")).select("row", "pos", F.col("value").isNotNull().alias("valid"), "value")


def map_view(df: DataFrame, column: str, row: str) -> DataFrame:
    """row, pos, key, valid, value of every map entry; entries with equal keys are kept apart."""
    entries = df.select(F.col(f"`{row}`").alias("row"), F.posexplode(F.map_entries(f"`{column}`")).alias("pos", "e"))
    return entries.select("row", "pos", F.col("e.key").alias("key"), F.col("e.value").isNotNull().alias("valid"), F.col("e.value").alias("value"))


def nested_levels(df: DataFrame, path: str, row: str) -> list[DataFrame]:
    """For each list or map on the way to a leaf: row, at (places of the items around it), valid, length; last the leaf's slots: row, at, valid, value."""
    found = leaf(df.schema, path)
    now = df.select(F.col(f"`{row}`").alias("row"), F.array().cast("array<int>").alias("at"), F.col(f"`{found.path[0]}`").alias("v"))
    kind, rest, out = df.schema[found.path[0]].dataType, list(found.path[1:]), []
    while isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        if isinstance(kind, T.StructType):
            f = kind[rest.pop(0)]
            now, kind = now.withColumn("v", F.col("v").getField(f.name)), f.dataType
            continue
        out.append(now.select("row", "at", F.col("v").isNotNull().alias("valid"), F.when(F.col("v").isNull(), 0).otherwise(F.size("v")).cast("long").alias("length")))
        items, kind = (F.col("v"), kind.elementType) if isinstance(kind, T.ArrayType) else (_map_part(F.col("v"), rest[1]), kind.keyType if rest[1] == "key" else kind.valueType)
        rest = rest[2:]
        now = now.select("row", "at", F.posexplode(items).alias("p", "v")).select("row", F.concat("at", F.array("p")).alias("at"), "v")
    return [*out, now.select("row", "at", F.col("v").isNotNull().alias("valid"), F.col("v").alias("value"))]


def map_pair(df: DataFrame, key_path: str, value_path: str, row: str) -> DataFrame:
    """Key and value leaves of their deepest common map, side by side: row, at, key, value."""
    a, b = leaf(df.schema, key_path), leaf(df.schema, value_path)
    shared = [x for x in zip(a.ancestors, b.ancestors, strict=False) if x[0] == x[1]]
    if not shared or shared[-1][0][0] != "map" or len(a.ancestors) != len(shared) or not a.name.endswith(".key"):
        raise UnsupportedNestedSchema(f"{key_path} and {value_path} have no common map")
    if len(b.ancestors) != len(shared):
        raise UnsupportedNestedSchema(f"{value_path} goes deeper than its key")
    keys, values = nested_levels(df, key_path, row)[-1], nested_levels(df, value_path, row)[-1]
    return keys.select("row", "at", F.col("value").alias("key")).join(values.select("row", "at", "value"), ["row", "at"])


def assemble_lists(levels: DataFrame, optional_list: bool = True) -> DataFrame:
    """row and items from the triplets of a one-level list; a row's entries are put together in its own group."""
    empty = int(optional_list)
    shown = empty + 1
    entries = F.sort_array(F.collect_list(F.when(F.col("def") >= shown, F.struct("entry", "value"))))
    made = levels.groupBy("row").agg(entries.alias("e"), F.max("def").alias("d"))
    return made.select("row", F.when(F.col("d") >= empty, F.transform("e", lambda x: x.getField("value"))).alias("items"))


def assemble(rows: DataFrame, row: str, pos: str, value: str, name: str = "items") -> DataFrame:
    """One list for each row id from (row, pos, value) rows, in the order of pos."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(f"`{pos}`").alias("p"), F.col(f"`{value}`").alias("v"))))
    return rows.groupBy(row).agg(entries.alias("__e")).select(row, F.transform("__e", lambda x: x.getField("v")).alias(name))


def payload(df: DataFrame, path: str, row: str) -> DataFrame:
    """One row of totals over a leaf: entries, values, nulls, and the sum of its numbers, true values or byte lengths."""
    found = leaf(df.schema, path)
    slots = nested_levels(df, path, row)[-1]
    v = F.col("value")
    if isinstance(found.kind, T.BooleanType):
        amount = F.sum(v.cast("long"))
    elif isinstance(found.kind, (T.StringType, T.BinaryType)):
        amount = F.sum(F.octet_length(v).cast("long"))
    else:
        amount = F.sum(v)
    return slots.agg(F.count(F.lit(1)).alias("slots"), F.count(v).alias("present"), F.coalesce(F.sum((~F.col("valid")).cast("long")), F.lit(0)).alias("nulls"), amount.alias("total"))
