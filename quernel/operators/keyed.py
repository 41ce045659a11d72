"""Tables of unique keys: insert, put, get, remove and whole logs of operations, set at a time.

A table is a DataFrame with a key and a value column.  Keys are equal if their canonical forms are; by
default a key is its own.  The key object that came first is kept, later puts replace the value only.
Logs are DataFrames with ``seq`` (their order), ``op`` (put, insert, get_or_put, get, remove), a key and a
value.  Everything is joins and aggregates on the canonical key: batches are combined before they are
shuffled, so a key that most operations name is no burden where only final states are asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.errors import InvalidColumnData

Canonical = Callable[[Column], Column]


@dataclass(frozen=True)
class Keyed:
    """Names of a table's columns and the form in which keys are compared."""

    key: str = "key"
    value: str | None = "value"
    seq: str = "seq"
    canonical: Canonical | None = None

    def with_form(self, df: DataFrame) -> DataFrame:
        key = F.col(f"`{self.key}`")
        return df.withColumn("__k", self.canonical(key) if self.canonical else key)

    def columns(self) -> list[str]:
        return [self.key] + ([self.value] if self.value else [])

    # Single operations, each on a whole batch.

    def first_of(self, batch: DataFrame) -> DataFrame:
        """Of each key in a batch the entry that came first."""
        held = F.struct(*[F.col(f"`{c}`") for c in self.columns()])
        return self.with_form(batch).groupBy("__k").agg(F.min_by(held, self.seq).alias("e")).select("__k", "e.*")

    def merged(self, batch: DataFrame) -> DataFrame:
        """Of each key in a batch its first key object with its last value."""
        out = [F.min_by(F.col(f"`{self.key}`"), self.seq).alias(self.key)]
        if self.value:
            out.append(F.max_by(F.struct(F.col(f"`{self.value}`")), self.seq)[self.value].alias(self.value))
        return self.with_form(batch).groupBy("__k").agg(*out)

    def insert(self, table: DataFrame, batch: DataFrame) -> DataFrame:
        """The table after inserting what isn't in it; the first of a batch's equal keys counts."""
        fresh = self.first_of(batch).join(self.with_form(table).select("__k"), "__k", "left_anti")
        return table.select(*self.columns()).unionByName(fresh.select(*self.columns()))

    def put(self, table: DataFrame, batch: DataFrame) -> DataFrame:
        """The table after putting all entries in order."""
        old, new = self.with_form(table).select("__k", *self.columns()).alias("o"), self.merged(batch).alias("n")
        both = old.join(new, F.col("o.__k") == F.col("n.__k"), "full_outer")
        out = [F.when(F.col("o.__k").isNotNull(), F.col(f"o.{self.key}")).otherwise(F.col(f"n.{self.key}")).alias(self.key)]
        if self.value:
            out.append(F.when(F.col("n.__k").isNotNull(), F.col(f"n.{self.value}")).otherwise(F.col(f"o.{self.value}")).alias(self.value))
        return both.select(*out)

    def get(self, table: DataFrame, probes: DataFrame, default: Column | None = None) -> DataFrame:
        """Each probe (a table with the key column) with found and the value, null or the default if there is none."""
        held = self.with_form(table).select("__k", F.col(f"`{self.value}`").alias("__v"), F.lit(True).alias("__found"))
        both = self.with_form(probes).join(held, "__k", "left")
        value = F.col("__v") if default is None else F.when(F.col("__found"), F.col("__v")).otherwise(default)
        return both.select(*[F.col(f"`{c}`") for c in probes.columns if c != self.value], F.coalesce("__found", F.lit(False)).alias("found"), value.alias(self.value))

    def contains(self, table: DataFrame, probes: DataFrame) -> DataFrame:
        """The probes that are in the table."""
        return self.with_form(probes).join(self.with_form(table).select("__k"), "__k", "left_semi").drop("__k")

    def remove(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        return self.with_form(table).join(self.with_form(keys).select("__k"), "__k", "left_anti").drop("__k")

    def fetch_remove(self, table: DataFrame, keys: DataFrame) -> DataFrame:
        """The entries that ``remove`` takes out."""
        return self.with_form(table).join(self.with_form(keys).select("__k"), "__k", "left_semi").drop("__k")

    def check(self, table: DataFrame) -> DataFrame:
        """Rows that break the table's rules: null keys, and keys that are there more than once (empty for a good table)."""
        counted = self.with_form(table).groupBy("__k").agg(F.count(F.lit(1)).alias("entries"))
        return counted.where("__k is null or entries > 1").select(F.col("__k").alias("canonical"), "entries")

    # Logs.

    def apply_ops(self, table: DataFrame | None, ops: DataFrame) -> DataFrame:
        """The table after a log of operations.

        What was last put or removed decides; after it, the first insertion into nothing.  Both are aggregates,
        so no task holds a key's whole log.
        """
        log = self.with_form(ops).where(F.col("op") != "get")
        if table is not None:
            start = self.with_form(table).select("__k", F.lit(None).cast("long").alias(self.seq), F.lit("put").alias("op"), *self.columns())
            log = log.select("__k", F.col(f"`{self.seq}`").cast("long").alias(self.seq), "op", *self.columns()).unionByName(start)
        order = F.coalesce(F.col(f"`{self.seq}`").cast("long"), F.lit(-(2**63)))
        log = log.select("__k", order.alias("at"), "op", *self.columns())
        sets = F.col("op").isin("put", "remove")
        entry = F.struct("op", *self.columns())
        last = log.groupBy("__k").agg(F.max(F.when(sets, F.col("at"))).alias("set_at"), F.max_by(entry, F.when(sets, F.col("at"))).alias("set"))
        later = log.where(~sets).join(last.select("__k", "set_at", F.col("set.op").alias("set_op")), "__k")
        later = later.where("set_op is null or (set_op = 'remove' and at > set_at)")
        made = later.groupBy("__k").agg(F.min_by(F.struct(*self.columns()), "at").alias("made"), F.min("at").alias("made_at"))
        # The key object that stays is the one that made the entry: the first put or insertion after the last removal.
        removed = log.where("op = 'remove'").groupBy("__k").agg(F.max("at").alias("removed_at"))
        firsts = log.where("op <> 'remove'").join(removed, "__k", "left").where("removed_at is null or at > removed_at")
        firsts = firsts.groupBy("__k").agg(F.min_by(F.col(f"`{self.key}`"), "at").alias("first_key"))
        state = last.join(made, "__k", "left").join(firsts, "__k").where("set.op = 'put' or made is not null")
        out = [F.col("first_key").alias(self.key)]
        if self.value:
            out.append(F.when(F.col("set.op") == "put", F.col(f"set.{self.value}")).otherwise(F.col(f"made.{self.value}")).alias(self.value))
        return state.select(*out)

    def op_results(self, ops: DataFrame, table: DataFrame | None = None) -> DataFrame:
        """For each operation of a log: found (the key was there before it), old_value and new_value (null if there is none).

        Results of one key depend on each other in order, so a key's log is sorted in one task (it spills, it isn't collected).
        """
        log = self.with_form(ops).select("__k", F.col(f"`{self.seq}`").cast("long").alias("at"), "op", F.col(f"`{self.key}`").alias("k"), F.col(f"`{self.value}`").alias("v"))
        if table is not None:
            start = self.with_form(table).select("__k", F.lit(-(2**63)).alias("at"), F.lit("put").alias("op"), F.col(f"`{self.key}`").alias("k"), F.col(f"`{self.value}`").alias("v"))
            log = log.unionByName(start)
        by_key = Window.partitionBy("__k").orderBy("at")
        sets = F.col("op").isin("put", "remove")
        # Between two operations that set the state whatever it was, only the first insertion into nothing counts.
        log = log.withColumn("part", F.sum(sets.cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        in_part = Window.partitionBy("__k", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        set_entry = F.when(F.col("op") == "put", F.struct("v"))
        insertion = F.when(F.col("op").isin("insert", "get_or_put"), F.struct("v"))
        state = F.coalesce(F.first(set_entry, ignorenulls=True).over(in_part), F.first(insertion, ignorenulls=True).over(in_part))
        log = log.withColumn("after", state).withColumn("before", F.lag("after").over(by_key))
        done = log.where(F.col("at") > -(2**63)) if table is not None else log
        return done.select(
            F.col("at").alias(self.seq), "op", F.col("k").alias(self.key), F.col("before").isNotNull().alias("found"),
            F.col("before.v").alias("old_value"), F.col("after.v").alias("new_value"),
        )

    def require_value(self) -> None:
        if self.value is None:
            raise InvalidColumnData("a set of keys has no values")
