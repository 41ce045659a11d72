"""Logs of operations as a stream: the state of each key is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "there boolean, value long"
OUT = "key long, seq long, op string, found boolean, old_value long, new_value long"


def step(op: str, there: bool, old, value):
    """Whether the key is there after an operation, and its value."""
    if op == "remove":
        return False, None
    if op == "put" or (op in ("insert", "get_or_put") and not there):
        return True, value
    return there, old


def _fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    there, value = state.get if state.exists else (False, None)
    rows = []
    log = pd.concat(list(parts)).sort_values("seq")
    for seq, op, given in zip(log["seq"], log["op"], log["value"], strict=True):
        was_there, old = there, value
        there, value = step(op, there, value, None if pd.isna(given) else int(given))
        rows.append((key[0], int(seq), op, bool(was_there), old, value))
    state.update((bool(there), value))
    columns = [c.split()[0] for c in OUT.split(", ")]
    yield pd.DataFrame(rows, columns=columns).astype({"old_value": "Int64", "new_value": "Int64"})


def apply_ops(stream: DataFrame) -> DataFrame:
    """stream: key long, seq long, op, value long, in rising seq from batch to batch.  The result of each operation, as ``Keyed.op_results`` gives it."""
    keyed = stream.selectExpr("cast(key as long) as key", "cast(seq as long) as seq", "op", "cast(value as long) as value").groupBy("key")
    return keyed.applyInPandasWithState(_fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
