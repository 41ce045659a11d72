import random

import pytest

from quernel.operators import ordered
from quernel.operators.keyed import Keyed
from quernel.streaming import ops as streaming


def model(log, start=None):
    """The log applied to a dictionary: final state and each operation's result."""
    state, results = dict(start or {}), []
    for seq, op, key, value in log:
        old = state.get(key)
        if op == "put" or (op in ("insert", "get_or_put") and key not in state):
            state[key] = value
        elif op == "remove":
            state.pop(key, None)
        results.append((seq, op, key, old is not None, old, state.get(key)))
    return state, results


def random_log(n, keys, seed):
    r = random.Random(seed)
    kinds = ["put", "put", "insert", "get_or_put", "remove", "get"]
    return [(s, r.choice(kinds), r.randrange(keys) if r.random() > 0.3 else 0, r.randrange(10**6)) for s in range(n)]


@pytest.mark.parametrize(("n", "keys", "held"), [(20_000, 512, 0), (5_000, 4_096, 300), (300, 3, 2), (0, 1, 5)])
def test_logs_against_a_dictionary(spark, n, keys, held):
    log = random_log(n, keys, n)
    start = {k: k * 100 for k in range(held)}
    table = spark.createDataFrame(list(start.items()), "key long, value long")
    ops = spark.createDataFrame(log, "seq long, op string, key long, value long")
    state, results = model(log, start)
    assert {(r.key, r.value) for r in Keyed().apply_ops(table, ops).collect()} == set(state.items())
    got = Keyed().op_results(ops, table).collect()
    assert sorted(map(tuple, got)) == sorted(results, key=lambda r: r[0])


def test_custom_equality_keeps_the_first_key(spark):
    tens = Keyed(canonical=lambda k: (k / 10).cast("long"))
    batch = spark.createDataFrame([(1, 21, 1), (2, 29, 2)], "seq long, key long, value long")
    held = tens.put(spark.createDataFrame([], "key long, value long"), batch)
    assert [tuple(r) for r in held.collect()] == [(21, 2)]
    probes = spark.createDataFrame([(20,), (28,), (31,)], "key long")
    assert {(r.key, r.found, r.value) for r in tens.get(held, probes).collect()} == {(20, True, 2), (28, True, 2), (31, False, None)}
    assert {r.key for r in tens.contains(held, probes).collect()} == {20, 28}
    ops = batch.selectExpr("seq", "'put' as op", "key", "value")
    assert [tuple(r) for r in tens.apply_ops(None, ops).collect()] == [(21, 2)]


def test_single_operations(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value long")
    batch = spark.createDataFrame([(1, "b", 9), (2, "c", 3), (3, "c", 4)], "seq long, key string, value long")
    keyed = Keyed()
    assert {tuple(r) for r in keyed.insert(table, batch).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in keyed.put(table, batch).collect()} == {("a", 1), ("b", 9), ("c", 4)}
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    assert {tuple(r) for r in keyed.remove(table, keys).collect()} == {("b", 2)}
    assert {tuple(r) for r in keyed.fetch_remove(table, keys).collect()} == {("a", 1)}
    assert keyed.check(table).count() == 0
    assert {r.canonical for r in keyed.check(table.union(table.limit(1))).collect()} and keyed.check(spark.createDataFrame([(None, 1)], "key string, value long")).count() == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_bounds_against_a_sorted_list(spark, kind):
    r = random.Random(7)
    keys = sorted({r.randrange(5000) for _ in range(700)})
    asked = [(step * 131 + i * 977) % 5000 for step in range(5) for i in range(64)] + [0, 4999, 10_000]
    text = (lambda k: f"{k:06d}") if kind == "string" else (lambda k: k)
    table = spark.createDataFrame([(text(k),) for k in keys], f"key {kind}")
    probes = spark.createDataFrame([(text(p), 1) for p in asked] + [(None, 2)], f"probe {kind}, bound_by int")
    for strict in (False, True):
        got = ordered.bound(table, "key", probes, "probe", strict).collect()
        want = sorted((text(p), next((text(k) for k in keys if (k > p if strict else k >= p)), None)) for p in asked)
        assert sorted(((x.probe, x.bound) for x in got if x.probe is not None), key=lambda t: t[0]) == sorted(want, key=lambda t: t[0])
    empty = ordered.lower_bound(table.limit(0), "key", probes, "probe").collect()
    assert len(empty) == len(asked) + 1 and all(x.bound is None for x in empty)


def test_positions_neighbours_and_sums(spark):
    keys = random.Random(3).sample(range(100_000), 2000)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "key long, n long")
    keys.sort()
    assert {r.key: r.position for r in ordered.positions(df, "key").collect()} == {k: i + 1 for i, k in enumerate(keys)}
    assert {r.key: r.position for r in ordered.positions(df, "key", descending=True).collect()} == {k: 2000 - i for i, k in enumerate(keys)}
    near = {r.key: (r.prev, r.next) for r in ordered.neighbours(df, "key").collect()}
    assert near == {k: (keys[i - 1] if i else None, keys[i + 1] if i < 1999 else None) for i, k in enumerate(keys)}
    sums, total = {}, 0
    for k in keys:
        sums[k], total = total, total + k % 7
    from pyspark.sql import functions as F

    assert {r.key: r.start for r in ordered.running_sum(df, "key", F.col("n"), "start").collect()} == sums
    assert [r.key for r in ordered.range_scan(df, "key", 1000, 5000).collect()] == [k for k in keys if 1000 <= k < 5000]


def test_a_stream_of_operations(spark, tmp_path):
    log = random_log(400, 20, 11)
    _, results = model(log)
    frame = spark.createDataFrame(log, "seq long, op string, key long, value long")
    for part in range(4):
        frame.where(f"seq >= {part * 100} and seq < {part * 100 + 100}").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = streaming.apply_ops(source).writeStream.format("memory").queryName("results").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.sql("select seq, op, key, found, old_value, new_value from results").collect()
    assert len(got) == len(results)
    assert sorted(r.seq for r in got) == list(range(400))
    final = {}
    for r in sorted(got, key=lambda r: r.seq):
        final[r.key] = r.new_value
    assert {k: v for k, v in final.items() if v is not None} == model(log)[0]
