"""Best-fit packing of token sequences by linear grouping (operator 7).

Documents are encoded where they are read; a longer one is cut, and only the pieces' ids and lengths go
on.  The plan needs nothing but the number of pieces of each length, at most one number for each length
up to the capacity, so it is made on the driver at a cost that does not depend on the corpus:

1. Large lengths are put into groups of equal cardinality and rounded up to the largest of their group.
2. Configurations of these few sizes are optimised by column generation (a knapsack prices new ones).
3. Actual lengths are substituted, largest first, for the rounded ones.
4. What rounding down left over, and all small lengths, go best-fit, longest first, into the gaps.

Sequences that hold the same lengths are kept as one run with a count, so the plan stays small.  Each
piece then finds its place by its length and its rank among the pieces of that length; ranks are counted
in buckets of rows, so a length that a third of the corpus has is not ranked in one task.

Defined cases: null and empty texts are the end mark alone; a text longer than the capacity becomes full
pieces after a first shorter one; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.llm import bpe
from quernel.llm.common import durable

CAPACITY = 2048
END_ID = 0
#: Lengths over capacity // part are large.  Each of these is tried and the plan with fewest sequences is taken:
#: with 2 every large piece begins a sequence, which is best where small pieces fill all that is left; with 4
#: configurations of up to three large pieces are optimised, which is best where small pieces are few.
LARGE_PARTS = (2, 4)
GROUPS = 256
#: Sequences that a better plan of the large pieces could save at most.
CLOSE = 0.5
#: Rows of a rank bucket.
BUCKET_ROWS = 200_000
MIN_BUCKETS = 32


def pieces(df: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece int, start long, length long, ids_crc32 long of every piece; with_ids also the ids (binary)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(vocabulary, pattern)
        for t in bpe.blocks(batches, "text"):
            done = encoder.block(t["text"].combine_chunks() if isinstance(t["text"], pa.ChunkedArray) else t["text"])
            row, piece, start, length, crc, packed = [], [], [], [], [], []
            for k in range(len(t)):
                ids = np.append(done.text(k), END_ID).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[a:b].tobytes()
                    row.append(k), piece.append(n), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if with_ids:
                        packed.append(part)
            columns = [t["id"].combine_chunks().take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, out)


def linear_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), longest first, in groups of equal cardinality; a length may lie in two of them.  Few lengths are a group each: nothing need be rounded."""
    if len(large) <= groups:
        return [[x] for x in large]
    total = sum(n for _, n in large)
    out: list[list[tuple[int, int]]] = [[]]
    room = -(-total // groups)
    each = room
    for length, n in large:
        while n:
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
            if not room:
                out.append([])
                room = each
    return [g for g in out if g]


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Multisets of sizes (by index, longest first) that fit the capacity, and how often to use each, rounded down.

    The relaxed covering problem by column generation, until no plan can use ``CLOSE`` sequences fewer: what the
    prices of a round give, divided by the value of the best multiset at these prices, is a bound for every plan.
    """
    k, most = len(sizes), capacity // min(sizes)
    room = np.arange(capacity + 1)
    # Equal demands would let rounds go in a circle, so each differs a little.
    need = np.array(demand, float) + np.random.default_rng(0).uniform(1e-5, 1e-4, k)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.linalg.inv(basis)
    rounds = 0
    while True:
        prices = inverse.sum(axis=0)
        # A size that a shorter one is worth as much as is in no best multiset.
        worth, dearest = [], 0.0
        for g in range(k - 1, -1, -1):
            if prices[g] > dearest:
                worth.append(g)
                dearest = prices[g]
        # The best multiset of at most j sizes for every amount of room, j = 1, 2, ...
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            values = np.full((len(worth) + 1, capacity + 1), -np.inf)
            values[-1] = best
            for n, g in enumerate(worth):
                values[n, sizes[g] :] = best[: capacity + 1 - sizes[g]] + prices[g]
            pick = values.argmax(axis=0)
            best = values[pick, room]
            picks.append(pick)
        use = inverse @ need
        if use.sum() * (1 - 1 / max(best[capacity], 1.0)) <= CLOSE:
            break
        column, w = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[w] < len(worth):
                column[worth[pick[w]]] += 1
                w -= sizes[worth[pick[w]]]
        step = inverse @ column
        rising = step > 1e-9
        ratio = np.where(rising, np.maximum(use, 0) / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        rounds += 1
        if rounds % 100 == 0:  # against rounding errors
            inverse = np.linalg.inv(basis)
    use = np.maximum(np.linalg.solve(basis, np.array(demand, float)), 0)
    return [({g: int(round(c)) for g, c in enumerate(basis[:, j]) if c > 0.5}, int(use[j] + 1e-9)) for j in range(k)]


class Runs:
    """Runs of alike sequences, by the room left in them; a run is (count, ((length, times), ...))."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_gap: dict[int, list[tuple[int, tuple]]] = {}
        self.gaps: list[int] = []

    def put(self, count: int, held: tuple) -> None:
        if count:
            gap = self.capacity - sum(length * times for length, times in held)
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((count, held))

    def best_fit(self, length: int, n: int) -> None:
        """Puts n pieces of a length into the sequences that they leave least room in, or into new ones."""
        while n:
            at = bisect_left(self.gaps, length)
            if at == len(self.gaps):
                each = self.capacity // length
                self.put(n // each, ((length, each),))
                self.put(1 if n % each else 0, ((length, n % each),))
                return
            gap = self.gaps[at]
            runs = self.by_gap[gap]
            count, held = runs.pop()
            if not runs:
                del self.by_gap[gap]
                del self.gaps[at]
            each = gap // length
            full = min(count, n // each)
            self.put(full, (*held, (length, each)))
            n, count = n - full * each, count - full
            if n and count:  # fewer pieces than one sequence takes
                self.put(1, (*held, (length, n)))
                n, count = 0, count - 1
            self.put(count, held)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_parts: tuple[int, ...] = LARGE_PARTS) -> list[tuple[int, tuple]]:
    """Runs of sequences that hold every piece, from the number of pieces of each length."""
    return min((_plan(counts, capacity, groups, part) for part in large_parts), key=lambda runs: sum(count for count, _ in runs))


def _plan(counts: dict[int, int], capacity: int, groups: int, large_part: int) -> list[tuple[int, tuple]]:
    runs = Runs(capacity)
    runs.put(counts.get(capacity, 0), ((capacity, 1),))
    large = [(length, counts[length]) for length in sorted(counts, reverse=True) if capacity // large_part < length < capacity]
    left = {length: n for length, n in counts.items() if length <= capacity // large_part}
    if large:
        grouped = linear_groups(large, groups)
        chosen = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity)
        stacks = [g[::-1] for g in grouped]  # the longest at the end
        for config, times in sorted(chosen, key=lambda c: -c[1]):
            while times:
                # So many alike sequences as the next lengths of all its groups allow.
                alike = times
                for g, each in config.items():
                    if stacks[g]:
                        alike = min(alike, stacks[g][-1][1] // each) if stacks[g][-1][1] >= each else 1
                alike = max(alike, 1)
                if alike > 1 and any(stacks[g] and stacks[g][-1][1] < alike * each for g, each in config.items()):
                    alike = 1
                held: dict[int, int] = {}
                for g, each in config.items():
                    want = each
                    while want and stacks[g]:
                        length, n = stacks[g].pop()
                        take = min(want, n // alike) if n >= alike else 0
                        if n - take * alike:
                            stacks[g].append((length, n - take * alike))
                        if not take:
                            break
                        held[length] = held.get(length, 0) + take
                        want -= take
                if not held:
                    break
                runs.put(alike, tuple(held.items()))
                times -= alike
        for stack in stacks:
            for length, n in stack:
                left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        runs.best_fit(length, left[length])
    return [run for gap in runs.gaps for run in runs.by_gap[gap]]


def places(runs: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset) for the pieces of each length in each run."""
    out, ranked, sequence = [], {}, 0
    for count, held in runs:
        offset = 0
        for length, times in held:
            rank = ranked.get(length, 0)
            ranked[length] = rank + count * times
            out.append((length, rank, rank + count * times, sequence, times, offset))
            offset += length * times
        sequence += count
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: what ``pieces`` returns.  Adds sequence_id long and offset long to every piece."""
    rows = durable(cut.withColumn("row", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a length
    table = rows.sparkSession.createDataFrame(
        places(plan(counts, capacity)) or [(0, 0, 0, 0, 1, 0)], "at_length long, first long, end long, sequence long, times long, base long"
    )
    buckets = max(MIN_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    held = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "row"))
    ranked = dealt.withColumn("inside", inside).join(starts, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("inside") - 1)
    # The plan's size is bounded by the capacity, whatever the corpus.
    at = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    placed = ranked.join(F.broadcast(table), at)
    nth = F.col("rank") - F.col("first")
    return placed.select(
        *[F.col(c) for c in cut.columns],
        (F.col("sequence") + F.floor(nth / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("times") * F.col("length")).cast("long").alias("offset"),
    )
