"""Nearest neighbours with vantage-point trees (operator 6).

An outer vantage-point tree over a bounded sample cuts the space into at most ``MAX_CELLS`` cells; every row
goes down it into its cell, and what the triangle inequality needs (least and largest distance to each
vantage point on the way) is taken from all rows.  A cell's rows are one shard with a vantage-point tree, or
several, dealt by a hash, where a cell is overfull.

A query is searched in its own cell first.  The distance of its k-th neighbour there, divided by ``factor``,
is the bound with which it goes on, only to the cells that the triangle inequality allows, and inside a tree
only into such children: factor one gives the exact neighbours, more skips more.  Queries of a cell travel in
blocks, each of which meets the cell's shards in an equi-join; a tree is sent to the blocks of its own cell's
queries and to no others.  Where distances have no structure, as between random directions of many
dimensions, the bound excludes little, and an exact search then compares each query with almost every row.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no part,
neither as queries nor as candidates; vectors are compared with those of the same length only; ties go to
the smaller id; rows with the query's own id are not its neighbours; every other row is a candidate, so
rows repeated with one id take a place each; queries repeated with one id and vector are one query, and
different vectors of one query id are queries of their own, each with its own ranks; with fewer candidates
than k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernel.llm.common import durable, small

#: Rows of a shard; a cell with twice as many is several shards.
SHARD_ROWS = 8192
QUERY_ROWS = 4096
LEAF = 64
#: Bounds of the outer trees, of all vector lengths together: cells, bytes of vantage points, sampled rows for each cell.
MAX_CELLS, MAX_OUTER_BYTES, SAMPLE_EACH = 4096, 32_000_000, 8
#: Vector lengths that may have an outer tree; rows of others are one cell each.
MAX_LENGTHS = 100
#: Queries that go down a tree together.
TOGETHER = 256
#: Lower bounds are taken this much smaller, against rounding.
SAFE = 1 - 1e-9


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id long, dim int, v array<double> of the rows that take part."""
    v = df[vec_col].cast("array<double>")
    rows = df.select(df[id_col].cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0)).select("id", F.size("v").alias("dim"), "v")


def _to(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - point) ** 2).sum(axis=-1))


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> dict:
    """A vantage-point tree: rows in tree order; for each node its range of rows and, if it isn't a leaf, its children and the range of their distances to its first row."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    place = np.arange(len(ids))
    nodes: list[list] = []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([a, b, -1, -1, 0.0, 0.0, 0.0, 0.0])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if b - a <= max(leaf, 2):
            continue
        d = _to(vectors[place[a + 1 : b]], vectors[place[a]])
        half = (b - a - 1) // 2
        by = np.argpartition(d, half)
        place[a + 1 : b] = place[a + 1 : b][by]
        near, far = d[by[:half]], d[by[half:]]
        nodes[me][4:] = [near.min(), near.max(), far.min(), far.max()]
        todo += [(a + 1, a + 1 + half, me, 0), (a + 1 + half, b, me, 1)]
    return {"ids": ids[place], "vectors": vectors[place], "nodes": nodes}


class Search:
    """The k nearest of some queries in one tree, of those within each query's bound."""

    def __init__(self, tree: dict, k: int, factor: float):
        self.tree, self.k, self.factor = tree, k, factor

    def run(self, ids: np.ndarray, queries: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        self.own, self.q = ids, queries
        self.bound = np.full(len(ids), np.inf) if bound is None else bound
        self.d = np.full((len(ids), self.k), np.inf)
        self.i = np.full((len(ids), self.k), np.iinfo(np.int64).max)
        if len(self.tree["ids"]):
            self._node(0, np.arange(len(ids)))
        return self.d, self.i

    def _most(self, who: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[who, -1], self.bound[who])

    def _meet(self, who: np.ndarray, a: int, b: int) -> np.ndarray:
        """Offers rows a to b to the queries; returns the distances to row a."""
        d = _to(self.q[who][:, None, :], self.tree["vectors"][None, a:b])
        first = d[:, 0].copy()
        names = np.broadcast_to(self.tree["ids"][a:b], d.shape)
        d[(names == self.own[who][:, None]) | (d > self.bound[who][:, None])] = np.inf
        some = (np.isfinite(d) & (d <= self.d[who, -1:])).any(axis=1)
        w = who[some]
        if len(w):
            both_d, both_i = np.hstack([self.d[w], d[some]]), np.hstack([self.i[w], names[some]])
            best = np.lexsort((both_i, both_d), axis=1)[:, : self.k]
            self.d[w], self.i[w] = np.take_along_axis(both_d, best, 1), np.take_along_axis(both_i, best, 1)
        return first

    def _node(self, k: int, who: np.ndarray) -> None:
        a, b, near, far, near_min, near_max, far_min, far_max = self.tree["nodes"][k]
        if near < 0:
            self._meet(who, a, b)
            return
        d = self._meet(who, a, a + 1)
        inside = d <= (near_max + far_min) / 2
        for first in (True, False):  # each query's own side first, then the other if it may hold nearer points
            for child, low, high, mine in ((near, near_min, near_max, inside), (far, far_min, far_max, ~inside)):
                least = np.maximum(np.maximum(low - d, d - high), 0)
                goes = (mine if first else ~mine) & ~(least * SAFE > self._most(who) / self.factor)
                if goes.any():
                    self._node(child, who[goes])


class Cells:
    """The outer tree of one vector length: vantage points, and for each node the range of its rows' distances to its parent's point."""

    def __init__(self, vectors: np.ndarray, cells: int):
        tree = build(np.arange(len(vectors)), vectors, max(2, -(-len(vectors) // cells)))
        self.nodes = [(n[2], n[3], (n[5] + n[6]) / 2) for n in tree["nodes"]]  # near, far, the distance that parts them
        self.points = {k: tree["vectors"][n[0]] for k, n in enumerate(tree["nodes"]) if n[2] >= 0}
        self.low, self.high = np.full(len(self.nodes), np.inf), np.full(len(self.nodes), -np.inf)

    def path(self, cell: int) -> list[int]:
        """Nodes from below the root to a leaf."""
        if not hasattr(self, "above"):
            self.above = {child: k for k, n in enumerate(self.nodes) for child in n[:2] if child >= 0}
        out = []
        while cell:
            out.append(cell)
            cell = self.above[cell]
        return out[::-1]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """Each row's leaf, and its distances to the vantage points above it, outermost first."""
        leaf, seen = np.zeros(len(vectors), np.int64), [[] for _ in range(len(vectors))]
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            k, who = todo.pop()
            near, far, parts = self.nodes[k]
            leaf[who] = k
            if near < 0 or not len(who):
                continue
            d = _to(vectors[who], self.points[k])
            for w, x in zip(who.tolist(), d.tolist(), strict=True):
                seen[w].append(x)
            todo += [(near, who[d <= parts]), (far, who[d > parts])]
        return leaf, seen

    def learn(self, cell: int, low: list[float], high: list[float]) -> None:
        for k, a, b in zip(self.path(cell), low, high, strict=True):
            self.low[k], self.high[k] = min(self.low[k], a), max(self.high[k], b)

    def allowed(self, queries: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) of the leaves that may hold rows within a query's bound."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            k, who = todo.pop()
            near, far, _ = self.nodes[k]
            if near < 0:
                yield k, who
                continue
            d = _to(queries[who], self.points[k])
            for child in (near, far):
                if self.low[child] <= self.high[child]:  # else no row is there
                    least = np.maximum(np.maximum(self.low[child] - d, d - self.high[child]), 0)
                    goes = ~(least * SAFE > bound[who])
                    if goes.any():
                        todo.append((child, who[goes]))


@dataclass
class Index:
    """trees: dim, cell, shard, tree binary.  cells: the outer trees by vector length."""

    trees: DataFrame
    cells: dict[int, Cells]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _by_dim(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) for each length of vectors in a batch."""
    vectors = _vectors(column)
    lengths = np.array([len(v) for v in vectors], np.int64)
    for dim in np.unique(lengths).tolist():
        who = np.flatnonzero(lengths == dim)
        yield dim, who, np.stack([vectors[k] for k in who])


def _outer(rows: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """Outer trees of the commonest vector lengths, from a bounded sample."""
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard_rows).orderBy(F.desc("n"), "dim").limit(MAX_LENGTHS).collect()
    total = sum(r.n for r in counts)
    want = {r.dim: min(-(-r.n // shard_rows), MAX_CELLS * r.n // total, MAX_OUTER_BYTES * r.n // total // (8 * r.dim)) for r in counts}
    want = {dim: cells for dim, cells in want.items() if cells > 1}
    if not want:
        return {}
    # Twice the rate that is wanted, then cut to the bound by a hash's order.
    rate = F.coalesce(*[F.when(F.col("dim") == r.dim, F.lit(2.0 * SAMPLE_EACH * want[r.dim] / r.n)) for r in counts if r.dim in want], F.lit(0.0))
    draw = F.xxhash64("row", F.lit("sample"))
    drawn = rows.where(draw / F.lit(2.0**64) + 0.5 < rate).select("dim", draw.alias("draw"), "v")
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy("draw")))
    drawn = drawn.where(F.coalesce(*[F.when(F.col("dim") == dim, F.col("nth") <= SAMPLE_EACH * cells) for dim, cells in want.items()])).select("dim", "v").toArrow()
    found: dict[int, list] = {}
    for dim, v in zip(drawn["dim"].to_pylist(), drawn["v"].to_pylist(), strict=True):
        found.setdefault(dim, []).append(v)
    return {dim: Cells(np.array(sorted(v)), want[dim]) for dim, v in found.items() if len(v) > 2}


def _placed(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """Adds cell, and the distances to the vantage points above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, seen = np.zeros(len(b), np.int64), [[] for _ in range(len(b))]
            for dim, who, vectors in _by_dim(b.column(b.schema.get_field_index("v"))):
                if dim in cells:
                    leaf[who], mine = cells[dim].assign(vectors)
                    for w, x in zip(who.tolist(), mine, strict=True):
                        seen[w] = x
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(seen, pa.list_(pa.float64()))], names=[*b.schema.names, "cell", "seen"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell long, seen array<double>")


def index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> Index:
    """Every usable row is in the tree of one shard."""
    rows = durable(usable(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()))
    cells = _outer(rows, shard_rows)
    placed = durable(_placed(rows, cells))
    held = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * shard_rows)
    overfull = durable(held.select("dim", "cell", F.ceil(F.col("n") / shard_rows).alias("shards")))
    dealt = placed.join(small(overfull, overfull.count()), ["dim", "cell"], "left")
    dealt = dealt.withColumn("shard", F.coalesce(F.pmod(F.xxhash64("row"), F.col("shards")), F.lit(0)))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        tree = build(part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64))
        seen = np.stack(part["seen"].to_numpy())
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "cell": part["cell"].iloc[:1], "shard": part["shard"].iloc[:1], "tree": [pickle.dumps(tree)], "low": [seen.min(axis=0)], "high": [seen.max(axis=0)]})

    made = dealt.select("dim", "cell", "shard", "id", "v", "seen").groupBy("dim", "cell", "shard")
    trees = durable(made.applyInPandas(make, "dim int, cell long, shard long, tree binary, low array<double>, high array<double>"))
    ranges = trees.where("size(low) > 0").groupBy("dim", "cell", F.size("low").alias("n")).agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    # One row for each cell with an outer tree; of a cell's shards only the least and the largest.
    least = ranges.select("dim", "cell", F.expr("transform(sequence(0, n - 1), k -> array_min(transform(low, x -> x[k])))").alias("low"), F.expr("transform(sequence(0, n - 1), k -> array_max(transform(high, x -> x[k])))").alias("high"))
    for r in least.collect() if cells else []:
        cells[r.dim].learn(r.cell, r.low, r.high)
    return Index(trees.drop("low", "high"), cells)


def _search(trees: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """asked: dim, cell, row, id, v, bound.  query, query_id, vec_id, score of the k nearest in each shard of the cell within the bound."""
    held = asked.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = held.select("dim", "cell", F.ceil(F.col("n") / QUERY_ROWS).alias("blocks")).where("blocks > 1")
    blocks = durable(blocks)
    dealt = asked.join(small(blocks, blocks.count()), ["dim", "cell"], "left")
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("row"), F.col("blocks")), F.lit(0))).select("dim", "cell", "block", "row", "id", "v", "bound")

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        block = (part["row"].to_numpy(np.int64), part["id"].to_numpy(np.int64), np.stack(part["v"].to_numpy()).astype(np.float64), part["bound"].to_numpy(np.float64))
        return pd.DataFrame({"dim": part["dim"].iloc[:1], "cell": part["cell"].iloc[:1], "block": part["block"].iloc[:1], "queries": [pickle.dumps(block)]})

    gathered = durable(dealt.groupBy("dim", "cell", "block").applyInPandas(gather, "dim int, cell long, block long, queries binary"))
    # Dealt by the shard and the block, not by the cell alone: a cell with many shards or blocks is many tasks' work.
    work = gathered.join(trees, ["dim", "cell"]).select("queries", "tree", F.xxhash64("dim", "cell", "block", "shard").alias("pair"))
    work = work.repartition(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(len(b)):
                rows, ids, vectors, bound = pickle.loads(b.column(0)[row].as_py())
                tree = pickle.loads(b.column(1)[row].as_py())
                for start in range(0, len(ids), TOGETHER):
                    part = slice(start, start + TOGETHER)
                    d, i = Search(tree, k, factor).run(ids[part], vectors[part], bound[part])
                    real = np.isfinite(d)
                    asking = [np.repeat(x[part], k).reshape(d.shape)[real] for x in (rows, ids)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, asking), pa.array(i[real]), pa.array(d[real])], names=["query", "query_id", "vec_id", "score"])

    return work.select("queries", "tree").mapInArrow(run, "query long, query_id long, vec_id long, score double")


def search(found: Index, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of every usable query."""
    cells = found.cells
    asked = usable(queries, id_col, vec_col).distinct().withColumn("row", F.monotonically_increasing_id())
    asked = durable(_placed(durable(asked), cells).drop("seen"))
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    near = durable(_search(found.trees, asked.withColumn("bound", F.lit(float("inf"))), k, factor))
    if cells:
        near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        last = near.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("bound"))
        onward = asked.join(last, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own, bound = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("cell", "bound"))
                for dim, who, vectors in _by_dim(b.column(b.schema.get_field_index("v"))):
                    if dim in cells:
                        for cell, some in cells[dim].allowed(vectors, bound[who] / factor):
                            others = who[some][own[who[some]] != cell]
                            if len(others):
                                part = b.take(pa.array(others))
                                yield part.set_column(part.schema.get_field_index("cell"), "cell", pa.array(np.full(len(others), cell)))

        further = onward.select("row", "id", "dim", "v", "cell", "bound").mapInArrow(route, "row long, id long, dim int, v array<double>, cell long, bound double")
        near = near.drop("rank").unionByName(_search(found.trees, durable(further), k, factor))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
