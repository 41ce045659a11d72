"""Quality classifier: random Fourier features and ridge regression (operator 4).

Random Fourier features approximate a Gaussian kernel over the statistics of a text.  Each partition of
the labelled rows returns the sums of its normal equations, which are added up and solved for the ridge
weights; an isotonic fit on labelled rows that the weights have not seen turns scores into chances.

Defined cases: null and empty texts are scored as texts without words; rows without a label are only
scored; without labels of both kinds every score is 0.5; repeated rows get equal scores; an empty table
gives an empty result; other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import features
from quernel.llm.common import durable, held_out_column

FOURIER = 384
RIDGE = 1e-3
SEED = 20_240_501
#: Every so many labelled rows one is for calibration; the others are for the weights.
CALIBRATE_EACH = 4
PREDICT = 0.3
#: Tasks that sum normal equations over the sample; each returns one matrix.
SUMMING_TASKS = 12


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ self.waves + self.phases), z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _sums(rows: DataFrame, of) -> list[np.ndarray]:
    """Adds up, over the partitions, the arrays that ``of(x, y)`` gives for a batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                made = of(_matrix(b.column(0)), b.column(1).to_numpy())
                total = made if total is None else [s + m for s, m in zip(total, made, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[m.tobytes() for m in total]], pa.list_(pa.binary()))], names=["sums"])

    out: list[np.ndarray] = []
    for r in rows.select("x", "y").mapInArrow(run, "sums array<binary>").toLocalIterator():
        got = [np.frombuffer(s) for s in r.sums]
        out = got if not out else [a + b for a, b in zip(out, got, strict=True)]
    return out


def fit(rows: DataFrame, fourier: int = FOURIER) -> Model | None:
    """rows: id, x, y of a bounded sample.  None if it doesn't have both labels."""
    rows = durable(rows.withColumn("calibrate", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATE_EACH)) == 0).repartition(SUMMING_TASKS, "id"))
    learn = rows.where("not calibrate")
    moments = _sums(learn, lambda x, y: [np.array([len(x), y.sum()]), x.sum(axis=0), (x * x).sum(axis=0)])
    if not moments or not 0 < moments[0][1] < moments[0][0]:
        return None
    n, size = moments[0][0], len(moments[1])
    mean = moments[1] / n
    scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 1e-12)) + 1e-6
    random = np.random.default_rng(SEED)
    # The kernel's width follows the number of statistics, as distances between standardised vectors do.
    waves = random.normal(size=(size, fourier)) / np.sqrt(size)
    model = Model(mean, scale, waves, random.uniform(0, 2 * np.pi, fourier), np.zeros(0), (np.zeros(1), np.zeros(1)))

    def normal(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.fourier(x)
        return [z.T @ z, z.T @ y]

    square, side = _sums(learn, normal)
    square = square.reshape(len(side), len(side))
    model.weights = np.linalg.solve(square + RIDGE * n * np.diag([*[1.0] * fourier, *[0.01] * size, 0]) + 1e-9 * np.eye(len(side)), side)
    held = rows.where("calibrate").select("x", "y").toArrow()  # a bounded sample
    x, y = _matrix(held["x"].combine_chunks()) if len(held) else np.zeros((0, size)), held["y"].to_numpy()
    model.knots = features.isotonic(model.raw(x), y)
    return model


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = features.MAX_LABELLED) -> DataFrame:
    """id_col, held_out, score, predicted for every row."""
    vectors = durable(features.with_vector(df, features.statistics, len(features.STATISTICS), id_col, text_col))
    train = features.training_labels(df, labels, "quality", id_col, text_col, most)
    model = fit(vectors.join(F.broadcast(train), "id").dropDuplicates(["id"]))  # bounded by ``most``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = features.calibrated(model.raw(_matrix(b.column(1))), model.knots) if model and len(b) else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.float64())], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = vectors.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out_column(F.col("id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = features.MAX_LABELLED) -> DataFrame:
    """The rows that are predicted 1, each by its own text, with all their columns."""
    train = features.training_labels(df, labels, "quality", id_col, text_col, most)
    named = df.join(F.broadcast(train.select(F.col("id").alias("__id"))), df[id_col] == F.col("__id"), "left_semi")  # bounded by ``most``
    vectors = features.with_vector(named, features.statistics, len(features.STATISTICS), id_col, text_col)
    model = fit(vectors.join(F.broadcast(train), "id").dropDuplicates(["id"]))

    def good(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        made = features.calibrated(model.raw(x.astype(np.float64)), model.knots) if model else np.full(len(x), 0.5)
        return part.filter(pa.array(made >= PREDICT))

    return features.map_vectors(df, text_col, features.statistics, len(features.STATISTICS), good, df.schema)
