"""Document statistics for the classifiers, and the labels they may learn from.

One pass over the texts gives a short vector for each; everything after works on those vectors.  Only the
text is read: ids, sources, languages and labels are never inputs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import durable, held_out_column

#: Labelled rows that a classifier is fitted on at most; a hash of the id chooses them.
MAX_LABELLED = 40_000

CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "shout", "ask", "bar", "symbol", "quote", "wide", "other")
STATISTICS = (
    "log_chars", "log_words", "lower", "upper", "digit", "space", "newline", "stop", "comma", "shout", "ask", "bar", "symbol", "quote", "wide", "other",
    "word_mean", "word_spread", "distinct_words", "repeat_neighbour", "distinct_pairs", "longest_share", "line_mean", "repeated_lines", "upper_words", "capital_words", "marked_words", "digit_words", "one_letter",
)


def _classes() -> np.ndarray:
    """The class of each code point of the basic plane; those beyond it are other."""
    kind = {c: k for k, c in enumerate(CLASSES)}
    special = {"\n": "newline", ".": "stop", ",": "comma", "!": "shout", "?": "ask", "|": "bar", '"': "quote", "'": "quote", ";": "comma", ":": "comma"}
    out = np.full(65536, kind["other"], np.uint8)
    for p in range(65536):
        c = chr(p)
        general = unicodedata.category(c)
        name = special.get(c) or (
            "upper" if general == "Lu" else "lower" if general == "Ll" else "wide" if general[0] == "L" else "digit" if general[0] == "N"
            else "space" if general[0] == "Z" or c in "\t\r\x0b\x0c" else "symbol" if general[0] in "SP" else "other"
        )
        out[p] = kind[name]
    return out


_table: list[np.ndarray] = []


def statistics(text: str) -> list[float]:
    """The values of STATISTICS; all finite, also for an empty text."""
    if not _table:
        _table.append(_classes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_table[0][np.minimum(points, 65535)], minlength=len(CLASSES)).astype(float)
    n, letters = max(len(points), 1), max(counts[0] + counts[1] + counts[12], 1)
    shares = counts / n
    shares[1] = counts[1] / letters
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    distinct = len(set(words))
    pairs = len(set(pairwise(words)))
    again = sum(a == b for a, b in pairwise(words))
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(points)), np.log1p(len(words)), *shares,
        lengths.mean(), lengths.std(), distinct / m, again / m, pairs / max(m - 1, 1), lengths.max() / n, np.log1p(n / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), sum(map(str.isupper, words)) / m, sum(map(str.istitle, words)) / m,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?\"')" for w in words) / m, sum(w[0].isdigit() for w in words) / m, sum(len(w) == 1 for w in words) / m,
    ]


def map_vectors(df: DataFrame, text_col: str, make, size: int, then, schema) -> DataFrame:
    """``then(part, x)`` of parts of the rows, with x float32 the vectors ``make(text)`` of a part; null texts count as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 1000):
                part = b.slice(start, 1000)
                yield then(part, np.array([make(t.as_py() or "") for t in part.column(at).cast(pa.string())], np.float32).reshape(-1, size))

    return df.mapInArrow(run, schema)


def with_vector(df: DataFrame, make, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x array<float>: ``make(text)`` for every row; null texts count as empty."""
    kind = df.schema[id_col].dataType.simpleString()

    def then(part: pa.RecordBatch, values: np.ndarray) -> pa.RecordBatch:
        x = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, size), pa.int32()), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([part.column(0), x], names=["id", "x"])

    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return map_vectors(rows, "text", make, size, then, f"id {kind}, x array<float>")


def training_labels(df: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """id, y double of at most about ``most`` labelled ids of ``df`` outside the held-out fold.

    Several labels of one id count as their largest; an id with several texts is left out, as its label can't be told to be of one of them.
    """
    usable = labels.select(labels["doc_id"].alias("id"), labels[target].cast("double").alias("y")).where("id is not null and y in (0.0, 1.0)")
    usable = usable.where(~held_out_column(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    # Rows of an id are combined before they are shuffled.
    texts = df.select(df[id_col].alias("id"), F.xxhash64(F.coalesce(df[text_col].cast("string"), F.lit(""))).alias("text")).where("id is not null")
    of_one_text = texts.groupBy("id").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a = b")
    usable = durable(usable.join(of_one_text, "id", "left_semi"))
    there = usable.count()
    if there > most:
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / there))
    return usable


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising step function (pool adjacent violators), to be joined by straight lines: (score, chance)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, v in zip(scores[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][2] += s2
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    return np.array([s / n for _, n, s in blocks]), np.array([v / n for v, n, _ in blocks])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Chances between 0 and 1 that keep the order of the raw scores, also where the steps are flat or end."""
    base = np.interp(raw, *knots)
    return np.clip(0.998 * base + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)
