"""Toxicity: gradient-boosted trees over dense features (operator 5).

Features of a text: densities of a lexicon (whole words and word beginnings) that is learned from
labelled rows by log odds, how near its hits stand to words of the second person, shares of capitals and
punctuation, and rates of obfuscated spellings.  Trees are grown on histograms of a bounded sample of
labelled rows, and an isotonic fit on labelled rows that neither they nor the lexicon have seen turns
scores into chances.

Defined cases: null and empty texts are scored as texts without words; rows without a label are only
scored; without labels of both kinds every score is 0; repeated rows get equal scores; an empty table
gives an empty result; other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm import features
from quernel.llm.common import durable, held_out_column

#: Second-person words of the corpus's languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihnen tú ti tus usted ustedes vosotros vuestro".split())  # noqa: SIM905
#: Characters written for letters, and the letters (fixed values).
WRITTEN_FOR = str.maketrans("013457@$!", "oieastasi")
NEAR_WORDS = 5
#: Lengths of word beginnings in the lexicon; 0 stands for whole words.
BEGINNINGS = (0, 4, 5, 6)
#: Smallest log odds of a term, and the least share (and number) of toxic rows that have it.  The share bounds the lexicon:
#: it has at most 1 / MIN_SHARE times as many terms as a toxic row of the sample has on average.
MIN_ODDS, MIN_SHARE, MIN_ROWS = 4.0, 0.01, 4
TREES, DEPTH, RATE, BINS, LEAF_ROWS, SHRINK = 60, 3, 0.2, 32, 10, 1.0
CALIBRATE_EACH = 4
PREDICT = 0.5

WORD = re.compile(r"[^\W_]+")
MASKED = re.compile(r"[^\W\d_]+(?:[*@$#!0-9]+[^\W\d_]+)+")
SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
MASK = re.compile(r"[*@$#!0-9](?=[^\W\d_])")
STRETCHED = re.compile(r"([^\W\d_])\1\1+")
NAMES = (
    "hits_word", "hits_4", "hits_5", "hits_6", "odds_sum", "odds_max", "rate_hits", "distinct_hits", "masked_hits", "second_person", "near_second",
    "capitals", "shout", "ask", "symbols", "masked", "spelled", "stretched", "log_words",
)


@dataclass
class Lexicon:
    """Log odds of terms, by kind (see BEGINNINGS)."""

    odds: dict[int, dict[str, float]]

    def of(self, word: str) -> float:
        return max([t[word[:k] if k else word] for k, t in self.odds.items() if (word[:k] if k else word) in t], default=0.0)

    def vector(self, text: str) -> list[float]:
        lowered = text.lower()
        listed = WORD.findall(lowered)
        words = Counter(listed)
        n = max(len(listed), 1)
        by_kind, hits = [], {}
        for k, terms in self.odds.items():
            found = [w for w in words if w[:k] in terms] if k else list(words.keys() & terms.keys())
            by_kind.append(sum(words[w] for w in found))
            for w in found:
                hits[w] = max(hits.get(w, 0.0), terms[w[:k] if k else w])
        masked = MASKED.findall(lowered) if MASK.search(lowered) else []
        masked_hits = sum(1 for w in masked if self.of(w.translate(WRITTEN_FOR)) or self.of("".join(filter(str.isalpha, w))))
        # A word that is spelled out leaves single letters.
        spelled = SPELLED.findall(lowered) if sum(words[w] for w in words if len(w) == 1) >= 4 else []
        masked_hits += sum(1 for w in spelled if self.of("".join(filter(str.isalpha, w))))
        second = sum(words[w] for w in words.keys() & SECOND_PERSON)
        near = 0
        if hits and second:
            at = [k for k, w in enumerate(listed) if w in SECOND_PERSON]
            for k, w in enumerate(listed):
                if w in hits:
                    j = bisect_left(at, k - NEAR_WORDS)
                    near += j < len(at) and at[j] <= k + NEAR_WORDS
        total = sum(o * words[w] for w, o in hits.items())
        count = sum(words[w] for w in hits)
        chars = max(len(text), 1)
        return [
            *[h / n for h in by_kind], total / n, max(hits.values(), default=0.0), count / n, len(hits) / n, masked_hits / n, second / n, near / n,
            sum(map(str.isupper, text.split())) / n, text.count("!") / chars, text.count("?") / chars, sum(map(text.count, "*@$#%&")) / chars,
            len(masked) / n, len(spelled) / n, len(STRETCHED.findall(lowered)) / n, float(np.log1p(n)),
        ]


def _terms(words: F.Column, length: int) -> F.Column:
    """The distinct words, or their distinct beginnings of some length, with that length."""
    cut = F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, length))) if length else words
    return F.transform(cut, lambda w: F.struct(F.lit(length).alias("k"), w.alias("term")))


def calibrates() -> F.Column:
    """Whether a labelled row is for calibration; such rows teach neither the lexicon nor the trees."""
    return F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(CALIBRATE_EACH)) == 0


def learn_lexicon(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """train: id, y of a bounded sample.  A bounded number of terms comes to the driver."""
    labelled = df.select(df[id_col].alias("id"), F.lower(F.coalesce(df[text_col].cast("string"), F.lit(""))).alias("t")).join(F.broadcast(train), "id")
    words = F.array_distinct(F.split("t", r"[^\p{L}\p{N}]+"))
    labelled = labelled.select("y", words.alias("words"))
    totals = labelled.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count(F.lit(1))).first()
    toxic, clean = float(totals[0]), float(totals[1] - totals[0])
    odds: dict[int, dict[str, float]] = {k: {} for k in BEGINNINGS}
    if not toxic or not clean:
        return Lexicon(odds)
    kinds = [_terms(F.col("words"), k) for k in BEGINNINGS]
    terms = labelled.select("y", F.explode(F.concat(*kinds)).alias("x")).select("y", "x.k", "x.term").where("length(term) >= greatest(k, 2)")
    counted = terms.groupBy("k", "term").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("rows"))
    counted = counted.where(F.col("toxic") >= max(MIN_ROWS, MIN_SHARE * toxic))
    value = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("rows") - F.col("toxic") + 0.5) / (clean + 1))
    for r in counted.withColumn("odds", value).where(F.col("odds") >= MIN_ODDS).collect():
        odds[r.k][r.term] = r.odds
    return Lexicon(odds)


@dataclass
class Tree:
    """A tree of fixed depth: the feature and cut of each inner node, the value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.feature[at]] > self.cut[at])
        return self.leaf[at - (2**DEPTH - 1)]


@dataclass
class Model:
    base: float
    trees: list[Tree]
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + RATE * sum((t.values(x) for t in self.trees), np.zeros(len(x)))


def _edges(column: np.ndarray) -> np.ndarray:
    """Up to BINS - 1 cuts: quantiles, and those of the values that aren't the most common one."""
    common = np.unique(column)
    if len(common) <= BINS:
        return (common[1:] + common[:-1]) / 2
    rare = column[column != np.median(column)]
    return np.unique(np.concatenate([np.quantile(column, np.linspace(0, 1, BINS // 2 + 1)[1:-1]), np.quantile(rare, np.linspace(0, 1, BINS // 2 + 1)[1:-1])]))


def grow(codes: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    inner = 2**DEPTH - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(codes), np.int64)
    for depth in range(DEPTH):
        first, nodes = 2**depth - 1, 2**depth
        local = at - first
        gain, choice = np.full(nodes, 1e-9), np.full((nodes, 2), -1)
        sums = [np.bincount(local, w, nodes) for w in (gradient, hessian)]
        whole = sums[0] ** 2 / (sums[1] + SHRINK)
        for f in range(codes.shape[1]):
            if not len(edges[f]):
                continue
            key = local * BINS + codes[:, f]
            g, h, n = (np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (gradient, hessian, None))
            right = [s[:, None] - x for s, x in zip([sums[0], sums[1], n[:, -1]], [g, h, n], strict=True)]
            gains = g**2 / (h + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - whole[:, None]
            gains[(n < LEAF_ROWS) | (right[2] < LEAF_ROWS)] = -np.inf
            best = gains.argmax(axis=1)
            better = gains[np.arange(nodes), best] > gain
            gain[better], choice[better, 0], choice[better, 1] = gains[np.arange(nodes), best][better], f, best[better]
        for k in range(nodes):
            if choice[k, 0] >= 0:
                feature[first + k], cut[first + k] = choice[k, 0], edges[choice[k, 0]][choice[k, 1]]
        goes = np.zeros(len(codes), np.int64)
        known = choice[local, 0] >= 0
        goes[known] = codes[known, choice[local[known], 0]] > choice[local[known], 1]
        at = 2 * at + 1 + goes
    leaves = at - inner
    g, h = (np.bincount(leaves, w, 2**DEPTH) for w in (gradient, hessian))
    return Tree(feature, cut, g / (h + SHRINK))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Model | None:
    """Logistic boosting on the rows that aren't for calibration; None if they don't have both labels."""
    a, b = x[~calibrate], y[~calibrate]
    if not len(b) or not 0 < b.mean() < 1:
        return None
    edges = [_edges(a[:, f])[: BINS - 1] for f in range(a.shape[1])]
    codes = np.stack([np.searchsorted(e, a[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    model = Model(float(np.log(b.mean() / (1 - b.mean()))), [], (np.zeros(1), np.zeros(1)))
    raw = np.full(len(b), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        model.trees.append(grow(codes, edges, b - p, p * (1 - p)))
        raw += RATE * model.trees[-1].values(a)
    model.knots = features.isotonic(model.raw(x[calibrate]), y[calibrate])
    return model


def learn(vectors: DataFrame, train: DataFrame) -> Model | None:
    """vectors: id, x of the labelled rows at least; train: id, y of a bounded sample."""
    # One row an id, so that repeated rows don't outgrow the sample.
    sample = vectors.join(F.broadcast(train), "id").dropDuplicates(["id"]).withColumn("calibrate", calibrates())
    rows = sample.select("x", "y", "calibrate").toArrow()  # bounded by the sample
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)).astype(np.float64) if len(rows) else np.zeros((0, len(NAMES)))
    return fit(x, rows["y"].to_numpy(), rows["calibrate"].to_numpy(zero_copy_only=False).astype(bool))


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = features.MAX_LABELLED) -> DataFrame:
    """id_col, held_out, score, predicted for every row."""
    train = features.training_labels(df, labels, "toxic", id_col, text_col, most)
    lexicon = learn_lexicon(df, train.where(~calibrates()), id_col, text_col)
    vectors = durable(features.with_vector(df, lexicon.vector, len(NAMES), id_col, text_col))
    model = learn(vectors, train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.zeros(len(b))
            if model and len(b):
                made = features.calibrated(model.raw(b.column(1).flatten().to_numpy().reshape(len(b), -1).astype(np.float64)), model.knots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.float64())], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = vectors.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out_column(F.col("id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))


def keep(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = features.MAX_LABELLED) -> DataFrame:
    """The rows that are predicted 0, each by its own text, with all their columns."""
    train = features.training_labels(df, labels, "toxic", id_col, text_col, most)
    lexicon = learn_lexicon(df, train.where(~calibrates()), id_col, text_col)
    named = df.join(F.broadcast(train.select(F.col("id").alias("__id"))), df[id_col] == F.col("__id"), "left_semi")  # bounded by ``most``
    model = learn(features.with_vector(named, lexicon.vector, len(NAMES), id_col, text_col), train)

    def clean(part: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        made = features.calibrated(model.raw(x.astype(np.float64)), model.knots) if model else np.zeros(len(x))
        return part.filter(pa.array(made < PREDICT))

    return features.map_vectors(df, text_col, lexicon.vector, len(NAMES), clean, df.schema)
