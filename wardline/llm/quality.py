"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is taken from the web text without its
labels. The class prior is estimated from how often a ranker puts unlabelled text among positives: the
smallest ratio, over thresholds, of the two shares above the threshold, each with a confidence margin,
bounds the share of positives in the unlabelled text. A logistic model on standardised text statistics
and their squares then minimises the non-negative unbiased risk: when the estimated risk of the negative
class falls below zero, the step goes the other way.

Fitting uses at most ``POSITIVES`` and ``UNLABELLED`` documents, those with the smallest hash of their id.
Features are shares and means over whole texts, so the score does not depend on a text's length alone.
Null and empty texts have no words and get the score that the model gives to that. Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import by_chunk, chunks, id_crc, resident

POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.3
STEPS, RATE, DECAY, TOLERANCE, MARGIN = 1500, 0.05, 1e-3, 0.0, 2.0
FEATURES = ("letters", "capitals", "digits", "marks", "spaces", "repeated_word", "same_word", "bars", "marked_words",
            "capital_words", "mean_word", "short_words", "long_words", "sentence", "lines")


def _classes() -> np.ndarray:
    """Columns: small letter, capital, digit, full stop or comma, white space, bar, any other mark."""
    table = np.zeros((256, 7))
    for i in range(256):
        c = chr(i)
        table[i, 0 if "a" <= c <= "z" or i > 127 else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in ".,"
              else 4 if c in " \t\n\r\v\f" else 5 if c == "|" else 6] = 1
    return table


CLASSES = _classes()
MARKS = frozenset(b"!#$%&*|<>{}[]~^=+@\\")


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    small, capital, digit, stop, space, bar, mark = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES).tolist()
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = data.count(b"\n") + 1
    return [small / size, capital / (small + capital + 1), digit / size, mark / size, space / size,
            1 - len(set(words)) / n, sum(map(bytes.__eq__, words[1:], words)) / n, bar / n,
            sum(w[-1] in MARKS for w in words) / n, sum(map(bytes.isupper, words)) / n, min(float(lengths.mean()), 30) / 10,
            float((lengths <= 3).mean()), float((lengths >= 12).mean()), min((stop + 1) / n, 1), min(lines / n, 1)]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    resident(None)
    for batch in batches:
        for rows in chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [*(rows[c] for c in rows.schema.names if c != "text"),
                 pa.array([features(t) for t in rows["text"].to_pylist()], pa.list_(pa.float64()))],
                [*(c for c in rows.schema.names if c != "text"), "features"])


class Model:
    def __init__(self, mean, spread, weights, prior):
        self.mean, self.spread, self.weights, self.prior = mean, spread, weights, prior

    def _inputs(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, z * z / 6), axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(rows) @ self.weights, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the scores allow among the unlabelled."""
    cuts = np.quantile(positive, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    ratio = above_u / np.maximum(above_p, 1e-9)
    slack = MARGIN / np.sqrt(np.maximum(above_p * len(positive), 1e-9))  # shares of few rows say little
    return float(np.clip(ratio[np.argmin(ratio + slack)], 0.05, 0.99))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(inputs_p: np.ndarray, inputs_u: np.ndarray, gradient) -> np.ndarray:
    """Adam steps; ``gradient`` takes both margins and gives the derivative by each."""
    w = np.zeros(inputs_p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        by_p, by_u = gradient(inputs_p @ w, inputs_u @ w)
        g = inputs_p.T @ by_p + inputs_u.T @ by_u + DECAY * np.concatenate(([0.0], w[1:]))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w


def fit_rows(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    if not len(positive) or not len(unlabelled):  # nothing to learn from: everything is as good as anything
        n = len(FEATURES)
        return Model(np.zeros(n), np.ones(n), np.zeros(2 * n + 1), 0.5)
    both = np.concatenate((positive, unlabelled))
    model = Model(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-3), np.zeros(2 * both.shape[1] + 1), 0.5)
    p, u = model._inputs(positive), model._inputs(unlabelled)
    n, m = len(p), len(u)
    halves = [(0, 1), (1, 0)] if min(n, m) > 1 else [(0, 0)]  # a ranker sees one half, the other half is counted
    ranks = [(p[j::2] @ r, u[j::2] @ r) for i, j in halves
             for r in [_descend(p[i::2], u[i::2], lambda a, b: (-_sigmoid(-a) / len(a), _sigmoid(b) / len(b)))]]
    prior = model.prior = float(np.mean([class_prior(a, b) for a, b in ranks]))

    def gradient(a, b):  # logistic loss; log(1 + exp(x)) is that of calling x negative
        negative = np.logaddexp(0, b).mean() - prior * np.logaddexp(0, a).mean()
        if negative < TOLERANCE:
            return prior * _sigmoid(a) / n, -_sigmoid(b) / m
        return -prior * _sigmoid(-a) / n - prior * _sigmoid(a) / n, _sigmoid(b) / m

    model.weights = _descend(p, u, gradient)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """``usable``: a condition on doc_id for rows whose labels may be seen."""
    text = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    good = labels.where((F.col("quality") == 1) & usable).select("doc_id").distinct()

    def rows(ids: DataFrame, limit: int) -> np.ndarray:
        some = F.broadcast(ids.orderBy(F.hash("doc_id"), "doc_id").limit(limit))  # at most ``limit`` ids
        found = (text.join(some, "doc_id", "left_semi")
                 .mapInArrow(_featured, "doc_id long, features array<double>").orderBy("doc_id").limit(limit))
        return np.array([r["features"] for r in found.select("features").collect()]).reshape(-1, len(FEATURES))

    return fit_rows(rows(good, POSITIVES), rows(text.where(usable).select("doc_id"), UNLABELLED))


def quality_score(text: Column, model: Model) -> Column:
    """The score of a text: 0 to 1, higher is better."""
    def run(texts: pa.Array) -> np.ndarray:
        return model.score(np.array([features(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES)))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        resident(None)
        for texts in batches:
            yield pa.array(by_chunk(run, texts))

    return score(text)


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1: good)."""
    return (docs.select(F.col(doc_id).alias("doc_id"), quality_score(F.col(text), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with all their columns."""
    return docs.where(quality_score(F.col("text"), model) >= threshold)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(F.col(doc_id)) % 5 == 0
