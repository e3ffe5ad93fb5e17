"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the text in lower case, digits and marks made one character each,
are hashed into ``BUCKETS``. Term frequency is the share of the text's n-grams, so a whole text's class
scores are means of per-n-gram weights, whatever its length. Document frequencies come from all documents that
may be learned from, with a language, so that texts held out change no weight.
Weights are trained by follow-the-regularised-leader, coordinate by coordinate, with L1 and L2 penalties
over shuffled passes, on at most ``SAMPLE`` documents per language (smallest hash of the id); a temperature is
then fitted on a fifth of these, held back. Every language is learned, however many there are: with more than
``DOCUMENTS / SAMPLE`` of them each gives fewer documents, ``LEAST`` at least.

``und`` with score 0 if the text is null or has no letter, or nothing could be learned. Every row gives
one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.tables import chunks, id_crc

BUCKETS = 1 << 16
SAMPLE, DOCUMENTS, LEAST = 500, 100_000, 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.01
PASSES = 4
SCALE = 60.0
UNKNOWN = "und"


def _characters(text: str) -> np.ndarray:
    """Code points in lower case; anything but a letter is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = (codes < 97) | (codes > 122) & (codes < 170) | (codes > 0x2000) & (codes < 0x2070)
    return np.where(plain, np.uint32(32), codes)


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram."""
    c = _characters(text)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(7)
    one = c * np.uint32(0x165667B1)
    return np.concatenate([(x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16) for x in (one, two, three)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for rows in chunks(batch, "text"):
            for text in rows["text"].to_pylist():
                if text:
                    seen[np.flatnonzero(np.bincount(grams(text), minlength=BUCKETS))] += 1
                    total += 1
    met = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(seen[met], total))], ["bucket", "n"])


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log((1 + documents) / (1 + documents with the bucket)) + 1; at most ``BUCKETS`` rows reach the driver."""
    counts = (docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())
    seen = np.zeros(BUCKETS)
    own = counts[counts.bucket >= 0]
    seen[own.bucket.to_numpy()] = own.n.to_numpy()
    total = counts.n[counts.bucket < 0].sum()
    return np.log((1 + total) / (1 + seen)) + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in chunks(batch, "text"):
            counts = [np.unique(grams(t), return_counts=True) for t in rows["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["lang"], pa.array([c[0].astype(np.int32) for c in counts], pa.list_(pa.int32())),
                 pa.array([c[1].astype(np.int32) for c in counts], pa.list_(pa.int32()))], ["doc_id", "lang", "bucket", "n"])


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.weights = weights.astype(np.float32)  # bucket x language, times the inverse frequencies

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        found = np.zeros(len(self.languages))
        total = 0
        for i in range(0, len(text), 1 << 17):  # pieces overlap by two characters; each n-gram counts once
            own = grams(text[i:i + (1 << 17) + 2]) if i + (1 << 17) < len(text) else grams(text[i:])
            found += self.weights[own].sum(axis=0, dtype=np.float64)
            total += len(own)
        z = (SCALE * found / total + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit_rows(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, seed: int = 7) -> Model:
    """rows: (language, buckets, counts)."""
    languages = sorted({r[0] for r in rows})
    k = len(languages)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    x = [(b, SCALE * idf[b] * n / n.sum()) for _, b, n in rows]
    y = [languages.index(r[0]) for r in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    back = order[: len(rows) // 5]
    train = order[len(rows) // 5:]
    z, squares, bias, bias_squares = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k), np.zeros(k)

    def weights_at(b):
        zb, root = z[b], np.sqrt(squares[b])
        return np.where(np.abs(zb) <= L1, 0.0, -(zb - np.sign(zb) * L1) / ((BETA + root) / ALPHA + L2))

    for _ in range(PASSES):
        for i in rng.permutation(train):
            b, v = x[i]
            w = weights_at(b)
            s = v @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            new = squares[b] + g * g
            z[b] += g - (np.sqrt(new) - np.sqrt(squares[b])) / ALPHA * w
            squares[b] = new
            bias_squares += p * p
            bias -= 0.1 * p / np.sqrt(1 + bias_squares)
    w = weights_at(np.arange(BUCKETS))
    if len(back):
        scores = np.array([x[i][1] @ w[x[i][0]] + bias for i in back])
        truth = np.array([y[i] for i in back])
        grid = np.geomspace(0.05, 20, 120)
        loss = [np.mean(np.logaddexp.reduce(scores / t, axis=1) - scores[np.arange(len(back)), truth] / t) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    else:
        temperature = 1.0
    return Model(languages, w * idf[:, None], bias, temperature)


def fit(docs: DataFrame, usable: Column) -> Model:
    """``usable``: a condition on doc_id for rows whose language may be seen."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0))
    ids = known.select("doc_id", "lang")
    counts = ids.distinct().groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return fit_rows([], np.ones(BUCKETS))
    size = min(SAMPLE, max(LEAST, DOCUMENTS // languages))
    place = (F.hash("doc_id").cast("double") + 2.0 ** 31) / 2.0 ** 32
    # the least hashes of each language, twice as many as needed, so that none is sorted whole in one task
    first = (ids.join(F.broadcast(counts), "lang").where(place * F.col("n") <= 2 * size + 100)  # counts: a row per language
             .select("lang", "doc_id").distinct())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.hash("doc_id"), "doc_id"))
    some = first.withColumn("rank", rank).where(F.col("rank") <= size).select("doc_id")
    sample = (known.join(F.broadcast(some), "doc_id", "left_semi").select("doc_id", "lang", "text")
              .mapInArrow(_counted, "doc_id long, lang string, bucket array<int>, n array<int>"))
    rows = sample.orderBy("doc_id").limit(size * languages).collect()
    return fit_rows([(r["lang"], np.array(r["bucket"], np.int64), np.array(r["n"], float)) for r in rows],
                    inverse_frequencies(known))


def predict_language(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [own.predict(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                    ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(F.col(doc_id)) % 4 == 2
