"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share within ``SPAN`` characters, each
weighing ``DECAY`` for every character it skips, normalised by the weights of a word's own subsequences.
Letters of all scripts are told apart; subsequences of code points are hashed into ``BUCKETS``. Characters
that are no letters, of whatever block, only widen gaps, digits that imitate letters count as these, and runs
of single characters between spaces are read as one word; so gapped insults and insults with inserted
characters stay near the plain ones.

Positive examples are telling words: their share of the toxic documents is ``ODDS`` times that of the clean
ones or more, and an exact test of the two counts of documents (Fisher, one-sided) finds them with a share of
``FALSE_SHARE`` false ones at most (Benjamini and Hochberg, over the words that are in enough documents for
the test to succeed at all, as by Tarone). Documents that hold a word in the same passage count once. Other
words of these documents are the negative examples. The machine (squared hinge, Newton steps) is linear in
the Nyström features of ``LANDMARKS`` words, so its decision folds into one weight per subsequence. A text's
decision is that of its strongest word, and a logistic curve makes it a score.

Fitting sees at most ``TOXIC`` and ``CLEAN`` documents (smallest hash of the id); scoring reads whole texts.
Null and empty texts have no word and the lowest score. Every row gives one row.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from math import exp, lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.ragged import Memo, Pieces
from wardline.llm.tables import by_chunk, id_crc
from wardline.session import cut

TOXIC, CLEAN, TELLING, NEGATIVES, HARD = 2000, 10_000, 3000, 3000, 600
LANDMARKS, SPAN, DECAY, ODDS, FALSE_SHARE = 300, 8, 0.5, 10, 0.05
THRESHOLD, FLOOR = 0.3, -3.0
BUCKETS = 1 << 16
GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
IMITATED = dict(zip("0134578@$", "oieastbas", strict=True))
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){3,}\S(?!\S)")


def _letter_table() -> np.ndarray:
    """For every code point the letter it stands for, 0 if it is none."""
    table = np.fromiter((i if chr(i).isalpha() else 0 for i in range(sys.maxunicode + 1)), np.uint32)
    for c, letter in IMITATED.items():
        table[ord(c)] = ord(letter)
    return table


LETTER = _letter_table()


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words with gaps between them that no subsequence spans, and where each begins."""
    points = np.frombuffer((("\0" * SPAN).join(words) + "\0" * SPAN).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(w.lower()) for w in words), np.int64, len(words)) + SPAN
    return LETTER[points], np.cumsum(sizes) - sizes


def _subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(first positions, buckets of the subsequences of real letters, weight)."""
    n = len(codes)
    first, second, third = (codes * np.uint32(k) for k in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))
    for i, j in GAPS:
        if j < n:
            at = np.flatnonzero((codes[:n - j] > 0) & (codes[i:n - j + i] > 0) & (codes[j:] > 0))
            sub = first[at] + second[at + i] + third[at + j]
            yield at, (sub ^ sub >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16), DECAY ** (j - 2)


def word_vectors(words: list[str]) -> np.ndarray:
    """Normalised kernel vectors, dense: for a bounded number of words."""
    codes, starts = _coded(words)
    out = np.zeros((len(words), BUCKETS), np.float32)
    norm = np.zeros(len(words))
    for at, sub, weight in _subsequences(codes):
        row = np.searchsorted(starts, at, side="right") - 1
        np.add.at(out, (row, sub), weight)
        norm += np.bincount(row, minlength=len(words)) * weight ** 2
    return out / np.sqrt(np.maximum(norm, 1e-12)).astype(np.float32)[:, None]


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, 4.0, 0.0

    def decide(self, words: list[str]) -> list[float]:
        codes, starts = _coded(words)
        total, norm = np.zeros(len(codes)), np.zeros(len(codes))
        for at, sub, weight in _subsequences(codes):
            total[at] += weight * self.weights[sub]
            norm[at] += weight ** 2
        total, norm = np.add.reduceat(total, starts), np.add.reduceat(norm, starts)
        return np.where(norm > 0, total / np.sqrt(np.maximum(norm, 1e-12)) + self.bias, FLOOR).tolist()

    def decide_pieces(self, pieces: list[str]) -> list[float]:
        words = [p.split() for p in pieces]
        flat = [w for own in words for w in own]
        if not flat:
            return [FLOOR] * len(pieces)
        out, at = self.decide(flat), 0
        found = []
        for own in words:
            found.append(max(out[at:at + len(own)], default=FLOOR))
            at += len(own)
        return found

    def decide_texts(self, texts: pa.Array, memo: Memo) -> np.ndarray:
        pieces = Pieces(texts)
        own = np.array(memo.all(pieces.distinct))
        best = np.maximum.reduceat(own[pieces.at], pieces.bounds[:-1])
        spaced = pc.fill_null(pc.match_substring_regex(texts, r"(?:^|\s)(?:\S[ \t]+){3,}\S(?:\s|$)"), False)
        for i in np.flatnonzero(spaced.to_numpy(zero_copy_only=False)).tolist():
            runs = ["".join(r.split()) for r in SPACED.findall(texts[i].as_py())]
            if runs:
                best[i] = max(best[i], *self.decide(runs))
        return best

    def score(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decisions + self.shift, -40, 40)))


def fit_words(positive: list[str], negative: list[str], hard: list[str] = (), seed: int = 3) -> Model:
    """``hard``: negative words that a first model took for positive ones; some become landmarks."""
    if not positive or not negative:
        return Model(np.zeros(BUCKETS), -1.0)
    rng = np.random.default_rng(seed)
    words = [*positive, *negative, *hard]
    y = np.concatenate((np.ones(len(positive)), -np.ones(len(words) - len(positive))))
    marks = [*positive[:LANDMARKS // 2], *hard[:LANDMARKS // 4]]
    marks = marks + [negative[i] for i in rng.permutation(len(negative))[:LANDMARKS - len(marks)].tolist()]
    z = word_vectors(marks)
    kernel = np.concatenate([word_vectors(words[i:i + 250]) @ z.T for i in range(0, len(words), 250)]).astype(float)
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    own = values > 1e-6 * values.max()
    lift = vectors[:, own] / np.sqrt(values[own])
    x = np.concatenate((kernel @ lift, np.ones((len(words), 1))), axis=1)
    cost = np.where(y > 0, 1 / len(positive), 1 / (len(words) - len(positive))) * len(words)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        new = np.linalg.solve(a.T @ x[on] + 0.1 * np.eye(x.shape[1]), a.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return Model((lift @ w[:-1]) @ z, float(w[-1]))


def _words(docs: DataFrame) -> DataFrame:
    """doc_id, word, near (hash of the word with three neighbours on each side)."""
    return (docs.select("doc_id", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("w"))
            .select("doc_id", "w", F.posexplode("w").alias("at", "word")).where("length(word) > 2")
            .select("doc_id", "word", F.xxhash64(F.slice("w", F.greatest(F.col("at") - 2, F.lit(1)), 7)).alias("near")))


def _documents_of(words: DataFrame, name: str) -> DataFrame:
    """In how many documents each word is; those that have it in the same passage count once."""
    return (words.groupBy("word", "doc_id").agg(F.min("near").alias("near"))
            .groupBy("word").agg(F.count_distinct("near").alias(name)))


def upper_tail(bad: int, good: int, n_bad: int, n_good: int) -> float:
    """Chance of ``bad`` toxic documents or more among ``bad + good`` of all, if labels were dealt at random."""
    drawn = bad + good

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    whole = log_choose(n_bad + n_good, drawn)
    return min(1.0, sum(exp(log_choose(n_bad, k) + log_choose(n_good, drawn - k) - whole)
                        for k in range(bad, min(n_bad, drawn) + 1) if drawn - k <= n_good))


def telling_counts(pairs: list[tuple[int, int, int]], n_bad: int, n_good: int) -> dict[tuple[int, int], float]:
    """The significant of the pairs (toxic documents, clean documents, words with these counts), with their chances."""
    reach = {k: upper_tail(min(k, n_bad), max(0, k - n_bad), n_bad, n_good) for k in {bad + good for bad, good, _ in pairs}}
    least = sorted((reach[bad + good], n) for bad, good, n in pairs)
    tests = 1
    while (able := sum(n for p, n in least if p * tests <= FALSE_SHARE)) > tests:
        tests = tests + 1 if able < tests + 100 else tests + (able - tests) // 50
    found = sorted((upper_tail(bad, good, n_bad, n_good), bad, good, n) for bad, good, n in pairs
                   if reach[bad + good] * tests <= FALSE_SHARE)
    rank, last = 0, -1
    for i, (p, _, _, n) in enumerate(found):
        rank += n
        if p * able <= FALSE_SHARE * rank:
            last = i
    return {(bad, good): p for p, bad, good, _ in found[:last + 1] if bad * n_good >= ODDS * n_bad * good}


def _hard_words(clean: DataFrame, model: Model) -> list[str]:
    """The clean words that the model is surest of, of at most ``HARD``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            if words:
                yield pa.RecordBatch.from_arrays([batch["word"], pa.array(model.decide(words))], ["word", "decision"])

    found = (_words(clean).select("word").distinct().mapInArrow(run, "word string, decision double")
             .where("decision > -0.5").orderBy(F.desc("decision"), "word").limit(HARD))
    return [r["word"] for r in found.collect()]


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """``usable``: a condition on doc_id for rows whose labels may be seen."""
    marked = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    text = docs.select("doc_id", "text")

    def some(label: int, limit: int) -> DataFrame:
        ids = marked.where(F.col("toxic") == label).select("doc_id").distinct().orderBy(F.hash("doc_id"), "doc_id").limit(limit)
        return text.join(F.broadcast(ids), "doc_id", "left_semi")  # at most ``limit`` ids

    bad, good = some(1, TOXIC), some(0, CLEAN)
    n_bad, n_good = (x.select(F.xxhash64("text")).distinct().count() for x in (bad, good))  # a copied text is one
    if not n_bad or not n_good:
        return fit_words([], [])
    counts = cut(_documents_of(_words(bad), "bad").join(_documents_of(_words(good), "good"), "word", "left").fillna(0, ["good"]))
    pairs = [tuple(r) for r in counts.groupBy("bad", "good").count().collect()]  # at most TOXIC x CLEAN, few in fact
    chances = [(b, g, p) for (b, g), p in telling_counts(pairs, n_bad, n_good).items()]
    tested = F.broadcast(docs.sparkSession.createDataFrame(chances, "bad long, good long, chance double"))  # a row per pair
    telling = [r["word"] for r in counts.join(tested, ["bad", "good"]).orderBy("chance", "word").limit(TELLING).collect()]
    common = [r["word"] for r in counts.where(F.col("good") * n_bad * 2 >= F.col("bad") * n_good)
              .orderBy(F.desc("bad"), "word").limit(NEGATIVES).collect()]
    rare = [r["word"] for r in _words(some(0, TOXIC)).select("word").distinct().orderBy(F.xxhash64("word"), "word")
            .limit(NEGATIVES).collect()]
    negative = sorted({*common, *rare} - {*telling})
    model = fit_words(telling, negative)
    hard = _hard_words(some(0, TOXIC), model)
    if hard:
        model = fit_words(telling, negative, sorted({*hard} - {*telling}))
    known = bad.withColumn("toxic", F.lit(1)).unionByName(some(0, TOXIC).withColumn("toxic", F.lit(0)))
    scored = (known.select("doc_id", "toxic", decision(F.col("text"), model).alias("decision"))
              .orderBy("doc_id", "toxic").limit(2 * TOXIC).collect())
    d, t = np.array([r["decision"] for r in scored]), np.array([r["toxic"] for r in scored], float)
    x, w = np.stack((d, np.ones_like(d)), axis=1), np.array([1.0, 0.0])
    for _ in range(50):  # logistic regression on the decision, lightly held to unit slope
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (p - t) + 0.01 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
    model.slope, model.shift = float(max(w[0], 0.1)), float(w[1])
    return model


def decision(text: Column, model: Model) -> Column:
    """The decision of the text's strongest word."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = Memo(model.decide_pieces, 150_000)
        for texts in batches:
            yield pa.array(by_chunk(lambda part: model.decide_texts(part, memo), texts, 8 << 20))

    return run(text)


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1, higher is more toxic), predicted (1: toxic)."""
    margin = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("decision") * model.slope + model.shift))
    return (docs.select(F.col(doc_id).alias("doc_id"), decision(F.col(text), model).alias("decision"))
            .select("doc_id", (1 / (1 + F.exp(-margin))).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(F.col(doc_id)) % 4 == 2
