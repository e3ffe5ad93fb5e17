"""Exact path-dependent tree attributions (Lundberg et al., 2018) for the boosted classifier.

A tree is the sum of its leaves, and a leaf is a product of one condition per feature on its path: with d
conditions, a row meets one of 2^d patterns of them. What a leaf gives each of its features depends on the
pattern alone, so a table of all patterns is computed once per leaf, and a row costs one lookup a leaf. Leaves with
equally many conditions are handled together, a bounded number at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.models.boosted import BoostedModel

CELLS = 1 << 21  # rows x leaves looked up at once


@dataclass(frozen=True)
class Paths:
    """All leaves of a class with ``feature.shape[1]`` conditions."""

    feature: np.ndarray  # leaf x condition
    low: np.ndarray  # met when low < x <= high
    high: np.ndarray
    table: np.ndarray  # leaf x pattern x condition


def leaves(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, cover: np.ndarray, at: int = 0, path: dict | None = None):
    """(value, {feature: (low, high, share of cover)}) of each leaf of one tree."""
    path = path or {}
    f = int(feature[at])
    if f < 0:
        yield float(value[at]), path
        return
    low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
    for child, lo, hi in ((2 * at + 1, low, min(high, cut[at])), (2 * at + 2, max(low, cut[at]), high)):
        part = cover[child] / cover[at] if cover[at] else 0.0
        yield from leaves(feature, cut, value, cover, child, {**path, f: (lo, hi, share * part)})


def pattern_table(value: np.ndarray, share: np.ndarray) -> np.ndarray:
    """What each condition gets under each pattern (bit c: condition c is met), for leaves (values, leaf x condition shares).

    A coalition's value is the leaf's, times 1 or 0 for each member as its condition is met, times the share for the rest.
    """
    d = share.shape[1]
    met = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)  # pattern x condition
    out = np.zeros((len(value), 1 << d, d))
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for members in range(1 << (d - 1)):
            term = np.ones((len(value), 1 << d))
            for b, j in enumerate(others):
                term *= met[None, :, j] if members >> b & 1 else share[:, None, j]
            size = members.bit_count()
            out[:, :, i] += math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d) * term
        out[:, :, i] *= value[:, None] * (met[None, :, i] - share[:, None, i])
    return out


def paths_of(model: BoostedModel) -> dict[str, list[Paths]]:
    """Per class: its leaves by number of conditions, with their tables; bounded by the trees' size."""
    out = {}
    for k, c in enumerate(model.classes):
        found: dict[int, list] = {}
        for r in range(model.feature.shape[0]):
            for value, path in leaves(model.feature[r, k], model.cut[r, k], model.value[r, k], model.cover[r, k]):
                if path:
                    found.setdefault(len(path), []).append((value, list(path.items())))
        out[c] = []
        for _, own in sorted(found.items()):
            feature, low, high, share = (np.array([[item(p) for p in path] for _, path in own]) for item in (
                lambda p: p[0], lambda p: p[1][0], lambda p: p[1][1], lambda p: p[1][2]))
            out[c].append(Paths(feature, low, high, pattern_table(np.array([v for v, _ in own]), share)))
    return out


def effects(x: np.ndarray, paths: list[Paths]) -> np.ndarray:
    """Attributions of rows ``x``: row x feature."""
    phi = np.zeros(x.shape)
    for p in paths:
        n, d = p.feature.shape
        step = max(1, CELLS // max(1, len(x) * d))
        for a in range(0, n, step):
            feature, low, high = p.feature[a:a + step], p.low[a:a + step], p.high[a:a + step]
            pattern = np.zeros((len(x), len(feature)), np.int64)
            for c in range(d):
                v = x[:, feature[:, c]]
                pattern |= ((v > low[:, c]) & (v <= high[:, c])).astype(np.int64) << c
            given = p.table[np.arange(a, a + len(feature)), pattern]  # row x leaf x condition
            flat = given.reshape(len(x), -1)
            order = np.argsort(feature.ravel(), kind="stable")
            owner = feature.ravel()[order]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            phi[:, owner[starts]] += np.add.reduceat(flat[:, order], starts, axis=1)
    return phi


def base_values(model: BoostedModel) -> dict[str, float]:
    """Expected logit per class: attributions of a row add up to its margin minus this."""
    return {c: sum(value * math.prod(s for *_, s in path.values())
                   for r in range(model.feature.shape[0])
                   for value, path in leaves(model.feature[r, k], model.cut[r, k], model.value[r, k], model.cover[r, k]))
            for k, c in enumerate(model.classes)}


def attributions(df: DataFrame, model: BoostedModel, label: str = "pred_label") -> DataFrame:
    """Long (event_id, predicted_label, feature, value, shap_value) toward the logit of each row's predicted class."""
    features = model.features
    shared = df.sparkSession.sparkContext.broadcast(paths_of(model))
    id_type = df.schema["event_id"].dataType.simpleString()

    def explain(batches):
        for frame in batches:
            x = frame[features].to_numpy(float)
            for c, index in frame.groupby("predicted_label").indices.items():
                part = x[index]
                phi = effects(part, shared.value.get(c, []))
                n = len(index)
                yield pd.DataFrame({
                    "event_id": np.repeat(frame["event_id"].to_numpy()[index], len(features)),
                    "predicted_label": c, "feature": np.tile(features, n),
                    "value": part.ravel(), "shap_value": phi.ravel()})

    rows = df.select("event_id", F.col(label).alias("predicted_label"),
                     *[F.col(c).cast("double").alias(c) for c in features])
    return rows.mapInPandas(explain, f"event_id {id_type}, predicted_label string, feature string, "
                                     "value double, shap_value double")
