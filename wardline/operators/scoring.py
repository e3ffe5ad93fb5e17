"""Score algebra: splits, ensemble, cold-start blend, class gate, merge with the classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.config import CLASSES
from wardline.functions.scalars import clip, hash_percent, round_to, unified_score
from wardline.operators.ranks import percentile_rank, quantiles
from wardline.operators.skew import lookup

GLOBAL = "__global__"


def is_normal() -> Column:
    return F.col("label") == "normal"


def with_target(df: DataFrame) -> DataFrame:
    """Class target: no attack type means normal."""
    return df.withColumn("target", F.coalesce("attack_type", F.lit("normal")))


def tag_training_split(df: DataFrame, train_percent: int = 70) -> DataFrame:
    """train_normal / holdout_normal / attack in one pass; normals split by a stable hash."""
    return df.withColumn("split", F.when(~is_normal(), "attack")
                         .when(hash_percent(F.col("event_id")) < train_percent, "train_normal")
                         .otherwise("holdout_normal"))


def ensemble(df: DataFrame, first: str = "iso_raw", second: str = "ae_raw") -> DataFrame:
    """Percentiles of two raw scores against the training normals, and their mean (before rounding)."""
    ref = F.col("split") == "train_normal"
    df = percentile_rank(df, first, "_p1", ref)
    df = percentile_rank(df, second, "_p2", ref)
    return df.withColumns({
        "iso_forest_score": round_to(F.col("_p1"), 2),
        "autoencoder_score": round_to(F.col("_p2"), 2),
        "ensemble_score_raw": round_to((F.col("_p1") + F.col("_p2")) / 2, 2),
    }).drop("_p1", "_p2")


def population_reference(df: DataFrame, score: str = "ensemble_score_raw",
                         train_only: bool = False) -> DataFrame:
    """(dept, ref_score): median score of established normal rows per department, and over all of
    them under ``__global__``. ``train_only`` leaves the held-out normals out."""
    rows = df.where(is_normal() & (F.col("is_cold_start_entity") == 0))
    if train_only:
        rows = rows.where("split = 'train_normal'")
    counted = rows.select("dept", score).withColumn(
        "dept", F.explode(F.array(F.col("dept"), F.lit(GLOBAL))))
    return quantiles(counted, score, {"ref_score": 0.5}, ["dept"])


def blend_cold_start(df: DataFrame, reference: DataFrame, score: str = "ensemble_score_raw",
                     broadcast_rows: int = 500_000) -> DataFrame:
    """final_risk_score: the score pulled toward the department median while history is thin."""
    general = reference.where(F.col("dept") == GLOBAL).select(F.col("ref_score").alias("_general"))
    own = reference.where(F.col("dept") != GLOBAL)
    df = lookup(df, own, "dept", broadcast_rows).join(F.broadcast(general), how="left")  # one row
    w = clip(F.col("cold_start_blend_weight"), 0.0, 1.0)
    mixed = w * F.col(score) + (1 - w) * F.coalesce("ref_score", "_general")
    return df.withColumn("final_risk_score", round_to(clip(mixed, 0.0, 100.0), 2)).drop("ref_score", "_general")


def gate_classes(df: DataFrame, probs: str = "probs", classes: list[str] = CLASSES) -> DataFrame:
    """Walks the classes from most to least likely and takes the first whose necessary condition holds.

    brute_force needs a failed login in the window, device_spoofing a fingerprint mismatch. Ties go
    to class order. The attack probability stays 1 - P(normal). Adds pred_label, confidence and
    attack_prob, all native array expressions.
    """
    names = F.array(*[F.lit(c) for c in classes])
    needs = {"brute_force": F.col("failure_burst_count") >= 1,
             "device_spoofing": F.col("fingerprint_mismatch") >= 1}
    # The least of one struct a class: array functions with lambdas would be interpreted row by row.
    first = F.least(*[F.when((F.size(probs) > i) & needs.get(c, F.lit(True)), F.struct(
        (-F.get(probs, F.lit(i))).alias("np"), F.lit(i).alias("i"))) for i, c in enumerate(classes)])
    normal = classes.index("normal")
    return df.withColumn("_top", first).withColumns({
        "pred_label": F.get(names, F.col("_top.i")),
        "confidence": -F.col("_top.np"),
        "attack_prob": 1.0 - F.element_at(probs, normal + 1),
    }).drop("_top")


def top_class(df: DataFrame, probs: str = "probs", classes: list[str] = CLASSES) -> DataFrame:
    """Ungated prediction, for comparison: raw_label and raw_confidence."""
    names = F.array(*[F.lit(c) for c in classes])
    best = F.greatest(*[F.when(F.size(probs) > i, F.struct(F.get(probs, F.lit(i)).alias("p"), F.lit(-i).alias("ni")))
                        for i in range(len(classes))])
    return df.withColumn("_top", best).withColumns({
        "raw_label": F.get(names, -F.col("_top.ni")), "raw_confidence": F.col("_top.p"),
    }).drop("_top")


def merge_scores(df: DataFrame, rule: str, review_threshold: float = 98.0) -> DataFrame:
    """Result columns from gated predictions: null for normal, percent scale, unified score, review flag."""
    df = df.withColumns({
        "predicted_attack_type": F.nullif(F.col("pred_label"), F.lit("normal")),
        "classifier_confidence": round_to(F.col("confidence"), 4),
        "classifier_attack_prob": round_to(F.col("attack_prob") * 100, 2),
    })
    return df.withColumns({
        "unified_risk_score": round_to(
            unified_score(F.col("final_risk_score"), F.col("classifier_attack_prob"), rule), 2),
        "secondary_review_flag":
            F.col("predicted_attack_type").isNull() & (F.col("final_risk_score") >= review_threshold),
    })
