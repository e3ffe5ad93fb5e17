"""Scored and result tables built with fixed rules in place of trained models.

The raw scores are sums of capped feature strengths and the class probabilities come from a hash, so
that every step after the models (percentiles, blend, gate, merge, reports) can be checked in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import CLASSES, FEATURES, FeatureConfig
from wardline.functions.scalars import round_to
from wardline.functions.wording import fallback_strength
from wardline.operators.scoring import (
    blend_cold_start, ensemble, gate_classes, merge_scores, population_reference,
    tag_training_split, top_class, with_target,
)
from wardline.operators.splits import three_way_split
from wardline.plans.features import feature_table
from wardline.session import checkpoint_dir
from wardline.sources.entities import Entities
from wardline.sources.events import access_entities, access_events

# Windows and caps that are busy on the test tables, whose events are hours apart.
TEST_CONFIG = FeatureConfig(lateral_window_s=3 * 86_400, failure_window_s=86_400,
                            hour_history=40, dept_history=300)

_kept: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, name: str, sf_dir: str, build, written: bool = True) -> DataFrame:
    """A table shared by many queries, built once per session and data folder.

    Written to the shared folder, so that readers prune columns, the lineage is cut and a lost
    executor costs nothing; small dimension tables are persisted instead.
    """
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _kept:
        if written:
            path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
            build().write.parquet(path)
            _kept[key] = spark.read.parquet(path)
        else:
            _kept[key] = build().persist()
    return _kept[key]


def forget() -> None:
    for df in _kept.values():
        df.unpersist()
    _kept.clear()


def entities_of(spark: SparkSession, sf_dir: str) -> Entities:
    ent = access_entities(access_events(spark, sf_dir))
    return Entities(*[kept(spark, f"entity {n}", sf_dir, lambda t=t: t, False) for n, t in (
        ("users", ent.users), ("hosts", ent.hosts), ("devices", ent.devices), ("edges", ent.edges),
        ("normal_hosts", ent.normal_hosts))])


def features_of(spark: SparkSession, sf_dir: str, cfg: FeatureConfig = TEST_CONFIG) -> DataFrame:
    def build():
        events = access_events(spark, sf_dir)
        return feature_table(events, entities_of(spark, sf_dir), cfg)
    return kept(spark, f"features:{cfg}", sf_dir, build)


def rule_scores(features: DataFrame) -> DataFrame:
    """Raw scores: the sum of the feature strengths, and a weighted sum of their squares."""
    parts = [fallback_strength(f) for f in FEATURES]
    return features.withColumns({
        "iso_raw": round_to(sum(parts[1:], parts[0]), 6),
        "ae_raw": round_to(sum((p * p * float(i + 2) for i, p in enumerate(parts[1:])), parts[0] * parts[0]), 6),
    })


def rule_probabilities(df: DataFrame) -> DataFrame:
    """A class probability array from hash digits, tilted toward the true class."""
    digest = F.md5(F.col("event_id").cast("string"))
    weights = F.array(*[
        (F.instr(F.lit("0123456789abcdef"), F.substring(digest, i + 1, 1))
         + F.when(F.col("target") == c, 24).otherwise(0)).cast("double")
        for i, c in enumerate(CLASSES)])
    total = F.aggregate("_w", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_w", weights).withColumn("_t", total).withColumn(
        "probs", F.transform("_w", lambda x: x / F.col("_t"))).drop("_w", "_t")


def scored_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        df = ensemble(tag_training_split(rule_scores(features_of(spark, sf_dir))))
        return blend_cold_start(df, population_reference(df))
    return kept(spark, "scored", sf_dir, build)


def results_of(spark: SparkSession, sf_dir: str, rule: str = "mean") -> DataFrame:
    def build():
        df = three_way_split(scored_of(spark, sf_dir))
        df = gate_classes(top_class(rule_probabilities(with_target(df))))
        return merge_scores(df, rule)
    return kept(spark, f"results:{rule}", sf_dir, build)
