"""Analyst queries over the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import FAMILIES, FEATURES, SIGNAL_FAMILY
from wardline.functions.scalars import round_to
from wardline.functions.wording import alert_label, fallback_strength, full_sentence

# Columns of the alert feed, in order.
FEED_COLUMNS = ["ts", "user_id", "dept", "host", "predicted_attack_type", "unified_risk_score",
                "classifier_confidence", "final_risk_score", "secondary_review_flag", "label",
                "attack_type", "event_id"]


def alert_feed(results: DataFrame, min_risk: float = 50, attack_type: str | None = None,
               split: str | None = None, review_only: bool = False, limit: int = 300) -> DataFrame:
    """Highest unified scores first, with optional filters (null never matches)."""
    view = results.where(F.col("unified_risk_score") >= min_risk)
    if attack_type:
        view = view.where(F.col("predicted_attack_type") == attack_type)
    if split:
        view = view.where(F.col("clf_split") == split)
    if review_only:
        view = view.where("secondary_review_flag")
    return view.select(*FEED_COLUMNS).orderBy(F.desc("unified_risk_score"), "event_id").limit(limit)


def alert_candidates(results: DataFrame, limit: int = 200) -> DataFrame:
    """Attack-predicted alerts with their label line."""
    return (results.where("predicted_attack_type is not null")
            .select("event_id", "unified_risk_score",
                    alert_label(F.col("user_id"), F.col("predicted_attack_type"),
                                F.col("unified_risk_score")).alias("alert"))
            .orderBy(F.desc("unified_risk_score"), "event_id").limit(limit))


def event_lookup(results: DataFrame, event_id) -> DataFrame:
    return results.where(F.col("event_id") == event_id)


def feature_values(df: DataFrame, keys: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Unpivot: one (feature, value) row per event and feature."""
    typed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return typed.unpivot(keys, features, "feature", "value")


def caught_examples(results: DataFrame) -> DataFrame:
    """The first correctly classified attack of every class on the test split: a map-side minimum,
    so no class is sorted as a whole."""
    hits = results.where("clf_split = 'test' and attack_type = predicted_attack_type")
    return hits.groupBy("attack_type").agg(
        F.min(F.struct("ts", "event_id", "classifier_confidence")).alias("f")).select("attack_type", "f.*")


def seeded_sample(df: DataFrame, rows: int = 200) -> DataFrame:
    return df.orderBy(F.md5(F.col("event_id").cast("string"))).limit(rows)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def flagged_travel(results: DataFrame) -> DataFrame:
    """Rows predicted as impossible travel, or the true ones when nothing was predicted."""
    predicted = F.coalesce(F.col("predicted_attack_type") == "impossible_travel", F.lit(False))
    actual = F.coalesce(F.col("attack_type") == "impossible_travel", F.lit(False))
    some = results.agg(F.coalesce(F.max(predicted.cast("int")), F.lit(0)).alias("_some"))
    rows = results.where(predicted | actual).join(F.broadcast(some))  # one row
    return rows.where(F.when(F.col("_some") == 1, predicted).otherwise(actual)).drop("_some")


def with_location(results: DataFrame, events: DataFrame) -> DataFrame:
    """Coordinates from the log, read for the five columns only."""
    return results.join(events.select("event_id", "geo_lat", "geo_lon", "geo_city", "geo_country"),
                        "event_id", "left")


def lateral_users(results: DataFrame) -> DataFrame:
    return results.where("predicted_attack_type = 'lateral_movement' or attack_type = 'lateral_movement'").where(
        "user_id is not null").select("user_id").distinct()


def entity_timeline(results: DataFrame, user_id=None) -> DataFrame:
    """Score series with marker flags, of one user in time order or of all users."""
    rows = results if user_id is None else results.where(F.col("user_id") == user_id)
    view = rows.select("user_id", "ts", "event_id", "unified_risk_score",
                       (F.col("label") == "attack").alias("is_true_attack"),
                       F.col("predicted_attack_type").isNotNull().alias("is_flagged"))
    return view.orderBy("ts", "event_id") if user_id is not None else view


def entity_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("label") == "attack").alias("n_true_attacks"),
        F.count_if(F.col("predicted_attack_type").isNotNull()).alias("n_flagged"))


def family_of(feature: Column) -> Column:
    chain = None
    for name, family in SIGNAL_FAMILY.items():
        chain = F.when(feature == name, family) if chain is None else chain.when(feature == name, family)
    return chain


def fallback_breakdown(df: DataFrame) -> DataFrame:
    """Percent of each signal family from capped feature strengths: one projection, no shuffle."""
    sums = {fam: sum((fallback_strength(f) for f in FEATURES if SIGNAL_FAMILY[f] == fam), F.lit(0.0))
            for fam in FAMILIES}
    total = sum(sums.values(), F.lit(0.0))
    total = F.when(total == 0, F.lit(1e-9)).otherwise(total)
    return df.select("event_id", *[round_to(100 * s / total, 1).alias(f) for f, s in sums.items()])


def attribution_breakdown(attributions: DataFrame) -> DataFrame:
    """Percent of each signal family from long attributions (event_id, feature, value, shap_value)."""
    by_family = attributions.withColumn("family", family_of(F.col("feature"))).groupBy("event_id").pivot(
        "family", FAMILIES).agg(F.sum(F.abs(F.round("shap_value", 4)))).na.fill(0.0)
    total = sum((F.col(f) for f in FAMILIES), F.lit(0.0))
    total = F.when(total == 0, F.lit(1e-9)).otherwise(total)
    return by_family.select("event_id", *[round_to(100 * F.col(f) / total, 1).alias(f) for f in FAMILIES])


def top_factors(attributions: DataFrame, k: int = 3) -> DataFrame:
    """(event_id, predicted_label, factors): the k strongest features of each alert with sentences.

    One group per alert holds one row per feature, so the sort is of bounded size.
    """
    ranked = F.array_sort(F.collect_list(F.struct(
        (-F.abs("shap_value")).alias("size"), F.col("feature"), F.col("value"),
        F.round("shap_value", 4).alias("shap_value"),
        full_sentence(F.col("feature"), F.col("value"), F.col("shap_value"),
                      F.col("predicted_label")).alias("sentence"))))
    top = F.transform(F.slice(ranked, 1, k), lambda s: F.struct(
        s["feature"].alias("feature"), s["value"].alias("value"),
        s["shap_value"].alias("shap_value"), s["sentence"].alias("sentence")))
    return attributions.groupBy("event_id", "predicted_label").agg(top.alias("factors"))


def status_counts(results: DataFrame, users: DataFrame, first_fires: DataFrame, alerts: DataFrame) -> DataFrame:
    """Health line: cold-start entities, drifted entities, alert status."""
    return (users.agg(F.count_if("is_cold_start").alias("n_cold_start"))
            .join(first_fires.agg(F.count(F.lit(1)).alias("n_drifted")))
            .join(alerts.agg(F.when(F.count(F.lit(1)) > 0, "DRIFT ALERT").otherwise("Stable").alias("status"))))


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, share and incidents per attack type; the null type is normal traffic."""
    counts = df.groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.countDistinct("attack_id").alias("n_incidents"))
    share = F.col("n_events") / F.sum("n_events").over(Window.partitionBy(F.lit(1)))  # classes only
    return counts.withColumn("share", round_to(share, 6))


def feature_means(df: DataFrame, by: str, features: list[str], digits: int) -> DataFrame:
    """Group means; rows without a group value form a group of their own."""
    return df.groupBy(by).agg(*[round_to(F.avg(c), digits).alias(c) for c in features])
