"""Evaluation reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import CLASSES
from wardline.functions.scalars import round_to, unified_score
from wardline.operators.ranks import auc, quantiles
from wardline.operators.scoring import is_normal
from wardline.operators.skew import union_all
from wardline.session import cut

OVERALL = "overall"


def threshold(df: DataFrame, score: str, p: float, where: Column) -> DataFrame:
    """One row: the interpolated percentile of a score over the rows that satisfy ``where``."""
    return quantiles(df.where(where), score, {"threshold": p})


def anomaly_report(scored: DataFrame, score: str) -> DataFrame:
    """(metric, attack_type, n, value): AUC, threshold, false-positive rate and recalls on everything
    but the training normals, at the 95th percentile of the held-out normals.

    The rows are read once, into counts per score and class; the report is made from the counts.
    """
    held = cut(scored.where("split != 'train_normal'").groupBy(score, "split", "label", "attack_type")
               .agg(F.count(F.lit(1)).alias("c")))
    cut_row = cut(quantiles(held.where("split = 'holdout_normal'"), score, {"threshold": 0.95}, weight="c"))
    flagged = held.join(F.broadcast(cut_row))  # one row
    share = F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("c")).otherwise(0)) / F.sum("c")
    text = F.lit(None).cast("string")
    recall = (flagged.where("label = 'attack'").rollup("attack_type")
              .agg(F.grouping("attack_type").alias("_g"), F.sum("c").alias("n"), share.alias("value"))
              .select(F.lit("recall").alias("metric"),
                      F.when(F.col("_g") == 1, OVERALL).otherwise(F.col("attack_type")).alias("attack_type"),
                      "n", "value"))
    fp = flagged.where(is_normal()).agg(F.sum("c").alias("n"), share.alias("value")).select(
        F.lit("fp_rate").alias("metric"), text.alias("attack_type"), "n", "value")
    sizes = held.agg(F.sum("c").alias("_held"), F.sum(F.when(is_normal(), F.col("c"))).alias("_normal"))
    area = auc(held, score, F.col("label") == "attack", "c").join(F.broadcast(sizes)).select(  # one row each
        F.lit("roc_auc").alias("metric"), text.alias("attack_type"), F.col("_held").alias("n"),
        F.col("auc").alias("value"))
    line = cut_row.join(F.broadcast(sizes)).select(
        F.lit("threshold").alias("metric"), text.alias("attack_type"), F.col("_normal").alias("n"),
        F.col("threshold").alias("value"))
    return union_all([recall, fp, area, line]).withColumn("value", round_to(F.col("value"), 6))


def cold_start_effect(scored: DataFrame) -> DataFrame:
    """Mean score of cold normal rows before and after the blend."""
    return scored.where(is_normal() & (F.col("is_cold_start_entity") == 1)).agg(
        F.count(F.lit(1)).alias("n"),
        round_to(F.avg("ensemble_score_raw"), 4).alias("mean_raw"),
        round_to(F.avg("final_risk_score"), 4).alias("mean_blended"))


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, target: str = "target", pred: str = "pred_label",
                     classes: list[str] = CLASSES) -> DataFrame:
    """One row per true class in class order, one column per predicted class, zeros present."""
    counts = df.groupBy(target).pivot(pred, classes).agg(F.count(F.lit(1)))
    counts = counts.select(F.col(target).alias("true_class"), *[F.col(c).alias(f"pred_{c}") for c in classes])
    frame = df.sparkSession.createDataFrame([(c,) for c in classes], "true_class string")
    return frame.join(counts, "true_class", "left").na.fill(0)


def classification_report(df: DataFrame, target: str = "target", pred: str = "pred_label") -> DataFrame:
    """(class, precision, recall, f1, support) with accuracy, macro avg and weighted avg rows.

    One aggregation to (target, prediction) counts; the rest works on at most classes^2 rows.
    """
    pairs = cut(df.groupBy(F.col(target).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("c")))
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("c").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("c").alias("called"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "tp")])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    per = per.withColumns({"precision": ratio(F.col("tp"), F.col("called")),
                           "recall": ratio(F.col("tp"), F.col("support"))})
    per = per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    share = F.col("support") / F.sum("support").over(Window.partitionBy(F.lit(1)))  # classes only
    per = per.withColumn("_w", share)
    rows = per.select("class", *names, "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("class"), *names, "support")
    weighted = per.agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names],
                       F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("class"), *names, "support")
    hits = F.sum("tp") / F.sum("support")
    accuracy = per.agg(hits.alias("precision"), hits.alias("recall"), hits.alias("f1"),
                       F.sum("support").alias("support")).select(
        F.lit("accuracy").alias("class"), *names, "support")
    out = rows.unionByName(accuracy).unionByName(macro).unionByName(weighted)
    return out.withColumns({c: round_to(F.col(c), 3) for c in names})


def false_alarm_rate(df: DataFrame, target: str = "target", pred: str = "pred_label") -> DataFrame:
    """Share of normal rows predicted as any attack."""
    return df.where(F.col(target) == "normal").agg(
        F.count(F.lit(1)).alias("n_normal"),
        round_to(F.avg((F.col(pred) != "normal").cast("int")), 6).alias("fp_rate"))


def recall_comparison(test: DataFrame, scored: DataFrame, score: str = "final_risk_score") -> DataFrame:
    """Classifier recall per class next to the recall of the anomaly layer at its own threshold."""
    layer = anomaly_report(scored, score).where("metric = 'recall'").select(
        F.col("attack_type"), F.col("value").alias("anomaly_recall"))
    own = test.where("target != 'normal'").groupBy(F.col("target").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n"),
        round_to(F.avg((F.col("pred_label") == F.col("target")).cast("int")), 6).alias("classifier_recall"))
    return own.join(layer, "attack_type", "left")


def incident_rollup(test: DataFrame) -> DataFrame:
    """Per attack type: sessions, events, row recall, and the share of sessions with at least one row
    flagged as any attack / as the right type. Rows collapse to one per session first."""
    hit = (F.col("pred_label") == F.col("target")).cast("int")
    by_session = test.where("target != 'normal'").groupBy("target", "attack_id").agg(
        F.count(F.lit(1)).alias("c"), F.sum(hit).alias("h"),
        F.max((F.col("pred_label") != "normal").cast("int")).alias("any_hit"), F.max(hit).alias("right_hit"))
    return by_session.groupBy(F.col("target").alias("attack_type")).agg(
        F.count(F.lit(1)).alias("n_incidents"), F.sum("c").alias("n_events"),
        round_to(F.sum("h") / F.sum("c"), 3).alias("row_level_recall"),
        round_to(F.avg("any_hit"), 3).alias("incident_recall_any_attack"),
        round_to(F.avg("right_hit"), 3).alias("incident_recall_correct_type"))


def merge_rule_report(val: DataFrame, rules: tuple[str, ...] = ("mean", "max"), target_fp: float = 0.05,
                      attack_prob: str = "classifier_attack_prob") -> DataFrame:
    """(rule, rule_order, attack_type, n, recall, threshold, fp_rate), all rules in one pass.

    The threshold of a rule is the (1 - target_fp) percentile of its score on the normal rows.
    """
    a, b = F.col("final_risk_score"), F.col(attack_prob)
    options = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("rule_order"), unified_score(a, b, r).alias("u"))
        for i, r in enumerate(rules)])).alias("o")
    counts = cut(val.select("label", "attack_type", options).select("label", "attack_type", "o.*")
                 .groupBy("label", "attack_type", "rule", "rule_order", "u").agg(F.count(F.lit(1)).alias("c")))
    lines = quantiles(counts.where(is_normal()), "u", {"threshold": 1 - target_fp}, ["rule"], "c")
    hits = counts.join(F.broadcast(lines), "rule")  # one row per rule
    share = F.sum(F.when(F.col("u") >= F.col("threshold"), F.col("c")).otherwise(0)) / F.sum("c")
    fp = hits.where(is_normal()).groupBy("rule").agg(share.alias("fp_rate"), F.max("threshold").alias("threshold"))
    recall = (hits.where("label = 'attack'")
              .withColumn("attack_type", F.explode(F.array("attack_type", F.lit(OVERALL))))
              .groupBy("rule", "rule_order", "attack_type").agg(F.sum("c").alias("n"), share.alias("recall")))
    return recall.join(F.broadcast(fp), "rule").withColumns(  # one row per rule
        {c: round_to(F.col(c), 6) for c in ("recall", "fp_rate", "threshold")})


def winning_rule(report: DataFrame) -> DataFrame:
    """The rule with the highest overall recall; ties go to the one listed first."""
    return report.where(F.col("attack_type") == OVERALL).orderBy(F.desc("recall"), "rule_order").limit(1).select(
        "rule", "recall")


def review_sweep(val: DataFrame, thresholds: tuple[int, ...] = (90, 95, 97, 98, 99)) -> DataFrame:
    """Per threshold: normal rows flagged, and attacks recovered that the classifier called normal."""
    steps = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    rows = val.select("label", "final_risk_score", "pred_label", steps).where("final_risk_score >= threshold")
    got = rows.groupBy("threshold").agg(
        F.count_if(is_normal()).alias("noise"),
        F.count_if((F.col("label") == "attack") & (F.col("pred_label") == "normal")).alias("recovered"))
    frame = val.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold int")
    return frame.join(got, "threshold", "left").na.fill(0)


def review_summary(results: DataFrame) -> DataFrame:
    """Secondary-review rows on the test split and on all rows."""
    flag, attack = F.col("secondary_review_flag"), F.col("label") == "attack"
    test = F.col("clf_split") == "test"
    return results.agg(
        F.count_if(flag & test).alias("n_test"), F.count_if(flag & test & attack).alias("n_test_attack"),
        F.count_if(flag & test & ~attack).alias("n_test_noise"),
        F.count_if(flag).alias("n_all"), F.count_if(flag & attack).alias("n_all_attack"))
