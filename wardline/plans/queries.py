"""Every registered query with its DuckDB counterpart (where SQL can express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import CLASSES, FAMILIES, FEATURES, SIGNAL_FAMILY, DriftConfig, FeatureConfig
from wardline.functions import scalars
from wardline.functions.wording import fallback_strength, full_sentence
from wardline.models.attribution import attributions
from wardline.models.autoencoder import linear_score, network_score, train_autoencoder
from wardline.models.boosted import random_forest_scores
from wardline.models.forest import expected_depth, forest_score, train_forest
from wardline.operators import alerts, drift, evaluate, graph, scoring, splits
from wardline.operators.balance import class_weights, fill_medians, standardise, with_fill
from wardline.operators.causal import enrich
from wardline.operators.oversample import smote
from wardline.operators.skew import union_all
from wardline.plans import oracles as o
from wardline.plans.results import (
    TEST_CONFIG, entities_of, features_of, results_of, scored_of,
)
from wardline.plans.training import fit_classifier, predict
from wardline.session import cut
from wardline.sources.entities import host_owners
from wardline.sources.events import access_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return keep


def _on(ctes: dict[str, str], text: str) -> str:
    return o.sql(ctes, text)


def _access(text: str) -> str:
    return _on(o.access(), text)


def _edges(text: str) -> str:
    return _on(o.access() | o.edges(), text)


def _features(text: str) -> str:
    return _on(o.features(), text)


def _scored(text: str) -> str:
    return _on(o.scored(), text)


def _results(text: str, rule: str = "mean") -> str:
    return _on(o.results(rule), text)


def _cols(names: list[str]) -> str:
    return ", ".join(names)


def _select_features(name: str, columns: list[str]) -> None:
    @register(name, _features(f"SELECT event_id, {_cols(columns)} FROM features"))
    def query(spark, sf_dir):
        return features_of(spark, sf_dir).select("event_id", *columns)


# ---- causal features ---------------------------------------------------------------------------

@register("event_features", _features("SELECT * FROM features"))
def event_features(spark, sf_dir):
    return features_of(spark, sf_dir)


@register("event_features_minutes", _on(o.features(FeatureConfig()), "SELECT * FROM features"))
def event_features_minutes(spark, sf_dir):
    return features_of(spark, sf_dir, FeatureConfig())


_select_features("user_history_depth", ["entity_history_event_count", "entity_history_days",
                                        "is_cold_start_entity", "cold_start_blend_weight"])
_select_features("travel_speed", ["geo_distance_km", "geo_velocity_kmh", "time_since_last_event_min"])
_select_features("novelty_flags", ["is_new_device", "is_new_host", "is_foreign_dept",
                                   "is_first_time_in_this_dept"])
_select_features("hour_deviation", ["hour_zscore"])
_select_features("fingerprint_mismatch", ["fingerprint_mismatch"])
_select_features("burst_counts", ["foreign_dept_burst_distinct", "new_host_burst_count", "failure_burst_count"])
_select_features("graph_distance_from_history", ["graph_dist_from_history"])


# ---- events, dimensions, scalars ----------------------------------------------------------------

@register("access_view", _access("SELECT event_id, user_id, dept, host, device_id, status, label, attack_type, "
                                 "attack_id, geo_city, geo_country, geo_lat, geo_lon FROM access"))
def access_view(spark, sf_dir):
    return access_events(spark, sf_dir).drop("ts", "spoofed_fingerprint")


@register("enriched_events", _access("""
    SELECT event_id, dept AS home_dept, owner_dept, us, round(hr, 6) AS hour, NOT is_cold_start AS established,
      split_part(fp, '|', 1) AS os, split_part(fp, '|', 2) AS browser, split_part(fp, '|', 3) AS screen,
      CAST(owner_dept <> dept AND owner_dept <> 'shared' AS INT) AS is_foreign_dept FROM access"""))
def enriched_events(spark, sf_dir):
    events = access_events(spark, sf_dir)
    ent = entities_of(spark, sf_dir)
    e = enrich(events, ent.users, ent.hosts, ent.devices, TEST_CONFIG)
    return e.select("event_id", "home_dept", "owner_dept", "us", F.round("hour", 6).alias("hour"), "established",
                    "fp.os", "fp.browser", "fp.screen", "is_foreign_dept")


@register("host_owners", _access("""
    SELECT host, max(CASE WHEN host >= 90 THEN 'shared' ELSE dept END) AS owner_dept FROM access
    WHERE host >= 90 OR (host % 18 < 9 AND floor(host / 18.0) = CAST(substr(dept, 2) AS INT)) GROUP BY host"""))
def host_owner_map(spark, sf_dir):
    events = access_events(spark, sf_dir)
    home = events.where("host < 90 and host % 18 < 9 and floor(host / 18) = cast(substr(dept, 2) as int)")
    # Hosts seen through department rules and through shared rules; shared wins.
    return host_owners(home.select("host", "dept").distinct(), events.where("host >= 90").select("host").distinct())


@register("department_hours", _on(o.access() | {"s": "SELECT dept, count(*) AS n, "
          "sum(sin(hr * (2 * pi() / 24))) AS s, sum(cos(hr * (2 * pi() / 24))) AS c FROM access GROUP BY dept"},
          f"SELECT dept, n, round({o.circular('n', 's', 'c')[0]}, 6) AS mean_hour, "
          f"round({o.circular('n', 's', 'c')[1]}, 6) AS std_hour FROM s"))
def department_hours(spark, sf_dir):
    angle = scalars.fractional_hour(F.col("ts")) * scalars.HOUR_TO_RADIANS
    sums = access_events(spark, sf_dir).groupBy("dept").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.sin(angle)).alias("s"), F.sum(F.cos(angle)).alias("c"))
    n, s, c = F.col("n"), F.col("s"), F.col("c")
    return sums.select("dept", "n", F.round(scalars.circular_mean(n, s, c), 6).alias("mean_hour"),
                       F.round(scalars.circular_std(n, s, c), 6).alias("std_hour"))


@register("day_offsets", _access("""
    SELECT CAST(floor((us - (SELECT min(us) FROM access)) / 86400000000.0) AS INT) AS day, count(*) AS n
    FROM access GROUP BY 1"""))
def day_offsets(spark, sf_dir):
    return drift.with_day(access_events(spark, sf_dir)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@register("dataset_stats", _access(f"""
    SELECT attack_type, count(*) AS n_events, count(DISTINCT attack_id) AS n_incidents,
      {o.r('count(*) / (sum(count(*)) OVER ())::DOUBLE', 6)} AS share FROM access GROUP BY attack_type"""))
def dataset_stats(spark, sf_dir):
    return alerts.dataset_stats(access_events(spark, sf_dir))


# ---- graph -------------------------------------------------------------------------------------

@register("host_edges", _edges("SELECT src, dst, kind FROM links"))
def host_edges(spark, sf_dir):
    return graph.undirected(entities_of(spark, sf_dir).edges)


@register("host_distances", _on(o.access() | o.edges()
                                | o.distance_ctes(), "SELECT src, dst, CAST(d AS INT) AS d FROM dist"))
def host_distances(spark, sf_dir):
    ent = entities_of(spark, sf_dir)
    return graph.distances(ent.hosts, ent.edges)


_NODES = o.results() | {
    "picked": """SELECT DISTINCT user_id, dept FROM results
        WHERE predicted_attack_type = 'lateral_movement' OR attack_type = 'lateral_movement'""",
    "touched": "SELECT DISTINCT user_id, host FROM results WHERE user_id IN (SELECT user_id FROM picked)",
    "normal_hosts": "SELECT user_id, CAST(substr(dept, 2) AS INT) * 18 + i AS host FROM picked, range(9) t(i)",
    "context": "SELECT user_id, dst AS host FROM touched JOIN links ON src = host",
    "nodes": """SELECT user_id, host, CASE min(p) WHEN 0 THEN 'touched' WHEN 1 THEN 'normal' ELSE 'context' END AS role
        FROM (SELECT *, 0 AS p FROM touched UNION ALL SELECT *, 1 FROM normal_hosts UNION ALL SELECT *, 2 FROM context)
        WHERE host IN (SELECT src FROM links) GROUP BY user_id, host""",
}


def _nodes(spark, sf_dir):
    res = results_of(spark, sf_dir)
    ent = entities_of(spark, sf_dir)
    links = cut(graph.undirected(ent.edges))
    nodes = graph.investigation_nodes(alerts.lateral_users(res), res.select("user_id", "host"),
                                      ent.normal_hosts, links)
    return cut(nodes), links


@register("investigation_nodes", _on(_NODES, "SELECT user_id, CAST(host AS INT) AS host, role FROM nodes"))
def investigation_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir)[0]


@register("investigation_edges", _on(_NODES, """
    SELECT a.user_id, l.src, l.dst, l.kind FROM links l JOIN nodes a ON a.host = l.src
    JOIN nodes b ON b.host = l.dst AND b.user_id = a.user_id WHERE l.src < l.dst"""))
def investigation_edges(spark, sf_dir):
    return graph.investigation_edges(*_nodes(spark, sf_dir))


# ---- aggregations on features ------------------------------------------------------------------

# The columns of the two summary reports.
LABEL_SUMMARY = ["hour_zscore", "geo_velocity_kmh", "is_new_device", "fingerprint_mismatch", "is_new_host",
                 "foreign_dept_burst_distinct", "new_host_burst_count", "graph_dist_from_history",
                 "failure_burst_count"]
ATTACK_SUMMARY = ["hour_zscore", "geo_velocity_kmh", "is_new_device", "fingerprint_mismatch",
                  "foreign_dept_burst_distinct", "new_host_burst_count", "graph_dist_from_history",
                  "failure_burst_count"]


def _means(by: str, names: list[str], digits: int) -> str:
    cols = ", ".join(f"{o.r(f'avg({c})', digits)} AS {c}" for c in names)
    return _features(f"SELECT {by}, {cols} FROM features GROUP BY {by}")


@register("feature_means_by_label", _means("label", LABEL_SUMMARY, 3))
def feature_means_by_label(spark, sf_dir):
    return alerts.feature_means(features_of(spark, sf_dir), "label", LABEL_SUMMARY, 3)


@register("feature_means_by_attack", _means("attack_type", ATTACK_SUMMARY, 2))
def feature_means_by_attack(spark, sf_dir):
    return alerts.feature_means(features_of(spark, sf_dir), "attack_type", ATTACK_SUMMARY, 2)


@register("fill_medians", _scored("SELECT 'time_since_last_event_min' AS feature, "
          "quantile_cont(time_since_last_event_min, 0.5) AS fill FROM tagged WHERE split = 'train_normal' "
          "HAVING count(*) FILTER (time_since_last_event_min IS NULL) > 0"))
def fill_median_table(spark, sf_dir):
    return fill_medians(scored_of(spark, sf_dir).where("split = 'train_normal'"))


@register("filled_matrix", _scored("SELECT event_id, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c != "time_since_last_event_min" else
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM tagged WHERE split = 'train_normal')) AS {c}"
    for c in FEATURES) + " FROM tagged"))
def filled_matrix(spark, sf_dir):
    df = scored_of(spark, sf_dir)
    fills = fill_medians(df.where("split = 'train_normal'"))
    return with_fill(df, fills).select("event_id", *[F.col(c).cast("double").alias(c) for c in FEATURES])


@register("standardised_features", _on(o.scored() | {"filled": "SELECT event_id, split, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c != "time_since_last_event_min" else
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM tagged WHERE split = 'train_normal')) AS {c}"
    for c in FEATURES) + " FROM tagged"}, "SELECT event_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM filled WHERE split = 'train_normal')) / (SELECT coalesce(nullif("
    f"stddev_pop({c}), 0), 1) FROM filled WHERE split = 'train_normal'), 6) AS {c}" for c in FEATURES) + " FROM filled"))
def standardised_features(spark, sf_dir):
    df = scored_of(spark, sf_dir)
    df = with_fill(df, fill_medians(df.where("split = 'train_normal'")))
    out = standardise(df, df.where("split = 'train_normal'"))
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in FEATURES])


# ---- splits ------------------------------------------------------------------------------------

@register("training_split", _scored("SELECT event_id, split FROM tagged"))
def training_split(spark, sf_dir):
    return scoring.tag_training_split(features_of(spark, sf_dir)).select("event_id", "split")


@register("split_union", _scored("SELECT split, count(*) AS n FROM tagged GROUP BY split"))
def split_union(spark, sf_dir):
    """The tagged table put together from its three parts."""
    df = scoring.tag_training_split(features_of(spark, sf_dir))
    parts = [df.where(F.col("split") == s).select("event_id", F.lit(s).alias("split"))
             for s in ("train_normal", "holdout_normal", "attack")]
    return union_all(parts).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("session_split", _results("SELECT attack_id, s AS clf_split FROM session_split"))
def session_split(spark, sf_dir):
    return splits.session_split(access_events(spark, sf_dir))


@register("three_way_split", _results("SELECT event_id, clf_split FROM targets"))
def three_way_split(spark, sf_dir):
    return splits.three_way_split(access_events(spark, sf_dir)).select("event_id", "clf_split")


@register("split_leakage", _results("""SELECT attack_id, count(DISTINCT clf_split) AS n_splits FROM targets
    WHERE attack_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT clf_split) > 1"""))
def split_leakage(spark, sf_dir):
    return splits.leaking_sessions(splits.three_way_split(access_events(spark, sf_dir)))


@register("class_counts", _results("SELECT clf_split, target, count(*) AS n FROM targets GROUP BY ALL"))
def class_counts(spark, sf_dir):
    df = splits.three_way_split(scoring.with_target(access_events(spark, sf_dir)))
    return df.groupBy("clf_split", "target").agg(F.count(F.lit(1)).alias("n"))


@register("class_weights", _results(f"""SELECT target, {o.r('''(sum(count(*)) OVER ())::DOUBLE
    / (count(*) * count(*) OVER ())''', 6)} AS weight FROM targets WHERE clf_split = 'train' GROUP BY target"""))
def class_weight_table(spark, sf_dir):
    train = results_of(spark, sf_dir).where("clf_split = 'train'")
    return class_weights(train).select("target", scalars.round_to(F.col("weight"), 6).alias("weight"))


# ---- anomaly scores ----------------------------------------------------------------------------

@register("percentile_scores", _scored("SELECT event_id, iso_forest_score, autoencoder_score, ensemble_score_raw FROM ens"))
def percentile_scores(spark, sf_dir):
    return scored_of(spark, sf_dir).select("event_id", "iso_forest_score", "autoencoder_score", "ensemble_score_raw")


@register("population_reference", _scored(
    "SELECT dept, round(ref_score, 6) AS ref_score FROM dept_ref "
    "UNION ALL SELECT '__global__', round(general, 6) FROM global_ref"))
def population_reference(spark, sf_dir):
    return scoring.population_reference(scored_of(spark, sf_dir)).select(
        "dept", F.round("ref_score", 6).alias("ref_score"))


@register("population_reference_train", _scored("""
    SELECT dept, round(quantile_cont(ensemble_score_raw, 0.5), 6) AS ref_score FROM ens
    WHERE split = 'train_normal' AND is_cold_start_entity = 0 GROUP BY dept
    UNION ALL SELECT '__global__', round(quantile_cont(ensemble_score_raw, 0.5), 6) FROM ens
    WHERE split = 'train_normal' AND is_cold_start_entity = 0"""))
def population_reference_train(spark, sf_dir):
    return scoring.population_reference(scored_of(spark, sf_dir), train_only=True).select(
        "dept", F.round("ref_score", 6).alias("ref_score"))


@register("final_risk", _scored("SELECT event_id, final_risk_score FROM scored"))
def final_risk(spark, sf_dir):
    return scored_of(spark, sf_dir).select("event_id", "final_risk_score")


@register("scored_events", _scored("SELECT * EXCLUDE (entity_history_days, entity_history_event_count, "
          "iso_raw, ae_raw) FROM scored"))
def scored_events(spark, sf_dir):
    return scored_of(spark, sf_dir).drop("entity_history_days", "entity_history_event_count", "iso_raw", "ae_raw")


@register("alert_threshold", _scored("SELECT round(quantile_cont(final_risk_score, 0.95), 6) AS threshold "
          "FROM scored WHERE split = 'holdout_normal'"))
def alert_threshold(spark, sf_dir):
    df = scored_of(spark, sf_dir)
    return evaluate.threshold(df, "final_risk_score", 0.95, F.col("split") == "holdout_normal").select(
        F.round("threshold", 6).alias("threshold"))


def _report_sql(score: str) -> str:
    extra = {
        "held": "SELECT * FROM scored WHERE split <> 'train_normal'",
        "line": f"SELECT quantile_cont({score}, 0.95) AS t FROM scored WHERE split = 'holdout_normal'",
        "hits": f"SELECT *, CAST({score} >= t AS INT) AS hit FROM held CROSS JOIN line",
        "pairs": f"""SELECT avg(CASE WHEN p.{score} > n.{score} THEN 1.0 WHEN p.{score} = n.{score} THEN 0.5
            ELSE 0.0 END) AS a FROM held p JOIN held n ON p.label = 'attack' AND n.label = 'normal'""",
    }
    return _on(o.scored() | extra, f"""
        SELECT 'recall' AS metric, coalesce(attack_type, 'overall') AS attack_type, count(*) AS n,
          {o.r('avg(hit)', 6)} AS value FROM hits WHERE label = 'attack' GROUP BY ROLLUP (attack_type)
        UNION ALL SELECT 'fp_rate', NULL, count(*), {o.r('avg(hit)', 6)} FROM hits WHERE label = 'normal'
        UNION ALL SELECT 'roc_auc', NULL, (SELECT count(*) FROM held), {o.r('a', 6)} FROM pairs
        UNION ALL SELECT 'threshold', NULL, (SELECT count(*) FROM held WHERE label = 'normal'), {o.r('t', 6)} FROM line""")


@register("anomaly_report_raw", _report_sql("ensemble_score_raw"))
def anomaly_report_raw(spark, sf_dir):
    return evaluate.anomaly_report(scored_of(spark, sf_dir), "ensemble_score_raw")


@register("anomaly_report_final", _report_sql("final_risk_score"))
def anomaly_report_final(spark, sf_dir):
    return evaluate.anomaly_report(scored_of(spark, sf_dir), "final_risk_score")


@register("cold_start_effect", _scored(f"""SELECT count(*) AS n, {o.r('avg(ensemble_score_raw)', 4)} AS mean_raw,
    {o.r('avg(final_risk_score)', 4)} AS mean_blended FROM scored
    WHERE label = 'normal' AND is_cold_start_entity = 1"""))
def cold_start_effect(spark, sf_dir):
    return evaluate.cold_start_effect(scored_of(spark, sf_dir))


# ---- classifier reports ------------------------------------------------------------------------

@register("gated_predictions", _results("""SELECT event_id, pred_label, round(confidence, 6) AS confidence,
    round(attack_prob, 6) AS attack_prob, raw_label, round(raw_confidence, 6) AS raw_confidence FROM predicted"""))
def gated_predictions(spark, sf_dir):
    return results_of(spark, sf_dir).select(
        "event_id", "pred_label", F.round("confidence", 6).alias("confidence"),
        F.round("attack_prob", 6).alias("attack_prob"), "raw_label",
        F.round("raw_confidence", 6).alias("raw_confidence"))


@register("class_ranking", _results("""SELECT event_id, string_agg(cls, '>' ORDER BY p DESC, i) AS ranking
    FROM options GROUP BY 1"""))
def class_ranking(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in CLASSES])
    ranked = F.array_sort(F.transform("probs", lambda p, i: F.struct((-p).alias("np"), i.alias("i"))))
    order = F.transform(ranked, lambda s: F.element_at(names, s["i"] + 1))
    return results_of(spark, sf_dir).select("event_id", F.array_join(order, ">").alias("ranking"))


@register("confusion_matrix", _results("SELECT t.cls AS true_class, " + ", ".join(
    f"count(*) FILTER (pred_label = '{c}') AS pred_{c}" for c in CLASSES) +
    " FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in CLASSES) + "]) AS cls) t "
    "LEFT JOIN (SELECT * FROM results WHERE clf_split = 'test') x ON x.target = t.cls GROUP BY t.cls"))
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(results_of(spark, sf_dir).where("clf_split = 'test'"))


_REPORT = {
    "test": "SELECT * FROM results WHERE clf_split = 'test'",
    "per": """SELECT c AS class, count(*) FILTER (target = c) AS support, count(*) FILTER (pred_label = c) AS called,
        count(*) FILTER (target = c AND pred_label = c) AS tp
        FROM (SELECT DISTINCT target AS c FROM test UNION SELECT DISTINCT pred_label FROM test) CROSS JOIN test
        GROUP BY c""",
    "pr": """SELECT *, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS p,
        CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS rc FROM per""",
    "prf": "SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f FROM pr",
}


@register("classification_report", _on(o.results() | _REPORT, f"""
    SELECT class, {o.r('p', 3)} AS precision, {o.r('rc', 3)} AS recall, {o.r('f', 3)} AS f1, support FROM prf
    UNION ALL SELECT 'accuracy', {o.r('sum(tp) / sum(support)::DOUBLE', 3)}, {o.r('sum(tp) / sum(support)::DOUBLE', 3)},
      {o.r('sum(tp) / sum(support)::DOUBLE', 3)}, CAST(sum(support) AS BIGINT) FROM prf
    UNION ALL SELECT 'macro avg', {o.r('avg(p)', 3)}, {o.r('avg(rc)', 3)}, {o.r('avg(f)', 3)},
      CAST(sum(support) AS BIGINT) FROM prf
    UNION ALL SELECT 'weighted avg', {o.r('sum(p * support) / sum(support)::DOUBLE', 3)},
      {o.r('sum(rc * support) / sum(support)::DOUBLE', 3)}, {o.r('sum(f * support) / sum(support)::DOUBLE', 3)},
      CAST(sum(support) AS BIGINT) FROM prf"""))
def classification_report(spark, sf_dir):
    return evaluate.classification_report(results_of(spark, sf_dir).where("clf_split = 'test'"))


@register("false_alarm_rate", _results(f"""SELECT count(*) AS n_normal,
    {o.r("avg(CAST(pred_label <> 'normal' AS INT))", 6)} AS fp_rate
    FROM results WHERE clf_split = 'test' AND target = 'normal'"""))
def false_alarm_rate(spark, sf_dir):
    return evaluate.false_alarm_rate(results_of(spark, sf_dir).where("clf_split = 'test'"))


@register("recall_comparison", _on(o.results() | {
    "line": "SELECT quantile_cont(final_risk_score, 0.95) AS t FROM scored WHERE split = 'holdout_normal'",
    "layer": f"""SELECT attack_type, {o.r('avg(CAST(final_risk_score >= t AS INT))', 6)} AS anomaly_recall
        FROM scored CROSS JOIN line WHERE label = 'attack' GROUP BY 1"""},
    f"""SELECT target AS attack_type, count(*) AS n, {o.r('avg(CAST(pred_label = target AS INT))', 6)}
      AS classifier_recall, any_value(anomaly_recall) AS anomaly_recall
    FROM results r LEFT JOIN layer l ON l.attack_type = r.target
    WHERE clf_split = 'test' AND target <> 'normal' GROUP BY 1"""))
def recall_comparison(spark, sf_dir):
    return evaluate.recall_comparison(results_of(spark, sf_dir).where("clf_split = 'test'"), scored_of(spark, sf_dir))


@register("incident_rollup", _results(f"""
    SELECT attack_type, count(*) AS n_incidents, CAST(sum(c) AS BIGINT) AS n_events,
      {o.r('sum(h) / sum(c)::DOUBLE', 3)} AS row_level_recall, {o.r('avg(a)', 3)} AS incident_recall_any_attack,
      {o.r('avg(b)', 3)} AS incident_recall_correct_type
    FROM (SELECT target AS attack_type, attack_id, count(*) AS c, count(*) FILTER (pred_label = target) AS h,
            max(CAST(pred_label <> 'normal' AS INT)) AS a, max(CAST(pred_label = target AS INT)) AS b
          FROM results WHERE clf_split = 'test' AND target <> 'normal' GROUP BY ALL) GROUP BY 1"""))
def incident_rollup(spark, sf_dir):
    return evaluate.incident_rollup(results_of(spark, sf_dir).where("clf_split = 'test'"))


_RULES = {
    "val": "SELECT * FROM results WHERE clf_split = 'val'",
    "opts": """SELECT label, attack_type, 'mean' AS rule, 0 AS rule_order,
          (final_risk_score + classifier_attack_prob) / 2 AS u FROM val
        UNION ALL SELECT label, attack_type, 'max', 1, greatest(final_risk_score, classifier_attack_prob) FROM val""",
    "lines": "SELECT rule, quantile_cont(u, 0.95) AS t FROM opts WHERE label = 'normal' GROUP BY rule",
    "hits": "SELECT o.*, t, CAST(u >= t AS INT) AS hit FROM opts o JOIN lines USING (rule)",
    "fps": "SELECT rule, avg(hit) AS fp, any_value(t) AS t FROM hits WHERE label = 'normal' GROUP BY rule",
    "report": f"""SELECT h.rule, rule_order, coalesce(attack_type, 'overall') AS attack_type, count(*) AS n,
          {o.r('avg(hit)', 6)} AS recall, {o.r('any_value(f.fp)', 6)} AS fp_rate, {o.r('any_value(f.t)', 6)} AS threshold
        FROM hits h JOIN fps f USING (rule) WHERE label = 'attack'
        GROUP BY GROUPING SETS ((h.rule, rule_order, attack_type), (h.rule, rule_order))""",
}


@register("merge_rule_report", _on(o.results() | _RULES, "SELECT * FROM report"))
def merge_rule_report(spark, sf_dir):
    return evaluate.merge_rule_report(results_of(spark, sf_dir).where("clf_split = 'val'"))


@register("winning_rule", _on(o.results() | _RULES, """SELECT rule, recall FROM report
    WHERE attack_type = 'overall' ORDER BY recall DESC, rule_order LIMIT 1"""))
def winning_rule(spark, sf_dir):
    return evaluate.winning_rule(merge_rule_report(spark, sf_dir))


@register("review_sweep", _results("""SELECT CAST(t.threshold AS INT) AS threshold,
    count(*) FILTER (label = 'normal' AND final_risk_score >= t.threshold) AS noise,
    count(*) FILTER (label = 'attack' AND pred_label = 'normal' AND final_risk_score >= t.threshold) AS recovered
    FROM (SELECT unnest([90, 95, 97, 98, 99]) AS threshold) t CROSS JOIN results WHERE clf_split = 'val' GROUP BY 1"""))
def review_sweep(spark, sf_dir):
    return evaluate.review_sweep(results_of(spark, sf_dir).where("clf_split = 'val'"))


@register("review_summary", _results("""SELECT
    count(*) FILTER (secondary_review_flag AND clf_split = 'test') AS n_test,
    count(*) FILTER (secondary_review_flag AND clf_split = 'test' AND label = 'attack') AS n_test_attack,
    count(*) FILTER (secondary_review_flag AND clf_split = 'test' AND label <> 'attack') AS n_test_noise,
    count(*) FILTER (secondary_review_flag) AS n_all,
    count(*) FILTER (secondary_review_flag AND label = 'attack') AS n_all_attack FROM results"""))
def review_summary(spark, sf_dir):
    return evaluate.review_summary(results_of(spark, sf_dir))


_RESULT_COLUMNS = ["event_id", "clf_split", "predicted_attack_type", "classifier_confidence",
                   "classifier_attack_prob", "unified_risk_score", "secondary_review_flag"]


@register("merged_results_mean", _results(f"SELECT {_cols(_RESULT_COLUMNS)} FROM results"))
def merged_results_mean(spark, sf_dir):
    return results_of(spark, sf_dir).select(*_RESULT_COLUMNS)


@register("merged_results_max", _results(f"SELECT {_cols(_RESULT_COLUMNS)} FROM results", "max"))
def merged_results_max(spark, sf_dir):
    return scoring.merge_scores(results_of(spark, sf_dir), "max").select(*_RESULT_COLUMNS)


# ---- analyst queries ---------------------------------------------------------------------------

def _feed(where: str = "", limit: int = 300) -> str:
    return _results(f"""SELECT * EXCLUDE (ts), epoch_us(ts) AS us FROM (SELECT {_cols(alerts.FEED_COLUMNS)} FROM results
        WHERE unified_risk_score >= 50 {where} ORDER BY unified_risk_score DESC, event_id LIMIT {limit})""")


def _feed_out(df: DataFrame) -> DataFrame:
    return df.withColumn("us", F.unix_micros("ts")).drop("ts")


@register("alert_feed", _feed())
def alert_feed(spark, sf_dir):
    return _feed_out(alerts.alert_feed(results_of(spark, sf_dir)))


@register("alert_feed_filtered", _feed("AND predicted_attack_type = 'lateral_movement' AND clf_split = 'test'"))
def alert_feed_filtered(spark, sf_dir):
    return _feed_out(alerts.alert_feed(results_of(spark, sf_dir), attack_type="lateral_movement", split="test"))


@register("alert_feed_review", _feed("AND secondary_review_flag"))
def alert_feed_review(spark, sf_dir):
    return _feed_out(alerts.alert_feed(results_of(spark, sf_dir), review_only=True))


@register("alert_candidates", _results(f"""SELECT event_id, unified_risk_score,
    user_id || ' · ' || predicted_attack_type || ' · risk=' || printf('%.1f', {o.r('unified_risk_score', 1)}) AS alert
    FROM results WHERE predicted_attack_type IS NOT NULL ORDER BY unified_risk_score DESC, event_id LIMIT 200"""))
def alert_candidates(spark, sf_dir):
    return alerts.alert_candidates(results_of(spark, sf_dir))


@register("event_lookup", _results("SELECT event_id, user_id, unified_risk_score, predicted_attack_type "
          "FROM results WHERE event_id = 41"))
def event_lookup(spark, sf_dir):
    return alerts.event_lookup(results_of(spark, sf_dir), 41).select(
        "event_id", "user_id", "unified_risk_score", "predicted_attack_type")


@register("caught_examples", _results("""SELECT attack_type, event_id, classifier_confidence FROM results
    WHERE clf_split = 'test' AND attack_type = predicted_attack_type
    QUALIFY row_number() OVER (PARTITION BY attack_type ORDER BY ts, event_id) = 1"""))
def caught_examples(spark, sf_dir):
    return alerts.caught_examples(results_of(spark, sf_dir)).drop("ts")


@register("seeded_sample", _results("""SELECT event_id FROM results WHERE clf_split = 'test'
    ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 200"""))
def seeded_sample(spark, sf_dir):
    return alerts.seeded_sample(results_of(spark, sf_dir).where("clf_split = 'test'").select("event_id"))


@register("predicted_types", _results("SELECT DISTINCT predicted_attack_type FROM results "
          "WHERE predicted_attack_type IS NOT NULL"))
def predicted_types(spark, sf_dir):
    return alerts.distinct_sorted(results_of(spark, sf_dir), "predicted_attack_type")


@register("entity_list", _access("SELECT DISTINCT user_id FROM access"))
def entity_list(spark, sf_dir):
    return alerts.distinct_sorted(access_events(spark, sf_dir), "user_id")


@register("entity_timeline", _results("""SELECT user_id, epoch_us(ts) AS us, event_id, unified_risk_score,
    label = 'attack' AS is_true_attack, predicted_attack_type IS NOT NULL AS is_flagged FROM results"""))
def entity_timeline(spark, sf_dir):
    return _feed_out(alerts.entity_timeline(results_of(spark, sf_dir)))


@register("entity_timeline_user", _results("""SELECT user_id, epoch_us(ts) AS us, event_id, unified_risk_score,
    label = 'attack' AS is_true_attack, predicted_attack_type IS NOT NULL AS is_flagged FROM results
    WHERE user_id = 7"""))
def entity_timeline_user(spark, sf_dir):
    return _feed_out(alerts.entity_timeline(results_of(spark, sf_dir), 7))


@register("entity_summary", _results("""SELECT user_id, count(*) AS n_events, count(*) FILTER (label = 'attack') AS n_true_attacks,
    count(*) FILTER (predicted_attack_type IS NOT NULL) AS n_flagged FROM results GROUP BY 1"""))
def entity_summary(spark, sf_dir):
    return alerts.entity_summary(results_of(spark, sf_dir))


@register("feature_values", _features("SELECT event_id, feature, value FROM (SELECT event_id, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES) + f" FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN ({_cols(FEATURES)}))"))
def feature_values(spark, sf_dir):
    return alerts.feature_values(features_of(spark, sf_dir), ["event_id"])


@register("feature_families", _features("SELECT family, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, CASE feature "
          + " ".join(f"WHEN '{f}' THEN '{g}'" for f, g in SIGNAL_FAMILY.items())
          + " END AS family FROM (SELECT " + ", ".join(f"{o.strength(c)} AS {c}" for c in FEATURES)
          + f" FROM features) UNPIVOT INCLUDE NULLS (value FOR feature IN ({_cols(FEATURES)}))) GROUP BY family"))
def feature_families(spark, sf_dir):
    """Total strength per signal family."""
    df = features_of(spark, sf_dir).select("event_id", *[fallback_strength(c).alias(c) for c in FEATURES])
    long = alerts.feature_values(df, ["event_id"]).withColumn("family", alerts.family_of(F.col("feature")))
    return long.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _breakdown_sql() -> str:
    fam = {g: " + ".join(["0.0::DOUBLE"] + [o.strength(f) for f in FEATURES if SIGNAL_FAMILY[f] == g]) for g in FAMILIES}
    sums = ", ".join(f'{v} AS s_{g}' for g, v in fam.items())
    total = " + ".join(["0.0::DOUBLE"] + [f"s_{g}" for g in FAMILIES])
    outs = ", ".join(o.r(f"100 * s_{g} / t", 1) + f' AS "{g}"' for g in FAMILIES)
    return _features(f"SELECT event_id, {outs} FROM (SELECT *, CASE WHEN {total} = 0 THEN 1e-9 ELSE {total} END AS t "
                     f"FROM (SELECT event_id, {sums} FROM features))")


@register("signal_breakdown", _breakdown_sql())
def signal_breakdown(spark, sf_dir):
    return alerts.fallback_breakdown(features_of(spark, sf_dir))


def _sentence_sql() -> str:
    one = "printf('%.1f', " + o.r("value", 1) + ")"
    km = "format('{:,}', CAST(" + o.r("value", 0) + " AS BIGINT))"
    n = "CAST(CAST(value AS BIGINT) AS VARCHAR)"

    def flag(yes: str, no: str) -> str:
        return "CASE WHEN value >= 1 THEN '" + yes.replace("'", "''") + "' ELSE '" + no.replace("'", "''") + "' END"

    text = {
        "hour_zscore": f"'login timing is ' || {one} || ' standard deviations from this user''s typical hours'",
        "geo_distance_km": f"{km} || ' km from the previous login''s location'",
        "geo_velocity_kmh": f"'implied travel speed of ' || {km} || ' km/h between consecutive logins'",
        "time_since_last_event_min": f"'only ' || {one} || ' minutes since this user''s last activity'",
        "is_new_device": flag("device never seen for this user before", "device this user has used before"),
        "fingerprint_mismatch": flag("device's OS/browser/screen fingerprint doesn't match its known history",
                                     "device fingerprint matches its known history"),
        "is_new_host": flag("host never accessed by this user before", "host this user has accessed before"),
        "is_foreign_dept": flag("host belongs to a department outside the user's home department",
                                "host is within the user's home department (or shared infrastructure)"),
        "is_first_time_in_this_dept": flag("user's first-ever access to this specific department",
                                           "user has accessed this department before"),
        "foreign_dept_burst_distinct": f"{n} || ' distinct foreign departments touched in the last 15 minutes'",
        "new_host_burst_count": f"{n} || ' never-before-seen hosts touched in the last 15 minutes'",
        "graph_dist_from_history": f"CASE WHEN value > 0 THEN 'this host is ' || {n} || ' network hop(s) from anywhere "
                                   "this user has been before' ELSE 'this host is directly adjacent to (or is) somewhere "
                                   "this user has been before' END",
        "failure_burst_count": f"{n} || ' failed login attempts in the last 5 minutes'",
    }
    cases = " ".join(f"WHEN '{f}' THEN {s}" for f, s in text.items())
    return f"CASE feature {cases} END"


_EFFECT = "strength * 2 - 0.5"


def _factor_ctes() -> dict[str, str]:
    return o.results() | {
        "vals": "SELECT event_id, feature, value FROM (SELECT event_id, " + ", ".join(
            f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
            + f" FROM results WHERE predicted_attack_type IS NOT NULL) UNPIVOT (value FOR feature IN ({_cols(FEATURES)}))",
        "strs": "SELECT event_id, feature, strength FROM (SELECT event_id, " + ", ".join(
            f"{o.strength(c)} AS {c}" for c in FEATURES)
            + f" FROM results WHERE predicted_attack_type IS NOT NULL) UNPIVOT (strength FOR feature IN ({_cols(FEATURES)}))",
        "effects": f"""SELECT v.*, floor(({_EFFECT}) * 10000 + 0.500001) / 10000.0::DOUBLE AS effect, predicted_attack_type AS pred
            FROM vals v JOIN strs USING (event_id, feature) JOIN results USING (event_id)""",
        "said": f"""SELECT *, {_sentence_sql()} || ' (' || CASE WHEN abs(effect) > 1.0 THEN 'strongly'
            WHEN abs(effect) > 0.3 THEN 'moderately' ELSE 'slightly' END || CASE WHEN effect > 0
            THEN ' increased suspicion' ELSE ' reduced suspicion' END || ' of ' || pred || ')' AS sentence FROM effects""",
    }


def _rule_effects(spark, sf_dir) -> DataFrame:
    """Long (event_id, predicted_label, feature, value, shap_value) with a rule in place of attributions."""
    hits = results_of(spark, sf_dir).where("predicted_attack_type is not null")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 scalars.round_to(fallback_strength(f) * 2 - 0.5, 4).alias("shap_value"))
        for f in FEATURES])).alias("x")
    return hits.select("event_id", F.col("predicted_attack_type").alias("predicted_label"), pairs).select(
        "event_id", "predicted_label", "x.*").where("value is not null")


@register("factor_sentences", _on(_factor_ctes(), "SELECT event_id, feature, value, effect, sentence FROM said"))
def factor_sentences(spark, sf_dir):
    return _rule_effects(spark, sf_dir).select(
        "event_id", "feature", "value", F.col("shap_value").alias("effect"),
        full_sentence(F.col("feature"), F.col("value"), F.col("shap_value"), F.col("predicted_label")).alias("sentence"))


@register("top_factors", _on(_factor_ctes(), """SELECT event_id, pred AS predicted_label,
    string_agg(sentence, ' | ' ORDER BY rk) AS sentences FROM (SELECT *, row_number() OVER
      (PARTITION BY event_id ORDER BY abs(effect) DESC, feature) AS rk FROM said) WHERE rk <= 3 GROUP BY 1, 2"""))
def top_factors(spark, sf_dir):
    top = alerts.top_factors(_rule_effects(spark, sf_dir))
    return top.select("event_id", "predicted_label",
                      F.array_join(F.transform("factors", lambda f: f["sentence"]), " | ").alias("sentences"))


@register("flagged_travel", _results("""SELECT event_id, user_id, unified_risk_score, a.geo_lat, a.geo_lon, a.geo_city, a.geo_country
    FROM results LEFT JOIN (SELECT event_id, geo_lat, geo_lon, geo_city, geo_country FROM access) a USING (event_id)
    WHERE CASE WHEN (SELECT count(*) FROM results WHERE predicted_attack_type = 'impossible_travel') > 0
      THEN predicted_attack_type = 'impossible_travel' ELSE attack_type = 'impossible_travel' END"""))
def flagged_travel(spark, sf_dir):
    rows = alerts.with_location(alerts.flagged_travel(results_of(spark, sf_dir)), access_events(spark, sf_dir))
    return rows.select("event_id", "user_id", "unified_risk_score", "geo_lat", "geo_lon", "geo_city", "geo_country")


@register("lateral_users", _results("""SELECT DISTINCT user_id FROM results
    WHERE predicted_attack_type = 'lateral_movement' OR attack_type = 'lateral_movement'"""))
def lateral_users(spark, sf_dir):
    return alerts.lateral_users(results_of(spark, sf_dir))


# ---- drift -------------------------------------------------------------------------------------

# First day on which a user's hour deviation is large: stands in for the detector in SQL.
_FIRES = {
    "days": """SELECT f.*, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM features)) / 86400000000.0) AS INT)
        AS day FROM features f""",
    "fires": """SELECT user_id, min(day) AS day FROM days WHERE label = 'normal' AND hour_zscore >= 2.0
        AND user_id % 14 <> 13 GROUP BY 1""",
    "active": "SELECT DISTINCT user_id, drift_group FROM access WHERE NOT is_cold_start",
    "visible": f"""SELECT d.day, count(*) AS n_drifted_in_window, count(*) / (SELECT count(*) FROM active)::DOUBLE AS share
        FROM (SELECT unnest(range(0, (SELECT max(day) FROM fires) + 1)) AS day) d
        JOIN fires f ON f.day BETWEEN d.day - {DriftConfig().window_days} AND d.day GROUP BY 1""",
    "val": """SELECT count(*) FILTER (drift_group AND day IS NOT NULL) AS tp, count(*) FILTER (NOT drift_group AND day IS NOT NULL) AS fp,
        count(*) FILTER (drift_group AND day IS NULL) AS fn, count(*) FILTER (NOT drift_group AND day IS NULL) AS tn,
        CAST(min(CASE WHEN drift_group THEN day - 20 END) AS INT) AS lag_min,
        CAST(max(CASE WHEN drift_group THEN day - 20 END) AS INT) AS lag_max,
        avg(CASE WHEN drift_group THEN day - 20 END) AS lag_avg FROM active LEFT JOIN fires USING (user_id)""",
}


def _rule_fires(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    users = entities_of(spark, sf_dir).users
    days = drift.with_day(features_of(spark, sf_dir))
    hits = days.where("label = 'normal' and hour_zscore >= 2.0").join(
        drift.active_users(users), "user_id", "left_semi")
    return drift.first_fires(hits), users


@register("first_fires", _on(o.features() | _FIRES, "SELECT user_id, day FROM fires"))
def first_fires(spark, sf_dir):
    return _rule_fires(spark, sf_dir)[0]


@register("population_alerts", _on(o.features() | _FIRES, f"""SELECT CAST(day AS INT) AS day, n_drifted_in_window,
    {o.r('share', 3)} AS fraction FROM visible WHERE share >= 0.15"""))
def population_alerts(spark, sf_dir):
    first, users = _rule_fires(spark, sf_dir)
    return drift.population_alerts(first, drift.active_users(users).count())


@register("drift_validation", _on(o.features() | _FIRES,
          f"SELECT tp, fp, fn, tn, lag_min, lag_max, {o.r('lag_avg', 4)} AS lag_mean FROM val"))
def drift_validation(spark, sf_dir):
    first, users = _rule_fires(spark, sf_dir)
    return drift.drift_validation(first, users, 20)


@register("drift_rates", _on(o.features() | _FIRES, f"""SELECT {o.r('tp / greatest(tp + fn, 1)::DOUBLE', 6)} AS recall,
    {o.r('fp / greatest(fp + tn, 1)::DOUBLE', 6)} AS false_alarm_rate FROM val"""))
def drift_rates(spark, sf_dir):
    return drift.drift_rates(drift_validation(spark, sf_dir))


@register("earliest_drifted", _on(o.features() | _FIRES, "SELECT user_id, day FROM fires ORDER BY day, user_id LIMIT 10"))
def earliest_drifted(spark, sf_dir):
    return drift.earliest_drifted(first_fires(spark, sf_dir))


@register("health_status", _on(o.features() | _FIRES, """SELECT
    (SELECT count(DISTINCT user_id) FROM access WHERE is_cold_start) AS n_cold_start,
    (SELECT count(*) FROM fires) AS n_drifted,
    CASE WHEN (SELECT count(*) FROM visible WHERE share >= 0.15) > 0 THEN 'DRIFT ALERT' ELSE 'Stable' END AS status"""))
def health_status(spark, sf_dir):
    first, users = _rule_fires(spark, sf_dir)
    return alerts.status_counts(results_of(spark, sf_dir), users, first, population_alerts(spark, sf_dir))


@register("drift_scan")
def drift_scan(spark, sf_dir):
    return drift.drift_scan(features_of(spark, sf_dir), entities_of(spark, sf_dir).users)


@register("drift_scan_depth")
def drift_scan_depth(spark, sf_dir):
    """The same detector on a column that does drift in the test tables: the days of history."""
    return drift.drift_scan(features_of(spark, sf_dir), entities_of(spark, sf_dir).users,
                            DriftConfig(feature="entity_history_days"))


# ---- trained models (the forest is grown again in SQL; the others give rows only) --------------------------------

def _ready(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Filled features, and the training normals among them."""
    df = scored_of(spark, sf_dir)
    df = with_fill(df, fill_medians(df.where("split = 'train_normal'")))
    return df, df.where("split = 'train_normal'")


@register("isolation_scores", _on(o.scored() | o.isolation(), f"""SELECT event_id, split,
    {o.r(f"pow(2.0::DOUBLE, -total / trees / {expected_depth(256)!r}::DOUBLE)", 6)} AS iso_raw FROM iso_walk"""))
def isolation_scores(spark, sf_dir):
    """Scores of the trained forest; SQL grows the same 300 trees from the feature table."""
    df, train = _ready(spark, sf_dir)
    return df.select("event_id", "split", scalars.round_to(forest_score(cut(train_forest(train))), 6).alias("iso_raw"))


@register("autoencoder_scores")
def autoencoder_scores(spark, sf_dir):
    df, train = _ready(spark, sf_dir)
    return df.select("event_id", "split", network_score(train_autoencoder(train, rounds=2000)).alias("ae_raw"))


@register("linear_reconstruction_scores")
def linear_reconstruction_scores(spark, sf_dir):
    df, train = _ready(spark, sf_dir)
    return linear_score(df, train).select("event_id", "split", "linear_raw")


def _train_split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = results_of(spark, sf_dir)
    df = with_fill(df, fill_medians(df.where("clf_split = 'train'")))
    return df, df.where("clf_split = 'train'")


@register("oversampled_classes", _on(o.results() | {
    "c": "SELECT target, count(*) AS n FROM targets WHERE clf_split = 'train' GROUP BY 1"},
    """SELECT target, (SELECT max(n) FROM c) AS n, (SELECT max(n) FROM c) - n AS n_synthetic FROM c"""))
def oversampled_classes(spark, sf_dir):
    """Class sizes after oversampling."""
    _, train = _train_split(spark, sf_dir)
    return smote(train).groupBy("target").agg(F.count(F.lit(1)).alias("n"),
                                              F.count_if("synthetic").alias("n_synthetic"))


_models: dict[tuple, object] = {}


def _boosted(spark, sf_dir):
    """The classifier of the training job (oversampled, 300 rounds) and its predictions: made once per session and data folder."""
    df, _ = _train_split(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        model = fit_classifier(df)
        plain = df.drop("probs", "pred_label", "confidence", "attack_prob", "raw_label", "raw_confidence")
        _models[key] = model, cut(predict(plain, model).select(
            "event_id", "clf_split", "target", "pred_label", "confidence", "attack_prob", *FEATURES))
    return _models[key]


def trained_classifier(spark, sf_dir):
    return _boosted(spark, sf_dir)[0]


@register("boosted_predictions")
def boosted_predictions(spark, sf_dir):
    return _boosted(spark, sf_dir)[1].drop(*FEATURES)


@register("forest_predictions")
def forest_predictions(spark, sf_dir):
    df, train = _train_split(spark, sf_dir)
    plain = df.drop("probs", "pred_label", "confidence", "attack_prob", "raw_label", "raw_confidence")
    balanced = cut(smote(train.select("target", *FEATURES)))
    out = scoring.gate_classes(random_forest_scores(balanced, plain))
    return out.select("event_id", "clf_split", "target", "pred_label", "confidence", "attack_prob")


@register("alert_attributions")
def alert_attributions(spark, sf_dir):
    model, scored = _boosted(spark, sf_dir)
    return attributions(scored.where("pred_label <> 'normal'"), model.boosted)


@register("alert_explanations")
def alert_explanations(spark, sf_dir):
    long = cut(alert_attributions(spark, sf_dir))
    return alerts.top_factors(long).join(alerts.attribution_breakdown(long), "event_id")
