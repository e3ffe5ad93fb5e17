"""Registered queries of the sources, sinks and stream jobs: each writes what it derives from the given
tables to the shared folder, reads it back through the library's readers, and is compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.config import DriftConfig
from wardline.operators import drift
from wardline.operators.alerts import alert_feed
from wardline.operators.causal import add_dept_prior, enrich
from wardline.operators.reference import by_grids, score_grids
from wardline.operators.skew import union_all
from wardline.operators.scoring import blend_cold_start, population_reference, tag_training_split
from wardline.plans import oracles as o
from wardline.plans.queries import ORACLES, QUERIES, register, trained_classifier
from wardline.plans.results import (
    TEST_CONFIG, entities_of, features_of, kept, results_of, rule_scores, scored_of,
)
from wardline.plans.training import fit_anomaly, save_anomaly, save_classifier, save_rule, score_published
from wardline.session import checkpoint_dir, cut
from wardline.sources import logs
from wardline.sources.entities import read_entities
from wardline.sources.events import access_events
from wardline.sources.versions import publish
from wardline.streaming import stateful, stateless

NEW_DAY = 25
MADE = ["pred_label", "confidence", "attack_prob", "predicted_attack_type", "classifier_confidence",
        "classifier_attack_prob", "unified_risk_score", "secondary_review_flag"]
LOG_COLUMNS = [f.name for f in logs.EVENT_SCHEMA.fields]
LOG_SQL = ("SELECT " + ", ".join(
    "ts" if c == "timestamp" else "CAST(NULL AS VARCHAR) AS source_ip" if c == "source_ip" else
    c if c in ("geo_lat", "geo_lon") else f"CAST({c} AS VARCHAR) AS {c}" for c in LOG_COLUMNS) + " FROM access")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/exchange-{uuid.uuid4().hex}"


def _write_log(spark: SparkSession, sf_dir: str, columns: list[str]) -> str:
    path = _folder(spark)
    log = access_events(spark, sf_dir).withColumnRenamed("ts", "timestamp").withColumn("source_ip", F.lit(None).cast("string"))
    (log.select(*columns).write.option("header", True).option("escape", '"')
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    return path


@register("event_csv_scan", o.sql(o.access(), LOG_SQL))
def event_csv_scan(spark, sf_dir):
    """The log written as CSV with its columns in another order, read by its header."""
    return logs.read_event_csv(spark, _write_log(spark, sf_dir, LOG_COLUMNS[::-1]))


@register("event_csv_stream", o.sql(o.access(), LOG_SQL))
def event_csv_stream(spark, sf_dir):
    """The log as a stream of CSV files, run until all is read."""
    return _finished(spark, logs.stream_event_csv(spark, _write_log(spark, sf_dir, LOG_COLUMNS)))


@register("feature_table_scan", o.sql(o.features(), "SELECT * FROM features"))
def feature_table_scan(spark, sf_dir):
    """The feature sink by day, and its scan."""
    path, features = _folder(spark), features_of(spark, sf_dir)
    logs.write_table(features, path, by_day=True)
    return logs.read_table(spark, path, features.columns)


@register("scored_table_scan", o.sql(o.scored(), f"SELECT {', '.join(logs.SCORED_COLUMNS)} FROM scored"))
def scored_table_scan(spark, sf_dir):
    """The scored sink by day, and its scan."""
    path = _folder(spark)
    logs.write_scored(scored_of(spark, sf_dir), path)
    return logs.read_table(spark, path, logs.SCORED_COLUMNS)


@register("result_table_scan", o.sql(o.results(), """SELECT event_id, predicted_attack_type, classifier_confidence,
    classifier_attack_prob, unified_risk_score, secondary_review_flag FROM results"""))
def result_table_scan(spark, sf_dir):
    """The result sink, and a scan of some of its columns."""
    path = _folder(spark)
    logs.write_table(results_of(spark, sf_dir), path)
    return logs.read_table(spark, path, ["event_id", *MADE[3:]])


@register("drift_log_scan", ORACLES["population_alerts"])
def drift_log_scan(spark, sf_dir):
    """The alerts of the drift log (one per day at most) written as its JSON document, and the scan of it."""
    path = _folder(spark)
    alerts = QUERIES["population_alerts"](spark, sf_dir)
    doc = alerts.agg(F.collect_list(F.struct("day", "n_drifted_in_window", "fraction")).alias("population_alerts"))
    doc.coalesce(1).write.json(path)
    return logs.drift_log_alerts(logs.read_drift_log(spark, path))


@register("drift_tables_scan", ORACLES["first_fires"])
def drift_tables_scan(spark, sf_dir):
    """The drift sink, and the scan of its per-entity table."""
    path = _folder(spark)
    logs.write_drift_tables(path, QUERIES["first_fires"](spark, sf_dir), QUERIES["population_alerts"](spark, sf_dir),
                            QUERIES["drift_validation"](spark, sf_dir))
    return logs.read_table(spark, f"{path}/first_fires")


def _new_day_sql() -> str:
    grid = """SELECT DISTINCT {raw} AS v, {p} AS p FROM (SELECT {raw}, 100.0::DOUBLE * count(*) OVER (ORDER BY {raw})
        / count(*) OVER () AS share FROM dayed WHERE day < {day} AND split = 'train_normal')"""
    ctes = {k: v for k, v in o.scored().items() if k not in ("ref_size", "rank1", "rank2", "ens", "dept_ref", "global_ref", "scored")}
    ctes |= {
        "dayed": """SELECT *, floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM tagged)) / 86400000000.0) AS day FROM tagged""",
        "grid1": grid.format(raw="iso_raw", p=o.r("share", 2), day=NEW_DAY),
        "grid2": grid.format(raw="ae_raw", p=o.r("share", 2), day=NEW_DAY),
        "placed1": "SELECT d.*, coalesce(g.p, 0) AS p1 FROM dayed d ASOF LEFT JOIN grid1 g ON d.iso_raw >= g.v",
        "placed2": "SELECT d.*, coalesce(g.p, 0) AS p2 FROM placed1 d ASOF LEFT JOIN grid2 g ON d.ae_raw >= g.v",
        "ens": f"SELECT *, {o.r('(p1 + p2) / 2', 2)} AS e FROM placed2",
        "old": f"SELECT * FROM ens WHERE day < {NEW_DAY} AND split = 'train_normal' AND is_cold_start_entity = 0",
        "dept_ref": "SELECT dept, quantile_cont(e, 0.5) AS ref_score FROM old GROUP BY dept",
        "global_ref": "SELECT quantile_cont(e, 0.5) AS general FROM old",
    }
    blend = o.r("""least(greatest(cold_start_blend_weight * e + (1 - cold_start_blend_weight)
        * coalesce(ref_score, general), 0.0), 100.0)""", 2)
    return o.sql(ctes, f"""SELECT event_id, p1 AS iso_forest_score, p2 AS autoencoder_score, e AS ensemble_score_raw,
        {blend} AS final_risk_score FROM ens LEFT JOIN dept_ref USING (dept) CROSS JOIN global_ref WHERE day >= {NEW_DAY}""")


@register("scored_new_day", _new_day_sql())
def scored_new_day(spark, sf_dir):
    """Rows of new days scored by the references of the days before, which are written and read back."""
    path = _folder(spark)
    days = drift.with_day(tag_training_split(rule_scores(features_of(spark, sf_dir))))
    train = kept(spark, "before the new day", sf_dir, lambda: days.where(f"day < {NEW_DAY} and split = 'train_normal'"))
    logs.write_table(score_grids(train), f"{path}/grids")
    grids = spark.read.parquet(f"{path}/grids")
    logs.write_table(population_reference(by_grids(train, grids), train_only=True), f"{path}/medians")
    new = blend_cold_start(by_grids(days.where(f"day >= {NEW_DAY}"), grids), spark.read.parquet(f"{path}/medians"))
    return new.select("event_id", "iso_forest_score", "autoencoder_score", "ensemble_score_raw", "final_risk_score")


@register("missing_input", o.sql(o.features(), """SELECT 'features' AS input, true AS present, count(*) AS n FROM features
    UNION ALL SELECT 'results', false, CAST(NULL AS BIGINT)"""))
def missing_input(spark, sf_dir):
    """A table that has been written, and one that has not been yet: the latter is no error."""
    path = _folder(spark)
    logs.write_table(features_of(spark, sf_dir), f"{path}/features")
    found = {name: logs.read_or_none(logs.read_table, spark, f"{path}/{name}") for name in ("features", "results")}
    none = spark.range(1).select(F.lit(None).cast("long").alias("n"))
    return union_all([(none if df is None else df.agg(F.count(F.lit(1)).alias("n"))).select(
        F.lit(name).alias("input"), F.lit(df is not None).alias("present"), "n") for name, df in found.items()])


def _write_document(spark: SparkSession, sf_dir: str) -> str:
    """The entities as the one nested JSON document that other systems hand over; its format makes it one row."""
    path, ent = _folder(spark), entities_of(spark, sf_dir)

    def text(c):
        return F.col(c).cast("string")

    def as_map(df, key, value):
        return df.agg(F.map_from_entries(F.collect_list(F.struct(text(key).alias("key"), value.alias("value")))))

    homes = ent.normal_hosts.groupBy("user_id").agg(F.collect_set(text("host")).alias("normal_hosts"))
    parts = {
        "users": as_map(ent.users.join(homes, "user_id", "left"), "user_id",
                        F.struct("dept", "drift_group", "is_cold_start", "normal_hosts")),
        "devices": as_map(ent.devices, "device_id", F.struct(F.struct("os", "browser", "screen").alias("fingerprint"))),
        "dept_hosts": as_map(ent.hosts.where("owner_dept <> 'shared'").groupBy("owner_dept").agg(
            F.collect_list(text("host")).alias("hosts")), "owner_dept", F.col("hosts")),
        "shared_hosts": ent.hosts.where("owner_dept = 'shared'").agg(F.collect_list(text("host"))),
        "graph_edges": ent.edges.agg(F.collect_list(F.array(text("src"), text("dst"), F.to_json(F.struct("kind"))))),
    }
    doc = spark.range(1).select()
    for name, part in parts.items():
        doc = doc.crossJoin(part.toDF(name))  # one row each
    doc.coalesce(1).write.json(path)
    return path


@register("entity_document_scan", o.sql(o.access() | o.edges(), """
    SELECT DISTINCT 'user' AS part, CAST(user_id AS VARCHAR) AS id, dept || '|' || drift_group || '|' || is_cold_start AS body FROM access
    UNION ALL SELECT DISTINCT 'host', CAST(host AS VARCHAR), owner_dept FROM access
    UNION ALL SELECT DISTINCT 'device', CAST(device_id AS VARCHAR),
        'os' || device_id % 5 || '|br' || device_id % 4 || '|sc' || device_id % 4 FROM access WHERE device_id >= 0
    UNION ALL SELECT 'edge', CAST(src AS VARCHAR), dst || '|' || kind FROM one_way
    UNION ALL SELECT DISTINCT 'normal host', CAST(user_id AS VARCHAR), CAST(g * 18 + i AS VARCHAR)
        FROM (SELECT DISTINCT user_id, CAST(substr(dept, 2) AS INT) AS g FROM access), range(9) r(i)"""))
def entity_document_scan(spark, sf_dir):
    """The nested entity document, written, read and laid out as dimension tables."""
    ent = read_entities(spark, _write_document(spark, sf_dir))

    def rows(df, part, key, *body):
        return df.select(F.lit(part).alias("part"), F.col(key).alias("id"),
                         F.concat_ws("|", *[F.col(c).cast("string") for c in body]).alias("body"))

    return union_all([
        rows(ent.users, "user", "user_id", "dept", "drift_group", "is_cold_start"), rows(ent.hosts, "host", "host", "owner_dept"),
        rows(ent.devices, "device", "device_id", "os", "browser", "screen"), rows(ent.edges, "edge", "src", "dst", "kind"),
        rows(ent.normal_hosts, "normal host", "user_id", "host")])


@register("published_alert_feed")
def published_alert_feed(spark, sf_dir):
    """The whole chain on trained models: features, both layers, version written and published, current version
    loaded, every row scored, gated and merged, alert feed. The classifier is that of ``boosted_predictions``."""
    folder, features = _folder(spark), features_of(spark, sf_dir)
    anomaly = fit_anomaly(cut(tag_training_split(features)))
    save_anomaly(anomaly, f"{folder}/v1/anomaly", spark)
    save_classifier(trained_classifier(spark, sf_dir), f"{folder}/v1/classifier")
    save_rule("mean", f"{folder}/v1", spark)
    publish(spark, folder, "v1")
    return alert_feed(score_published(features, folder))


# ---- streams -----------------------------------------------------------------------------------

def _finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = _folder(spark)
    stateless.run_available(stream, folder, "out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _as_stream(spark: SparkSession, df: DataFrame, closing: bool = False) -> DataFrame:
    """``df`` as a stream of files; ``closing`` appends a row far ahead, which moves the watermark past all others."""
    path = _folder(spark)
    df.repartition(4, F.xxhash64("event_id")).write.parquet(path)
    if closing:
        last = df.limit(1).withColumns({"ts": F.lit("2099-01-01").cast("timestamp"),
                                        "event_id": F.lit(-1).cast(df.schema["event_id"].dataType)})
        last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@register("stream_alert_feed", o.sql(o.results(), """SELECT event_id, unified_risk_score, predicted_attack_type FROM results
    WHERE unified_risk_score >= 50"""))
def stream_alert_feed(spark, sf_dir):
    feed = stateless.online_alerts(_as_stream(spark, results_of(spark, sf_dir).drop(*MADE)))
    return _finished(spark, feed).select("event_id", "unified_risk_score", "predicted_attack_type")


@register("stream_fingerprint_mismatch", o.sql(o.features(), "SELECT event_id, fingerprint_mismatch FROM features"))
def stream_fingerprint_mismatch(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ent = entities_of(spark, sf_dir)
    events = enrich(access_events(spark, sf_dir), ent.users, ent.hosts, ent.devices, TEST_CONFIG)
    source = _as_stream(spark, events.select("device_id", "event_id", "ts", "fp"), closing=True)
    found = _finished(spark, stateful.fingerprint_mismatch(source, "365 days"))
    return found.where("event_id >= 0").select("event_id", "fingerprint_mismatch")


USER_COLUMNS = ["event_id", *[c.split()[0] for c in stateful.USER_OUTPUT.split(", ")]]


@register("stream_user_features", o.sql(o.features(), f"SELECT {', '.join(USER_COLUMNS)} FROM features"))
def stream_user_features(spark, sf_dir):
    """User features and bursts online, on events that carry the hour prior of their department."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ent = entities_of(spark, sf_dir)
    events = enrich(access_events(spark, sf_dir), ent.users, ent.hosts, ent.devices, TEST_CONFIG)
    ready = add_dept_prior(events, TEST_CONFIG).select("user_id", "ts", *[c for c in stateful.USER_INPUT if c != "us"])
    found = _finished(spark, stateful.user_features(_as_stream(spark, ready, closing=True), "365 days", TEST_CONFIG))
    return found.where("event_id >= 0").select(*USER_COLUMNS)


@register("stream_population_alerts", o.sql(o.features() | {
    "fired": """SELECT user_id, min(ts) AS ts FROM features WHERE label = 'normal' AND hour_zscore >= 2.0
        AND user_id % 14 <> 13 GROUP BY 1""",
    "active": "SELECT count(DISTINCT user_id) AS n FROM access WHERE NOT is_cold_start",
    "spans": """SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 8 DAY, max(ts), INTERVAL 1 DAY)) AS s
        FROM fired""",
    "seen": """SELECT s, count(*) AS c FROM spans JOIN fired ON ts >= s AND ts < s + INTERVAL 8 DAY GROUP BY s"""},
    f"""SELECT s AS start, s + INTERVAL 8 DAY AS "end", c AS n_drifted_in_window, {o.r('c / n::DOUBLE', 3)} AS fraction
    FROM seen, active WHERE c / n::DOUBLE >= 0.15"""))
def stream_population_alerts(spark, sf_dir):
    """Sliding windows over the stream of first fires (of the rule of ``first_fires``)."""
    users = drift.active_users(entities_of(spark, sf_dir).users)
    fires = (features_of(spark, sf_dir).where("label = 'normal' and hour_zscore >= 2.0").join(users, "user_id", "left_semi")
             .groupBy("user_id").agg(F.min("ts").alias("ts")).withColumnRenamed("user_id", "event_id"))
    return _finished(spark, stateless.population_alert_windows(_as_stream(spark, fires, closing=True), users.count(), "365 days"))


@register("stream_drift_fires")
def stream_drift_fires(spark, sf_dir):
    """The online detector on the days of history, a column that drifts in every table; held against the batch scan in tests."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cfg = DriftConfig(feature="entity_history_days")
    rows = features_of(spark, sf_dir).join(drift.active_users(entities_of(spark, sf_dir).users), "user_id", "left_semi")
    source = _as_stream(spark, rows.select("user_id", "event_id", "ts", "label", cfg.feature), closing=True)
    return _finished(spark, stateful.drift_fires(source, "365 days", cfg))
