"""Stream jobs without custom state: population alerts, the alert feed, late rows, sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.config import DriftConfig
from wardline.operators.alerts import FEED_COLUMNS
from wardline.operators.scoring import gate_classes, merge_scores
from wardline.sources.versions import versions


def population_alert_windows(first_fires: DataFrame, n_entities: int, delay: str = "1 day",
                             cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Sliding windows of window_days + 1 days, one per day, in which enough entities fired first."""
    span = f"{cfg.window_days + 1} days"
    counts = (first_fires.withWatermark("ts", delay).groupBy(F.window("ts", span, "1 day"))
              .agg(F.count(F.lit(1)).alias("n_drifted_in_window")))
    share = F.col("n_drifted_in_window") / float(n_entities)
    return counts.where(share >= cfg.alert_fraction).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_drifted_in_window",
        F.round(share, 3).alias("fraction"))


def online_alerts(scored: DataFrame, rule: str = "mean", min_risk: float = 50) -> DataFrame:
    """Gate, merge and risk filter on a stream of scored rows with class probabilities."""
    merged = merge_scores(gate_classes(scored), rule)
    return merged.where(F.col("unified_risk_score") >= min_risk).select(
        *[c for c in FEED_COLUMNS if c in merged.columns])


def late_events(batch: DataFrame, watermark_us: int) -> DataFrame:
    """Rows of a micro-batch that are behind a watermark: for a side table in ``foreachBatch``."""
    return batch.where(F.unix_micros(F.col("ts").cast("timestamp")) < watermark_us)


def run_available(df: DataFrame, folder: str, name: str) -> StreamingQuery:
    """Processes what is there into a Parquet table with its own checkpoint."""
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}_progress")
            .trigger(availableNow=True).start())


def retrain_on_alerts(alerts: DataFrame, folder: str, progress: str, train: Callable[[DataFrame, str], object],
                      cfg: DriftConfig = DriftConfig()) -> StreamingQuery:
    """Calls ``train(alert, version)`` once for the first alert of every spell of drift; ``train`` publishes the version.

    A spell lasts a window's length from its first alert; the alerts of the days that follow belong to it. What has
    been trained is told by the published versions, so a batch that is run again after a failure trains only what
    was not published.
    """
    spell = dt.timedelta(days=cfg.window_days + 1)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        days = [r["end"] for r in batch.select("end").distinct().orderBy("end").collect()]  # one row a day
        for day in days:
            begun = [dt.datetime.strptime(v, "drift-%Y%m%d") for v in versions(spark, folder) if v.startswith("drift-")]
            if not any(b <= day < b + spell for b in begun):
                train(batch.where(F.col("end") == F.lit(day)), f"drift-{day:%Y%m%d}")

    return (alerts.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
            .trigger(availableNow=True).start())
