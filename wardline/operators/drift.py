"""Per-entity change detection and population drift."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.config import DriftConfig
from wardline.functions.adwin import Adwin
from wardline.functions.scalars import day_offset, micros, round_to
from wardline.operators.skew import WIDTHS, union_all
from wardline.session import cut


def with_day(df: DataFrame) -> DataFrame:
    """Adds ``us`` and ``day``: whole 24-hour periods since the first event of the table."""
    df = df.withColumn("us", micros(F.col("ts")))
    start = df.agg(F.min("us").alias("_start"))
    return df.join(F.broadcast(start)).withColumn("day", day_offset(F.col("us"), F.col("_start"))).drop("_start")


def active_users(users: DataFrame) -> DataFrame:
    return users.where(~F.coalesce("is_cold_start", F.lit(False))).select("user_id")


def _slice_width(series: DataFrame, max_rows: int) -> int:
    """Seconds per slice so that no user has more than ``max_rows`` rows in one."""
    seconds = cut(series.groupBy("user_id", F.floor(F.col("us") / 1_000_000).alias("s"))
                  .agg(F.count(F.lit(1)).alias("n")))
    for width in WIDTHS:
        worst = seconds.groupBy("user_id", F.floor(F.col("s") / width)).agg(F.sum("n").alias("n")).agg(F.max("n"))
        if worst.first()[0] <= max_rows:
            return width
    return WIDTHS[-1]


def _scanner(delta: float):
    def scan(key, state: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        detector = pickle.loads(state["state"].iloc[0]) if len(state) else Adwin(delta)
        rows = rows.sort_values(["us", "event_id"])
        days = [int(d) for d, v in zip(rows["day"], rows["x"]) if detector.update(float(v))]
        return pd.DataFrame({"user_id": [key[0]], "state": [pickle.dumps(detector)], "fires": [days]})
    return scan


def _one_pass(delta: float):
    """Fires of a partition sorted by user and time: one detector at a time, whatever the group sizes."""
    def scan(batches):
        user = detector = None
        for batch in batches:
            users, days = [], []
            for u, day, x in zip(batch["user_id"], batch["day"], batch["x"]):
                if detector is None or u != user:
                    user, detector = u, Adwin(delta)
                if detector.update(float(x)):
                    users.append(u)
                    days.append(day)
            yield pd.DataFrame({"user_id": users, "day": days}).astype({"day": "int32"})
    return scan


def drift_scan(features: DataFrame, users: DataFrame, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """(user_id, day): every day on which a user's detector fired, over normal rows of active users.

    The detector is sequential per user, with a state of logarithmic size. Users are spread over the
    cluster and read as a sorted stream. Users with more rows than one task should see are fed in time
    slices, one round per slice, and only their small states travel between rounds.
    """
    series = (with_day(features).where("label = 'normal'")
              .join(active_users(users), "user_id", "left_semi")
              .select("user_id", "us", "event_id", "day", F.col(cfg.feature).alias("x"))
              .where(F.col("x").isNotNull()))
    user_type = series.schema["user_id"].dataType
    schema = T.StructType([T.StructField("user_id", user_type), T.StructField("state", T.BinaryType()),
                           T.StructField("fires", T.ArrayType(T.IntegerType()))])
    scan = _scanner(cfg.delta)
    series = cut(series)
    state = features.sparkSession.createDataFrame([], T.StructType(schema.fields[:2]))

    def whole(rows: DataFrame) -> DataFrame:
        ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")
        return ordered.select("user_id", "day", "x").mapInPandas(
            _one_pass(cfg.delta), T.StructType([schema["user_id"], T.StructField("day", T.IntegerType())]))

    per_user = series.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    heavy = cut(per_user.where(F.col("n") > cfg.max_rows_per_slice).select("user_id"))
    if heavy.isEmpty():
        return whole(series)
    fired = [whole(series.join(heavy, "user_id", "left_anti"))]
    rest = cut(series.join(heavy, "user_id", "left_semi"))
    width = _slice_width(rest, cfg.max_rows_per_slice)
    rest = rest.withColumn("_bin", F.floor(F.col("us") / 1_000_000 / width))
    lo, hi = rest.agg(F.min("_bin"), F.max("_bin")).first()
    for number in range(lo, hi + 1):
        rows = rest.where(F.col("_bin") == number)
        out = cut(state.groupBy("user_id").cogroup(rows.groupBy("user_id")).applyInPandas(scan, schema))
        state = out.select("user_id", "state")
        fired.append(out.select("user_id", F.explode("fires").alias("day")))
    return union_all(fired)


def first_fires(fires: DataFrame) -> DataFrame:
    return fires.groupBy("user_id").agg(F.min("day").alias("day"))


def population_alerts(first: DataFrame, n_entities: int | None, cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Days on which enough entities had their first fire in [day - window_days, day] (both ends).

    Each daily count is handed to the days it is visible on, so the work is days x window.
    """
    counts = first.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    last = counts.agg(F.max("day").alias("_last"))
    seen = (counts.join(F.broadcast(last))
            .select(F.explode(F.sequence(F.col("day"), F.least(F.col("day") + cfg.window_days, "_last"))).alias("day"),
                    "c").groupBy("day").agg(F.sum("c").alias("n_drifted_in_window")))
    share = F.col("n_drifted_in_window") / float(n_entities) if n_entities else F.lit(0.0)
    return seen.where((F.col("day") >= 0) & (share >= cfg.alert_fraction)).select(
        "day", "n_drifted_in_window", round_to(share, 3).alias("fraction"))


def drift_validation(first: DataFrame, users: DataFrame, drift_day: int) -> DataFrame:
    """tp, fp, fn, tn over active users, and the lag of the true positives."""
    active = users.where(~F.coalesce("is_cold_start", F.lit(False))).select("user_id", "drift_group")
    flags = active.join(first.select("user_id", "day"), "user_id", "left")
    truth, fired = F.coalesce("drift_group", F.lit(False)), F.col("day").isNotNull()
    lag = F.when(truth & fired, F.col("day") - drift_day)
    return flags.agg(
        F.count_if(truth & fired).alias("tp"), F.count_if(~truth & fired).alias("fp"),
        F.count_if(truth & ~fired).alias("fn"), F.count_if(~truth & ~fired).alias("tn"),
        F.min(lag).alias("lag_min"), F.max(lag).alias("lag_max"), round_to(F.avg(lag), 4).alias("lag_mean"))


def drift_rates(validation: DataFrame) -> DataFrame:
    one = F.lit(1)
    return validation.select(
        round_to(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one), 6).alias("recall"),
        round_to(F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), one), 6).alias("false_alarm_rate"))


def earliest_drifted(first: DataFrame, limit: int = 10) -> DataFrame:
    return first.orderBy("day", "user_id").limit(limit)
