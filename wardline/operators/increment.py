"""The features of a new day from a carried state, without reading the days before it.

The state holds, per key, the totals of all earlier rows, and of the rows themselves only what a window can still
reach: the last ``hour_history`` hours of a user, the last ``dept_history`` hours of a department, and the events of
the longest burst window. Its size follows users, devices and visited hosts, not the length of the log. A day is
scanned as in the full job (heavy keys in slices) and the totals are added by equality joins on the same keys.

Defined results. A day's rows must all lie at or after the state's ``until``; earlier rows and rows without a time
would change results already given, so the job stops with their number (replay from the state before them). An empty
day gives no rows and the same state. Null keys are keys like others; repeated rows are rows like others; columns of
the events beyond the log's are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.config import FEATURES, HISTORY_COLUMNS, PASSTHROUGH, FeatureConfig
from wardline.operators.causal import (
    ORDER, add_bursts, dept_sums, enrich, fingerprint_step, history_columns, prints_seen, prior_from_sums, touches,
    user_sums,
)
from wardline.operators.graph import first_visits, nearest_visited
from wardline.operators.skew import (
    ROW, SLICE, Agg, fold, heavy_keys, lookup, merge, per_key, running, same_keys, union_all, with_row_key,
    with_slice,
)
from wardline.session import cut
from wardline.sources.entities import Entities

# Names of the state's tables of totals, in the order of ``user_sums``.
USER_TOTALS = ["users", "user_devices", "user_hosts", "user_depts"]
TABLES = [*USER_TOTALS, "user_hours", "visits", "recent", "prints", "depts", "dept_hours"]
RECENT = ["user_id", "us", "event_id", "owner_dept", "is_foreign_dept", "is_new_host", "status"]


@dataclass(frozen=True)
class State:
    """``tables`` by name (none yet: an empty dict), and the time all later rows must reach (None: no bound)."""

    tables: dict[str, DataFrame]
    until: int | None = None

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name)


def _totals(rows: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[fold(a).alias(a.name) for a in aggs])


def _add_totals(old: DataFrame | None, new: DataFrame, keys: list[str], aggs: list[Agg]) -> DataFrame:
    if old is None:
        return new
    return _totals(old.unionByName(new), keys,
                   [Agg(a.name, "sum" if a.kind == "count" else a.kind, F.col(a.name)) for a in aggs])


def _carried(rows: DataFrame, old: DataFrame | None, keys: list[str], aggs: list[Agg]) -> DataFrame:
    """Running aggregates of the day's rows plus the totals of the days before."""
    if old is None:
        return rows
    before = old.select(*keys, *[F.col(a.name).alias(f"_c_{a.name}") for a in aggs])
    rows = same_keys(rows, before, keys, "left")
    rows = rows.withColumns({a.name: merge(a, F.col(a.name), F.col(f"_c_{a.name}")) for a in aggs})
    return rows.drop(*[f"_c_{a.name}" for a in aggs])


def _with(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else old.unionByName(new)


def _sums_before(rows: DataFrame, hours: DataFrame, key: str, place: str, cap: int) -> DataFrame:
    """Adds ``_sin0`` and ``_cos0``: the sums up to the row ``cap`` places earlier."""
    far = hours.select(key, (F.col(place) + cap).alias(place), F.col("_sin").alias("_sin0"), F.col("_cos").alias("_cos0"))
    return same_keys(rows, far, [key, place], "left")


def _latest(hours: DataFrame, totals: DataFrame, key: str, place: str, cap: int) -> DataFrame:
    """The rows of ``hours`` that the rows to come can still reach back to."""
    end = totals.select(key, F.col(place).alias("_end"))
    return same_keys(hours, end, [key], "inner").where(F.col(place) >= F.col("_end") - cap).drop("_end")


def day_features(events: DataFrame, entities: Entities, state: State, cfg: FeatureConfig = FeatureConfig(),
                 until: int | None = None) -> tuple[DataFrame, State]:
    """Features of the day's events, and the state after them. ``until`` ends the day (micros, exclusive); rows at
    or after it are refused like early ones. Without it the day ends with its last event."""
    bounds = events.agg(
        F.count(F.when(F.col("ts").isNull() | (F.unix_micros("ts") < (state.until if state.until is not None else -2**63)), 1)),
        F.count(F.when(F.unix_micros("ts") >= (until if until is not None else 2**63 - 1), 1)),
        F.max(F.unix_micros("ts")), F.count(F.lit(1))).first()
    early, late, last, total = bounds
    if early or late:
        raise ValueError(f"{early} rows lie before the day or have no time, {late} after it")
    if until is None:  # rows of the same microsecond must not come later: they would be ordered by event_id
        until = state.until if last is None else last + 1

    e = with_row_key(enrich(events.select(*[c for c in PASSTHROUGH], "geo_lat", "geo_lon", "spoofed_fingerprint"),
                            entities.users, entities.hosts, entities.devices, cfg))
    heavy = {k: heavy_keys(e, k, "us", cfg.max_rows_per_task, total) for k in ("user_id", "device_id", "home_dept")}
    tables = {}

    # Departments: the day's five columns, continued from the totals and the kept hours.
    narrow = e.select(ROW, "event_id", "home_dept", "us", "hour", "established")
    if heavy["home_dept"] is not None:
        narrow = with_slice(narrow, "home_dept", "us", heavy["home_dept"], cfg.broadcast_rows)
    by_dept = dept_sums()
    narrow = cut(_carried(running(narrow, ORDER, by_dept).drop(SLICE), state.get("depts"), *by_dept))
    kept = ["home_dept", "_k", "_sin", "_cos"]
    hours = _with(state.get("dept_hours"), narrow.where("established").select(kept))
    priors = prior_from_sums(_sums_before(narrow, hours, "home_dept", "_k", cfg.dept_history), cfg)
    tables["depts"] = _add_totals(state.get("depts"), _totals(e, *by_dept), *by_dept)
    tables["dept_hours"] = _latest(hours, tables["depts"], "home_dept", "_k", cfg.dept_history)

    # Devices: claimed fingerprints.
    by_print, prints = prints_seen(), state.get("prints")
    rank = F.struct((-F.col("_seen")).alias("n"), F.col("_first").alias("first"), F.col("fp").alias("fp"))
    tops = None if prints is None else prints.where(F.col("fp").isNotNull()).groupBy("device_id").agg(F.min(rank).alias("_top"))

    def carry(rows: DataFrame, name: str) -> DataFrame:
        if name == "prints":
            return _carried(rows, prints, *by_print)
        return _carried(rows, tops, ["device_id"], [Agg("_top", "min", F.col("_top"))])

    tables["prints"] = _add_totals(prints, _totals(e, *by_print), *by_print)
    e = e.drop("established").join(priors.select(ROW, "prior_mean", "prior_std"), ROW)
    e = per_key(e, "device_id", "us", heavy["device_id"], lambda rows: fingerprint_step(rows, carry), cfg.broadcast_rows)

    # Users: running sums of the day on the totals of the days before.
    by_user = user_sums()
    e = per_key(e, "user_id", "us", heavy["user_id"], lambda rows: running(rows, ORDER, *by_user), cfg.broadcast_rows)
    for name, group in zip(USER_TOTALS, by_user):
        e = _carried(e, state.get(name), *group)
    e = cut(e)
    for name, group in zip(USER_TOTALS, by_user):
        tables[name] = _add_totals(state.get(name), _totals(e, *group), *group)
    hours = _with(state.get("user_hours"), e.select("user_id", "_n", "_sin", "_cos"))
    tables["user_hours"] = _latest(hours, tables["users"], "user_id", "_n", cfg.hour_history)
    e = _sums_before(e, hours, "user_id", "_n", cfg.hour_history)
    e = e.withColumns(history_columns(*[F.col(f"_{f}") - F.coalesce(f"_{f}0", F.lit(0.0)) for f in ("sin", "cos")], cfg))
    e = e.drop("_n", "_first_us", "_last", "_sin", "_cos", "_sin0", "_cos0", "_dev_n", "_host_n", "_dept_n",
               "prior_mean", "prior_std", "hour", "geo_lat", "geo_lon", "home_dept", "fp")

    # Bursts: the day's rows behind the events that its windows still see. A department whose touches before those
    # events are gone starts with the first touch that is left, which no window of the day can tell apart.
    rows = e if state.get("recent") is None else union_all([e, state.get("recent")])
    e = per_key(rows, "user_id", "us", heavy["user_id"], lambda part: _burst_step(part, cfg, heavy["user_id"]),
                cfg.broadcast_rows).where(F.col(ROW).isNotNull())
    e = cut(e)
    reach = max(cfg.lateral_window_s, cfg.failure_window_s) * 1_000_000
    recent = _with(state.get("recent"), e.select(RECENT))
    tables["recent"] = recent if until is None else recent.where(F.col("us") >= until - reach)

    # Distances: only the day's first visits are answered.
    by_visit = ["user_id", "host"], [Agg("_o", "min", F.struct("us", "event_id"))]
    day = first_visits(e).select("user_id", "host", F.struct("us", "event_id").alias("_o"))
    tables["visits"] = _add_totals(state.get("visits"), day, by_visit[0], [Agg("_o", "min", F.col("_o"))])
    asked = lookup(tables["visits"], day.select("user_id").distinct(), "user_id", cfg.broadcast_rows, "left_semi", nulls=True)
    reached = nearest_visited(asked.select("user_id", "host", "_o.us", "_o.event_id"), entities.edges, cfg, state.until)
    reached = reached.select(F.col("user_id").alias("_user"), F.col("host").alias("_host"), "graph_dist_from_history")
    first = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("host").eqNullSafe(F.col("_host")) & (F.col("is_new_host") == 1)
    e = e.join(reached, first, "left").withColumn(
        "graph_dist_from_history", F.coalesce("graph_dist_from_history", F.lit(0)).cast("int"))
    return e.select(*PASSTHROUGH, *FEATURES, *HISTORY_COLUMNS), State(tables, until)


def _burst_step(rows: DataFrame, cfg: FeatureConfig, heavy: DataFrame | None) -> DataFrame:
    rows = running(rows, ORDER, touches())
    if SLICE not in rows.columns:
        pairs = Window.partitionBy(*touches()[0]).orderBy(*ORDER)
        return add_bursts(rows.withColumn("_next_us", F.lead("us", 1).over(pairs)), cfg, heavy)
    return add_bursts(cut(rows), cfg, heavy)


# ---- stored states -----------------------------------------------------------------------------

def write_state(state: State, path: str) -> None:
    """Writes the state as a folder of its own; the table ``until`` comes last and marks it as whole.

    A folder without it is what a failed run left, and is written anew. A whole state is never overwritten: the
    rows given after it rest on it.
    """
    spark = next(iter(state.tables.values())).sparkSession
    if _is_whole(spark, path):
        raise ValueError(f"{path} already holds a state")
    for name in TABLES:
        state.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(state.until,)], "until long").coalesce(1).write.mode("overwrite").parquet(f"{path}/until")


def _is_whole(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/until/_SUCCESS")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_state(spark: SparkSession, path: str) -> State:
    if not _is_whole(spark, path):
        raise FileNotFoundError(f"{path} holds no whole state")
    return State({name: spark.read.parquet(f"{path}/{name}") for name in TABLES},
                 spark.read.parquet(f"{path}/until").first()[0])


def advance(events: DataFrame, entities: Entities, before: str | None, after: str,
            cfg: FeatureConfig = FeatureConfig(), until: int | None = None) -> DataFrame:
    """One day: reads the state ``before`` (None: the first day), writes the state ``after``, returns the features."""
    spark = events.sparkSession
    state = State({}) if before is None else read_state(spark, before)
    features, following = day_features(events, entities, state, cfg, until)
    features = cut(features)
    write_state(following, after)
    return features
