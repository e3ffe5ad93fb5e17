"""Strictly causal event features: every value uses only events earlier in (time, event_id) order.

Parity notes. Ties in time are broken by event_id. The travel, interval and novelty features look at
every earlier event whatever its label or status, so the event after an attack inherits the attacker's
location. Personal and department hours are blended linearly even across midnight. "Cold" is observed
history (fewer than ``min_history`` events); the department prior instead leaves out users that are
*declared* cold-start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.config import FeatureConfig
from wardline.functions.fingerprint import claimed_fingerprint
from wardline.functions.scalars import (
    HOUR_TO_RADIANS, circular_distance, circular_mean, circular_std, fractional_hour,
    haversine_km, micros, round_to,
)
from wardline.operators.skew import (
    ROW, SLICE, Agg, heavy_keys, lookup, per_key, running, same_keys, union_all, with_row_key, with_slice,
)
from wardline.session import cut

SHARED = "shared"
ORDER = ["us", "event_id"]


def enrich(events: DataFrame, users: DataFrame, hosts: DataFrame, devices: DataFrame,
           cfg: FeatureConfig) -> DataFrame:
    """Dimension lookups and per-row expressions that the causal passes need."""
    e = lookup(events, users.select("user_id", F.col("dept").alias("_user_dept"),
                                    F.col("is_cold_start").alias("_declared_cold")),
               "user_id", cfg.broadcast_rows)
    e = lookup(e, hosts.select("host", "owner_dept"), "host", cfg.broadcast_rows)
    e = lookup(e, devices.select("device_id", F.struct("os", "browser", "screen").alias("_registered")),
               "device_id", cfg.broadcast_rows)
    e = e.withColumns({
        "us": micros(F.col("ts")),
        "hour": fractional_hour(F.col("ts")),
        "home_dept": F.coalesce("_user_dept", "dept"),
        "owner_dept": F.coalesce("owner_dept", F.lit(SHARED)),
        "established": ~F.coalesce("_declared_cold", F.lit(False)),
        "fp": claimed_fingerprint(F.col("spoofed_fingerprint"), F.col("_registered")),
    })
    return e.withColumn(
        "is_foreign_dept",
        ((F.col("owner_dept") != F.col("home_dept")) & (F.col("owner_dept") != SHARED)).cast("int"),
    ).drop("_user_dept", "_declared_cold", "_registered", "spoofed_fingerprint")


def _angle() -> Column:
    return F.col("hour") * HOUR_TO_RADIANS


def dept_sums() -> tuple[list[str], list[Agg]]:
    """The running sums of a department: its established events and their hours on the circle."""
    est = F.col("established")
    return ["home_dept"], [
        Agg("_k", "sum", est.cast("long")),
        Agg("_sin", "sum", F.when(est, F.sin(_angle())).otherwise(0.0)),
        Agg("_cos", "sum", F.when(est, F.cos(_angle())).otherwise(0.0)),
    ]


def user_sums() -> list[tuple[list[str], list[Agg]]]:
    """The running aggregates of a user: depth, first and last event, hours, and what was seen before."""
    one = F.lit(1)
    return [
        (["user_id"], [
            Agg("_n", "count", one),
            Agg("_first_us", "min", F.col("us")),
            Agg("_last", "last", F.struct("us", "event_id", "geo_lat", "geo_lon")),
            Agg("_sin", "sum", F.sin(_angle())),
            Agg("_cos", "sum", F.cos(_angle())),
        ]),
        (["user_id", "device_id"], [Agg("_dev_n", "count", one)]),
        (["user_id", "host"], [Agg("_host_n", "count", one)]),
        (["user_id", "owner_dept"], [Agg("_dept_n", "count", one)]),
    ]


def touches() -> tuple[list[str], list[Agg]]:
    """The previous event of the same user in the same owner department."""
    return ["user_id", "owner_dept", "is_foreign_dept"], [Agg("_prev", "last", F.struct("us", "event_id"))]


def add_dept_prior(e: DataFrame, cfg: FeatureConfig, heavy: DataFrame | None = None) -> DataFrame:
    """Mean and deviation of the hours of the last ``dept_history`` established events of the home
    department before each event, as a difference of two running sums.

    Departments are few, so on large data each one is heavy; then only the five needed columns are
    scanned in slices, and the result joins back by a key of the row.
    """
    cap = cfg.dept_history
    est = F.col("established")
    sums = dept_sums()
    if heavy is None:
        old = Window.partitionBy("home_dept").orderBy("_k").rangeBetween(
            Window.unboundedPreceding, -cap - 1)
        e = running(e, ORDER, sums).withColumns({
            "_sin0": F.sum(F.when(est, F.sin(_angle())).otherwise(0.0)).over(old),
            "_cos0": F.sum(F.when(est, F.cos(_angle())).otherwise(0.0)).over(old),
        })
        return prior_from_sums(e, cfg)
    e = with_row_key(e)
    narrow = e.select(ROW, "event_id", "home_dept", "us", "hour", "established")
    narrow = with_slice(narrow, "home_dept", "us", heavy, cfg.broadcast_rows)
    narrow = cut(running(narrow, ORDER, sums).drop(SLICE))
    far = narrow.where(est).select("home_dept", (F.col("_k") + cap).alias("_k"),
                                   F.col("_sin").alias("_sin0"), F.col("_cos").alias("_cos0"))
    priors = prior_from_sums(same_keys(narrow, far, ["home_dept", "_k"], "left"), cfg)
    return e.drop("established").join(priors.select(ROW, "prior_mean", "prior_std"), ROW)


def prior_from_sums(e: DataFrame, cfg: FeatureConfig) -> DataFrame:
    n = F.least(F.col("_k"), F.lit(cfg.dept_history))
    s = F.col("_sin") - F.coalesce("_sin0", F.lit(0.0))
    c = F.col("_cos") - F.coalesce("_cos0", F.lit(0.0))
    return e.withColumns({
        "prior_mean": F.coalesce(circular_mean(n, s, c), F.lit(cfg.default_mean_hour)),
        "prior_std": F.coalesce(circular_std(n, s, c), F.lit(cfg.default_std_hour)),
    }).drop("_k", "_sin", "_cos", "_sin0", "_cos0", "established")


def add_fingerprint_mismatch(e: DataFrame, cfg: FeatureConfig, heavy: DataFrame | None = None,
                             tasks: int | None = None) -> DataFrame:
    """1 when the claimed fingerprint differs from the one seen most often before on this device
    (ties: the one seen first). The running mode is a running minimum of (-count, first seen, fp)."""
    return per_key(e, "device_id", "us", heavy, lambda rows: fingerprint_step(rows, tasks=tasks), cfg.broadcast_rows)


def prints_seen() -> tuple[list[str], list[Agg]]:
    """How often, and since when, a fingerprint was claimed on a device."""
    return ["device_id", "fp"], [Agg("_seen", "count", F.lit(1)), Agg("_first", "min", F.struct("us", "event_id"))]


def fingerprint_step(e: DataFrame, carry=lambda rows, name: rows, tasks: int | None = None) -> DataFrame:
    """``carry(rows, name)`` may add what was seen before the given rows to the aggregates ``name``."""
    here = F.struct("us", "event_id")
    if SLICE not in e.columns:
        # one shuffle serves both windows
        e = e.repartition("device_id") if tasks is None else e.repartition(tasks, "device_id")
    e = carry(running(e, ORDER, prints_seen()), "prints")
    rank = F.struct((-(F.col("_seen") + 1)).alias("n"), F.least(F.col("_first"), here).alias("first"),
                    F.col("fp").alias("fp"))
    e = carry(running(e, ORDER, (["device_id"], [Agg("_top", "min", F.when(F.col("fp").isNotNull(), rank))])), "tops")
    differs = F.col("fp").isNotNull() & F.col("_top").isNotNull() & (F.col("fp") != F.col("_top.fp"))
    return e.withColumn("fingerprint_mismatch", F.coalesce(differs, F.lit(False)).cast("int")).drop(
        "_seen", "_first", "_top")


def add_bursts(e: DataFrame, cfg: FeatureConfig, heavy: DataFrame | None) -> DataFrame:
    """Events of three kinds inside a look-back window, counted as 'started before this row' minus
    'already expired'. Both are running sums, so the cost per row does not grow with the window.

    A foreign department is active from its first touch until the window after its last touch has
    passed, so the number of active departments is the distinct count.
    """
    lateral, failure = cfg.lateral_window_s * 1_000_000, cfg.failure_window_s * 1_000_000
    foreign = F.col("is_foreign_dept") == 1
    gap = F.col("us") - F.col("_prev.us")
    started = foreign & (F.col("_prev").isNull() | (gap > lateral))
    e = e.withColumns({"_fd": started.cast("int"), "_nh": F.col("is_new_host"),
                       "_fail": F.when(F.col("status") == "failure", 1).otherwise(0)})
    names = ["foreign_dept_burst_distinct", "new_host_burst_count", "failure_burst_count"]

    if SLICE not in e.columns:
        following = F.col("_next_us") - F.col("us")
        e = e.withColumn("_fd_end", (foreign & (following.isNull() | (following > lateral))).cast("int"))
        by_user = Window.partitionBy("user_id")
        seen = by_user.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)

        def active(start: str, end: str, width: int) -> Column:
            old = by_user.orderBy("us").rangeBetween(Window.unboundedPreceding, -width - 1)
            return (F.coalesce(F.sum(start).over(seen), F.lit(0))
                    - F.coalesce(F.sum(end).over(old), F.lit(0))).cast("int")

        return e.withColumns(dict(zip(names, [
            active("_fd", "_fd_end", lateral), active("_nh", "_nh", lateral), active("_fail", "_fail", failure),
        ]))).drop("_prev", "_next_us", "_fd", "_fd_end", "_nh", "_fail")

    # Heavy users: expiries become rows of their own, so that time slices need no look-back.
    keyed = ROW in e.columns
    e = cut(with_row_key(e.drop(SLICE)))

    def expiry(rows: DataFrame, at: Column, name: str) -> DataFrame:
        return rows.select("user_id", at.alias("us"), F.lit(-1).alias(name))

    open_depts = e.where(foreign).groupBy("user_id", "owner_dept").agg(F.max("us").alias("us"))
    expiries = union_all([
        expiry(e.where(started & F.col("_prev").isNotNull()), F.col("_prev.us") + lateral + 1, "_fd"),
        expiry(open_depts, F.col("us") + lateral + 1, "_fd"),
        expiry(e.where("_nh = 1"), F.col("us") + lateral + 1, "_nh"),
        expiry(e.where("_fail = 1"), F.col("us") + failure + 1, "_fail"),
    ]).groupBy("user_id", "us").agg(*[F.sum(c).alias(c) for c in ("_fd", "_nh", "_fail")])
    marked = union_all([
        e.select("user_id", "us", "event_id", ROW, "_fd", "_nh", "_fail").withColumn("_event", F.lit(1)),
        expiries.withColumn("_event", F.lit(0))])
    marked = with_slice(marked, "user_id", "us", heavy, cfg.broadcast_rows)
    counted = running(marked, ["us", "_event", "event_id"], (["user_id"], [
        Agg(name, "sum", F.col(c)) for name, c in zip(names, ("_fd", "_nh", "_fail"))]))
    counted = counted.where("_event = 1").select(ROW, *[F.col(c).cast("int").alias(c) for c in names])
    return e.drop("_prev", "_fd", "_nh", "_fail").join(counted, ROW).drop(*[ROW][keyed:])


def add_user_history(e: DataFrame, cfg: FeatureConfig, heavy: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Novelty, travel, hour deviation, bursts and history depth, all keyed by user: one shuffle."""
    return per_key(e, "user_id", "us", heavy, lambda rows: _user_step(rows, cfg, heavy), cfg.broadcast_rows, tasks)


def travel_columns() -> dict[str, Column]:
    """Distance, speed and time since the ``_last`` event; without one 0, 0 and null."""
    elapsed_s = (F.col("us") - F.col("_last.us")) / 1_000_000.0
    km = haversine_km(F.col("_last.geo_lat"), F.col("_last.geo_lon"), F.col("geo_lat"), F.col("geo_lon"))
    return {
        "geo_distance_km": F.coalesce(round_to(km, 2), F.lit(0.0)),
        "geo_velocity_kmh": F.coalesce(
            round_to(km / F.greatest(elapsed_s / 3600, F.lit(1 / 60)), 2), F.lit(0.0)),
        "time_since_last_event_min": round_to(elapsed_s / 60, 2),
    }


def travel_over_unflagged(events: DataFrame, flagged: Column, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Travel from the user's last event before that was not flagged, so that the event after an attack does not
    inherit the attacker's place. A null flag is no flag.

    The last unflagged event is the greatest (time, event_id) among those before: a running maximum, which the slices
    of a heavy user hand on like their other totals. Columns of the events beyond those used are kept, but for the
    three results, which replace columns of those names.
    """
    flag = F.coalesce(flagged.cast("boolean"), F.lit(False))
    names = [c for c in events.columns if c not in travel_columns()]
    rows = events.withColumn("_flag", flag).select(
        F.struct(*names).alias("_event"), "user_id", "event_id", "geo_lat", "geo_lon", "_flag", F.unix_micros("ts").alias("us"))
    last = F.when(~F.col("_flag"), F.struct("us", "event_id", "geo_lat", "geo_lon"))
    heavy = heavy_keys(rows, "user_id", "us", cfg.max_rows_per_task)
    rows = per_key(rows, "user_id", "us", heavy, lambda part: running(part, ORDER, (["user_id"], [Agg("_last", "max", last)])),
                   cfg.broadcast_rows)
    return rows.select("_event.*", *[c.alias(n) for n, c in travel_columns().items()])


def history_columns(sin_sum: Column, cos_sum: Column, cfg: FeatureConfig) -> dict[str, Column]:
    """Features of rows that carry the depth ``_n``, ``_first_us``, the ``_last`` event, how often device, host and
    department were seen (``_dev_n``, ``_host_n``, ``_dept_n``), and the given sums over the recent hours."""
    n = F.least(F.col("_n"), F.lit(cfg.hour_history))
    weight = F.least(F.lit(1.0), F.col("_n") / float(cfg.min_history))
    own_mean, own_std = circular_mean(n, sin_sum, cos_sum), circular_std(n, sin_sum, cos_sum)
    mean = F.coalesce(weight * own_mean + (1 - weight) * F.col("prior_mean"), "prior_mean")
    std = F.coalesce(weight * own_std + (1 - weight) * F.col("prior_std"), "prior_std")
    return {
        "hour_zscore": round_to(circular_distance(F.col("hour"), mean) / F.greatest(std, F.lit(0.5)), 3),
        **travel_columns(),
        "is_new_device": (F.col("_dev_n") == 0).cast("int"),
        "is_new_host": (F.col("_host_n") == 0).cast("int"),
        "is_first_time_in_this_dept":
            ((F.col("_dept_n") == 0) & (F.col("is_foreign_dept") == 1)).cast("int"),
        "entity_history_days": F.coalesce(
            round_to((F.col("us") - F.col("_first_us")) / 86_400_000_000.0, 2), F.lit(0.0)),
        "entity_history_event_count": F.col("_n").cast("int"),
        "is_cold_start_entity": (F.col("_n") < cfg.min_history).cast("int"),
        "cold_start_blend_weight": round_to(weight, 2),
    }


def _user_step(e: DataFrame, cfg: FeatureConfig, heavy: DataFrame | None) -> DataFrame:
    cap = cfg.hour_history
    e = running(e, ORDER, *user_sums(), touches())
    if SLICE not in e.columns:
        pairs = Window.partitionBy("user_id", "owner_dept", "is_foreign_dept").orderBy(*ORDER)
        win = Window.partitionBy("user_id").orderBy(*ORDER)
        e = e.withColumn("_next_us", F.lead("us", 1).over(pairs))
        e = e.withColumns({"_sin0": F.lag("_sin", cap).over(win), "_cos0": F.lag("_cos", cap).over(win)})
    else:
        e = cut(e)
        far = e.select("user_id", (F.col("_n") + cap).alias("_n"),
                       F.col("_sin").alias("_sin0"), F.col("_cos").alias("_cos0"))
        e = same_keys(e, far, ["user_id", "_n"], "left")

    s = F.col("_sin") - F.coalesce("_sin0", F.lit(0.0))
    c = F.col("_cos") - F.coalesce("_cos0", F.lit(0.0))
    e = e.withColumns(history_columns(s, c, cfg)).drop(
        "_n", "_first_us", "_last", "_sin", "_cos", "_sin0", "_cos0", "_dev_n", "_host_n", "_dept_n",
        "prior_mean", "prior_std", "hour", "geo_lat", "geo_lon", "home_dept", "fp")
    return add_bursts(e, cfg, heavy)
