"""Registered queries of the jobs that go from day to day on stored states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardline.functions.scalars import round_to
from wardline.operators.causal import travel_over_unflagged as travel
from wardline.operators.increment import advance
from wardline.operators import sketches
from wardline.operators.ranks import quantiles
from wardline.operators.skew import union_all
from wardline.plans import oracles as o
from wardline.plans.queries import register
from wardline.plans.results import TEST_CONFIG, entities_of, kept, results_of, scored_of
from wardline.session import checkpoint_dir
from wardline.sources.events import access_events

DAY = 86_400_000_000
# The log is taken over in four parts that start on these days.
PARTS = [9, 17, 25]


@register("daily_features", o.sql(o.features(), "SELECT * FROM features"))
def daily_features(spark, sf_dir):
    """The feature table in four runs, each from the stored state of the run before and its own days only."""
    def build():
        events, entities = access_events(spark, sf_dir), entities_of(spark, sf_dir)
        folder = f"{checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
        first = events.agg(F.min(F.unix_micros(F.date_trunc("day", "ts")))).first()[0]
        if first is None:
            return advance(events, entities, None, f"{folder}/0", TEST_CONFIG)
        us, parts, before, start = F.unix_micros("ts"), [], None, first
        for i, end in enumerate([*[first + d * DAY for d in PARTS], None]):
            rows = events.where(us >= start) if end is None else events.where((us >= start) & (us < end))
            parts.append(advance(rows, entities, before, f"{folder}/{i}", TEST_CONFIG, end))
            before, start = f"{folder}/{i}", end
        return union_all(parts)
    return kept(spark, "daily features", sf_dir, build)


_LAST = ", ".join(f"last_value(CASE WHEN NOT flagged THEN {c} END IGNORE NULLS) OVER w AS p_{c}" for c in ("us", "geo_lat", "geo_lon"))
_KM, _SECONDS = o.haversine("p_geo_lat", "p_geo_lon", "geo_lat", "geo_lon"), "(us - p_us) / 1000000.0::DOUBLE"


@register("travel_over_unflagged", o.sql(o.results() | {
    "marked": "SELECT a.*, r.predicted_attack_type IS NOT NULL AS flagged FROM access a JOIN results r USING (event_id)",
    "before": f"""SELECT *, {_LAST} FROM marked
        WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""},
    f"""SELECT event_id, user_id, flagged, coalesce({o.r(_KM, 2)}, 0.0) AS geo_distance_km,
        coalesce({o.r(f"{_KM} / greatest({_SECONDS} / 3600, 1.0::DOUBLE / 60)", 2)}, 0.0) AS geo_velocity_kmh,
        {o.r(f"{_SECONDS} / 60", 2)} AS time_since_last_event_min FROM before"""))
def travel_over_unflagged(spark, sf_dir):
    """Travel from the last event that the gate let pass."""
    flags = results_of(spark, sf_dir).select("event_id", F.col("predicted_attack_type").isNotNull().alias("flagged"))
    events = access_events(spark, sf_dir).select("event_id", "user_id", "ts", "geo_lat", "geo_lon").join(flags, "event_id")
    return travel(events, F.col("flagged"), TEST_CONFIG).select(
        "event_id", "user_id", "flagged", "geo_distance_km", "geo_velocity_kmh", "time_since_last_event_min")


WINDOW = 7


def _references(spark, sf_dir):
    """Windows of stored sketches: the log comes in batches, each of which writes the sketches of its own days."""
    def build():
        rows = scored_of(spark, sf_dir).where(sketches.established_normals())
        folder = f"{checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
        day, bounds = F.dayofmonth("ts"), [0, *PARTS, 99]
        for low, high in zip(bounds, bounds[1:]):
            sketches.add_batch(rows.where((day >= low) & (day < high)), folder, f"from-{low}")
        return sketches.window_references(sketches.stored_sketches(spark, folder), WINDOW)
    return kept(spark, "window references", sf_dir, build)


@register("window_references", o.sql(o.scored() | {
    "normals": """SELECT CAST(ts AS DATE) AS day, dept, ensemble_score_raw AS x FROM scored
        WHERE label = 'normal' AND is_cold_start_entity = 0""",
    "everyone": "SELECT * FROM normals UNION ALL SELECT day, '__global__', x FROM normals",
    "ends": "SELECT day, dept FROM (SELECT unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM normals), "
            "(SELECT DISTINCT dept FROM everyone)"},
    f"""SELECT CAST(e.day AS VARCHAR) AS day, e.dept, count(*) AS n, {o.r('quantile_cont(x, 0.5)', 6)} AS exact_median, true AS within_bound
        FROM ends e JOIN everyone b ON b.dept = e.dept AND b.day BETWEEN e.day - {WINDOW - 1} AND e.day GROUP BY ALL"""))
def window_references(spark, sf_dir):
    """Counts of the merged sketches, the exact median of the same window, and whether the sketch's median has a rank within
    the stated bound of one half."""
    counts = (scored_of(spark, sf_dir).where(sketches.established_normals())
              .groupBy(F.to_date("ts").alias("day"), "dept", F.col("ensemble_score_raw").alias("x")).agg(F.count(F.lit(1)).alias("c")))
    seen = sketches.seen_on(sketches.with_global(counts), WINDOW).groupBy("day", "dept", "x").agg(F.sum("c").alias("c"))
    exact = quantiles(seen, "x", {"exact_median": 0.5}, ["day", "dept"], weight="c")
    held = _references(spark, sf_dir).select("day", "dept", "n", "ref_score")
    below = (seen.join(held, ["day", "dept"]).groupBy("day", "dept", "n").agg(
        F.sum(F.when(F.col("x") < F.col("ref_score"), F.col("c")).otherwise(0)).alias("less"),
        F.sum(F.when(F.col("x") <= F.col("ref_score"), F.col("c")).otherwise(0)).alias("upto")))
    slack = F.lit(sketches.rank_error()) * F.col("n") + 1  # a rank is known to one row
    middle = F.col("n") / 2.0
    return below.join(exact, ["day", "dept"]).select(
        F.col("day").cast("string").alias("day"), "dept", "n", round_to(F.col("exact_median"), 6).alias("exact_median"),
        ((F.col("less") - slack <= middle) & (middle <= F.col("upto") + slack)).alias("within_bound"))


@register("final_risk_as_of")
def final_risk_as_of(spark, sf_dir):
    """Risk with the references known at a row's time: the window of the days before it, from stored sketches."""
    rows = scored_of(spark, sf_dir).drop("final_risk_score")
    return sketches.blend_as_of(rows, _references(spark, sf_dir)).select("event_id", "dept", "final_risk_score")
