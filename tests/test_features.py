import datetime as dt
import re
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from wardline.config import FEATURES, HISTORY_COLUMNS, FeatureConfig
from wardline.functions.fingerprint import claimed_fingerprint
from wardline.functions.scalars import circular_distance, circular_mean, circular_std, haversine_km, round_to
from wardline.operators.causal import travel_over_unflagged
from wardline.operators.skew import heavy_keys
from wardline.plans.features import feature_table
from wardline.plans.queries import ORACLES
from wardline.plans.results import TEST_CONFIG, entities_of, features_of
from wardline.sources.entities import Entities
from wardline.sources.events import access_entities, access_events

COLUMNS = FEATURES + HISTORY_COLUMNS


def _by_event(df):
    return {r["event_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def _by_sql(folder):
    """The features of the events in ``folder`` by the SQL counterpart of the job."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    rows = con.sql(ORACLES["event_features"]).df().astype(object).to_dict("records")
    return {r["event_id"]: tuple(None if r[c] != r[c] else r[c] for c in COLUMNS) for r in rows}


def test_ties_and_a_heavy_user(spark, sf_dir, tmp_path):
    """Every third event moved to one user and times truncated to days, so that most are tied: with and without slices,
    equal to SQL."""
    (spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 600")
     .withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("user_id").cast("long")))
     .withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
     .write.parquet(f"{tmp_path}/events.parquet"))
    events = access_events(spark, str(tmp_path))
    ent = access_entities(events)
    want = _by_sql(tmp_path)
    assert len(want) == 600
    assert _by_event(feature_table(events, ent, TEST_CONFIG)) == want
    small = replace(TEST_CONFIG, max_rows_per_task=50)
    assert _by_event(feature_table(events, ent, small)) == want


@pytest.mark.parametrize("case", ["repeated", "null_id", "null_device"])
def test_heavy_path_keeps_every_row(spark, sf_dir, case):
    """Repeated rows, null ids and a null key that holds 40 % of the rows: the sliced path gives what the plain one gives.
    Which of two equal rows comes first is open, so repeated rows are compared by the columns that do not depend on it."""
    events = access_events(spark, sf_dir).where("event_id < 400")
    ent = access_entities(events)
    if case == "repeated":
        events = events.unionByName(events.where("event_id % 10 = 0"))
    elif case == "null_id":
        events = events.withColumn("event_id", F.when(F.col("event_id") % 10 > 0, F.col("event_id")))
    else:
        events = events.withColumn("device_id", F.when(F.col("event_id") % 10 > 3, F.col("device_id")))
    plain = feature_table(events, ent, TEST_CONFIG)
    sliced = feature_table(events, ent, replace(TEST_CONFIG, max_rows_per_task=50))
    if case == "repeated":
        plain, sliced = (x.select("event_id", "ts", "user_id", "is_foreign_dept") for x in (plain, sliced))
    got = [sorted(map(str, x.collect())) for x in (plain, sliced)]
    assert len(got[0]) == events.count() and got[0] == got[1]


def test_departments_and_window_tasks_are_bounded(spark, sf_dir):
    """Departments are sliced from their own size on, light keys are dealt over tasks by the number of rows: same rows."""
    events = access_events(spark, sf_dir).where("event_id < 400")
    ent = access_entities(events)
    small = replace(TEST_CONFIG, max_dept_rows_per_task=30, window_rows_per_task=20)
    plain, bounded = feature_table(events, ent, TEST_CONFIG), feature_table(events, ent, small)
    assert _by_event(bounded) == _by_event(plain)
    plan = bounded._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(home_dept#\d+,", plan)  # no whole department in a task


def test_travel_skips_flagged_events(spark, sf_dir):
    """Against a walk over each user's events: a third of them flagged, null flags, ties, a clashing column; also in slices."""
    events = access_events(spark, sf_dir).where("event_id < 300").withColumns({
        "ts": F.date_trunc("day", "ts"), "us": F.lit("of the caller"), "_last": F.lit(0),
        "flag": F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 3 == 0)})
    want, last = {}, {}
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"])):
        before = last.get(r["user_id"])
        want[r["event_id"]] = None if before is None else round((r["ts"] - before["ts"]).total_seconds() / 60, 2), \
            before is not None and (before["geo_lat"], before["geo_lon"]) != (r["geo_lat"], r["geo_lon"])
        if not r["flag"]:
            last[r["user_id"]] = r
    for most in (5_000_000, 10):
        got = travel_over_unflagged(events, F.col("flag"), replace(TEST_CONFIG, max_rows_per_task=most))
        assert got.columns == [*events.columns, "geo_distance_km", "geo_velocity_kmh", "time_since_last_event_min"]
        assert {r["event_id"]: (r["time_since_last_event_min"], r["geo_distance_km"] > 0) for r in got.collect()} == want


def test_future_rows_change_nothing(spark, sf_dir):
    events = access_events(spark, sf_dir)
    ent = entities_of(spark, sf_dir)
    early = _by_event(feature_table(events.where("event_id < 300"), ent, TEST_CONFIG))
    whole = _by_event(features_of(spark, sf_dir))
    assert all(whole[k] == v for k, v in early.items())


def _events(spark, rows):
    base = dt.datetime(2024, 1, 1, 9, 30)
    full = [(f"e{i}", base + dt.timedelta(seconds=s), "u", "d0", dev, host, 10.0, 10.0, status, "normal", None, None, fp)
            for i, (s, dev, host, status, fp) in enumerate(rows)]
    df = spark.createDataFrame(full, "event_id string, ts timestamp, user_id string, dept string, device_id string, "
                               "host string, geo_lat double, geo_lon double, status string, label string, "
                               "attack_type string, attack_id string, spoofed_fingerprint string")
    ent = Entities(
        spark.createDataFrame([("u", "d0", False)], "user_id string, dept string, is_cold_start boolean"),
        spark.createDataFrame([("h0", "d0"), ("h1", "d1"), ("h2", "d2")], "host string, owner_dept string"),
        spark.createDataFrame([("x", "A", "A", "A")], "device_id string, os string, browser string, screen string"),
        spark.createDataFrame([("h0", "h1", "k"), ("h1", "h2", "k")], "src string, dst string, kind string"))
    return df, ent


def _column(spark, rows, *names):
    df, ent = _events(spark, rows)
    got = feature_table(df, ent, FeatureConfig()).orderBy("ts", "event_id").collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in got]


def test_failure_window_is_closed(spark):
    rows = [(s, "x", "h0", "failure", None) for s in (0, 100, 300, 401)]
    assert _column(spark, rows, "failure_burst_count") == [0, 1, 2, 1]


def test_usual_fingerprint_ties_keep_the_first(spark):
    b = '{"os":"B","browser":"B","screen":"B"}'
    rows = [(i, "x", "h0", "success", fp) for i, fp in enumerate([None, b, b, b, b])]
    assert _column(spark, rows, "fingerprint_mismatch") == [0, 1, 1, 0, 0]


def test_lateral_features(spark):
    rows = [(0, "x", "h0", "success", None), (60, "x", "h2", "success", None), (120, "x", "h1", "success", None),
            (960, "x", "h9", "success", None), (1021, "x", "h1", "success", None)]
    assert _column(spark, rows, "is_foreign_dept", "is_first_time_in_this_dept", "foreign_dept_burst_distinct",
                   "new_host_burst_count", "graph_dist_from_history") == [
        (0, 0, 0, 0, 0), (1, 1, 0, 1, 2), (1, 1, 1, 2, 1), (0, 0, 2, 2, 99), (1, 0, 0, 1, 0)]


def test_first_event(spark):
    assert _column(spark, [(0, "x", "h0", "success", None)], "hour_zscore", "geo_distance_km", "geo_velocity_kmh",
                   "time_since_last_event_min") == [(0.875, 0.0, 0.0, None)]


def _value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    a, b = (F.lit(12.9716), F.lit(77.5946)), (F.lit(51.5072), F.lit(-0.1276))
    assert _value(spark, round_to(haversine_km(*a, *b), 2)) == 8035.14
    assert _value(spark, haversine_km(F.lit(None).cast("double"), a[1], *b)) is None
    assert _value(spark, circular_distance(F.lit(23.0), F.lit(1.0))) == 2.0


@pytest.mark.parametrize("hours,mean,std", [
    ([23.0, 1.0], 0.0, 1.005801), ([9.0, 10.0, 11.0], 10.0, 0.818848),
    ([22.0, 23.0, 0.5], 23.163623, 1.032107), ([9.5], 9.5, 0.5)])
def test_circular_statistics(spark, hours, mean, std):
    import math
    s = sum(math.sin(h / 24 * 2 * math.pi) for h in hours)
    c = sum(math.cos(h / 24 * 2 * math.pi) for h in hours)
    args = (F.lit(len(hours)), F.lit(s), F.lit(c))
    got = _value(spark, circular_mean(*args))
    assert min(abs(got - mean), 24 - abs(got - mean)) < 1e-6
    assert abs(_value(spark, circular_std(*args)) - std) < 1e-6


def test_claimed_fingerprint_falls_back(spark):
    rows = spark.createDataFrame([('{"os":"a","browser":"b","screen":"c"}',), ("not json",), ('{"os":"a"}',), (None,)],
                                 "j string")
    reg = F.struct(F.lit("o").alias("os"), F.lit("b").alias("browser"), F.lit("s").alias("screen"))
    got = [tuple(r[0]) for r in rows.select(claimed_fingerprint(F.col("j"), reg)).collect()]
    assert got == [("a", "b", "c")] + [("o", "b", "s")] * 3


def test_heavy_keys_get_fitting_slices(spark):
    df = spark.range(1000).select((F.col("id") % 2 * F.col("id") % 7).alias("k"), (F.col("id") * 60_000_000).alias("us"))
    heavy = {r["k"]: r["_width"] for r in heavy_keys(df, "k", "us", 400).collect()}
    assert list(heavy) == [0] and heavy[0] == 21_600
