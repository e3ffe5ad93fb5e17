import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import sketches
from wardline.operators.scoring import GLOBAL
from wardline.session import checkpoint_dir

SCHEMA = "ts timestamp, dept string, x double, cold_start_blend_weight double"
START = dt.datetime(2024, 3, 1, 6)


def _rows(spark, rows):
    return spark.createDataFrame([(START + dt.timedelta(days=d), g, x, w) for d, g, x, w in rows], SCHEMA)


@pytest.fixture(scope="module")
def busy(spark):
    """40,000 rows of 12 days: a heavy group, a skewed one, one with few values, one that stops; ordered on purpose."""
    rng = np.random.default_rng(3)
    rows = []
    for day in range(12):
        rows += [(day, "heavy", float(v), 1.0) for v in np.sort(rng.normal(day, 3, 2400))]
        rows += [(day, "skewed", float(v), 1.0) for v in np.sort(rng.pareto(0.6, 500))[::-1]]
        rows += [(day, "few", float(v), 1.0) for v in rng.integers(0, 3, 400)]
    rows += [(2, "stops", float(v), 1.0) for v in rng.normal(0, 1, 900)]
    return _rows(spark, rows).persist()


def test_ranks_within_the_stated_bound(spark, busy):
    probs = {"p01": .01, "p25": .25, "p50": .5, "p75": .75, "p99": .99}
    days = 5
    got = sketches.window_references(sketches.daily_sketches(busy, "x"), days, probs).toPandas()
    table = busy.withColumn("day", F.to_date("ts")).toPandas()
    bound, worst = sketches.rank_error(), 0.0
    for r in got.itertuples():
        age = (np.datetime64(r.day) - table["day"].to_numpy(dtype="datetime64[D]")).astype(int)
        part = table[(age >= 0) & (age < days) & ((table["dept"] == r.dept) | (r.dept == GLOBAL))]["x"].to_numpy()
        assert r.n == len(part) > 0
        for name, p in probs.items():
            v = getattr(r, name)
            low, high = (part < v).mean(), (part <= v).mean()
            worst = max(worst, low - p, p - high)
    assert worst <= bound < 0.01
    assert set(got["dept"]) == {"heavy", "skewed", "few", "stops", GLOBAL}
    assert sorted((got[got["dept"] == "stops"]["day"] - dt.date(2024, 3, 3)).map(lambda d: d.days)) == [0, 1, 2, 3, 4]
    assert max(map(len, got["sketch"])) < 40_000


def test_batches_merge_and_replace(spark, busy):
    folder = f"{checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex}"
    late = F.pmod(F.hash("x"), F.lit(10)) == 0
    sketches.add_batch(busy.where(~late), folder, "1", "x")
    sketches.add_batch(busy.where(late), folder, "2", "x")
    sketches.add_batch(busy.where(late), folder, "2", "x")  # run again after a failure
    whole = sketches.window_references(sketches.daily_sketches(busy, "x"), 3).select("day", "dept", "n")
    parts = sketches.window_references(sketches.stored_sketches(spark, folder), 3).select("day", "dept", "n")
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_nulls_ties_and_empty(spark):
    rows = [(0, "a", 5.0, 0.0)] * 7 + [(0, "a", None, 0.0), (0, "a", float("nan"), 0.0), (0, None, 9.0, 0.0)]
    got = {(r["dept"], r["n"], r["ref_score"]) for r in
           sketches.window_references(sketches.daily_sketches(_rows(spark, rows), "x")).collect()}
    assert got == {("a", 7, 5.0), (None, 1, 9.0), (GLOBAL, 8, 5.0)}
    none = sketches.window_references(sketches.daily_sketches(_rows(spark, []), "x"))
    assert none.isEmpty()
    new = sketches.blend_as_of(_rows(spark, [(0, "a", 40.0, 0.5)]), none, "x")
    assert new.first()["final_risk_score"] == 40.0


def test_only_days_before_count(spark):
    history = _rows(spark, [(0, "a", 10.0, 1.0)] * 3 + [(0, "b", 30.0, 1.0)] * 2 + [(1, "a", 90.0, 1.0)])
    held = sketches.window_references(sketches.daily_sketches(history, "x"), 7)
    asked = _rows(spark, [(1, "a", 50.0, 0.0), (1, "c", 50.0, 0.0), (0, "a", 50.0, 0.0), (1, "b", 50.0, 0.5)])
    got = {(r["ts"].day, r["dept"]): r["final_risk_score"] for r in sketches.blend_as_of(asked, held, "x").collect()}
    assert got == {(2, "a"): 10.0, (2, "c"): 10.0, (1, "a"): 50.0, (2, "b"): 40.0}
