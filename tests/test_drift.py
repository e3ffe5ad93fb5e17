import math
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wardline.config import DriftConfig
from wardline.functions.adwin import Adwin
from wardline.operators import drift
from wardline.plans.results import entities_of, features_of

# First fire days of fifteen entities out of 65, and the alerts they raise.
FIRST_DAYS = [27, 25, 23, 21, 25, 23, 23, 23, 27, 13, 23, 21, 13, 22, 28]
ALERTS = [(25, 10, .154), (26, 10, .154), (27, 12, .185), (28, 13, .2)]


def test_population_alerts_and_lag(spark):
    first = spark.createDataFrame(list(enumerate(FIRST_DAYS)), "user_id int, day int")
    got = sorted(tuple(r) for r in drift.population_alerts(first, 65).collect())
    assert got == ALERTS
    users = spark.createDataFrame([(i, i < 22, False) for i in range(65)] + [(99, True, True)],
                                  "user_id int, drift_group boolean, is_cold_start boolean")
    val = drift.drift_validation(first, users, 20)
    assert tuple(val.first()) == (15, 0, 7, 43, -7, 8, 2.4667)
    assert tuple(drift.drift_rates(val).first()) == (0.681818, 0.0)


def test_no_fires_and_no_entities(spark):
    none = spark.createDataFrame([], "user_id int, day int")
    assert drift.population_alerts(none, 65).isEmpty()
    some = spark.createDataFrame([(1, 3)], "user_id int, day int")
    assert drift.population_alerts(some, None).isEmpty()


def test_detector():
    rng = random.Random(1)
    steady = Adwin(0.002)
    assert not any(steady.update(rng.gauss(0, 1)) for _ in range(2000))
    shifted = Adwin(0.002)
    fires = [i for i in range(2000) if shifted.update(rng.gauss(0 if i < 1000 else 2, 1))]
    assert fires and 1000 <= fires[0] < 1100
    assert shifted.n < 1100 and abs(shifted.total / shifted.n - 2) < 0.3
    assert shifted.n == sum(len(level) * 2 ** i for i, level in enumerate(shifted.levels))


class ListDetector:
    """The detector on a plain list of the values in its window; only the sizes of the buckets are counted."""

    def __init__(self, delta):
        self.delta, self.values, self.counts, self.seen = delta, [], [0], 0

    def cut_found(self):
        n = len(self.values)
        if n <= 10:
            return False
        log_term = math.log(2 * math.log(n) / self.delta)
        variance = statistics.pvariance(self.values)
        end = 0
        for level in reversed(range(len(self.counts))):
            for _ in range(self.counts[level]):
                end += 2 ** level
                old, new = self.values[:end], self.values[end:]
                if len(new) < 5:
                    return False
                if len(old) >= 5:
                    m = 1 / (len(old) - 4) + 1 / (len(new) - 4)
                    bound = math.sqrt(2 * m * variance * log_term) + 2 / 3 * log_term * m
                    if abs(statistics.fmean(old) - statistics.fmean(new)) > bound:
                        return True
        return False

    def update(self, x):
        self.seen += 1
        self.values.append(x)
        self.counts[0] += 1
        level = 0
        while self.counts[level] > 5:
            self.counts[level] -= 2
            self.counts += [0] * (level + 2 - len(self.counts))
            level += 1
            self.counts[level] += 1
        fired = False
        while self.seen % 32 == 0 and self.cut_found():
            fired = True
            del self.values[:2 ** (len(self.counts) - 1)]
            self.counts[-1] -= 1
            while len(self.counts) > 1 and not self.counts[-1]:
                self.counts.pop()
        return fired


@pytest.mark.parametrize("seed", range(6))
def test_statistics_equal_those_of_the_values(seed):
    rng = random.Random(seed)
    plain, kept, fires = ListDetector(0.05), Adwin(0.05), 0
    for i in range(900):
        x = rng.gauss((i // 150) % 3 * (seed % 3), 1) if seed < 5 else float(i // 300)
        fired = plain.update(x)
        assert kept.update(x) == fired
        fires += fired
        assert kept.n == len(plain.values) and [len(b) for b in kept.levels] == plain.counts
        assert abs(kept.total - math.fsum(plain.values)) < 1e-8
        assert abs(kept.spread / kept.n - statistics.pvariance(plain.values)) < 1e-8
    assert fires > 0 or seed % 3 == 0


def test_scan_of_every_user_equals_the_plain_detector(spark):
    folder = "/root/testdata/sf0.01"
    features, users = features_of(spark, folder), entities_of(spark, folder).users
    rows = (drift.with_day(features).where("label = 'normal'").join(drift.active_users(users), "user_id", "left_semi")
            .select("user_id", "us", "event_id", "day", "entity_history_days", "hour_zscore").toPandas()
            .sort_values(["user_id", "us", "event_id"]))
    for feature in ("entity_history_days", "hour_zscore"):
        cfg = DriftConfig(feature=feature)
        want = []
        for user, part in rows[rows[feature].notna()].groupby("user_id"):
            plain = ListDetector(cfg.delta)
            want += [(user, day) for day, x in zip(part["day"], part[feature]) if plain.update(float(x))]
        got = sorted(tuple(r) for r in drift.drift_scan(features, users, cfg).collect())
        assert got == sorted(want)
        assert bool(got) == (feature == "entity_history_days")


def test_slices_equal_one_pass(spark, sf_dir):
    cfg = DriftConfig(feature="entity_history_days")
    users = entities_of(spark, sf_dir).users
    whole = drift.drift_scan(features_of(spark, sf_dir), users, cfg)
    parts = drift.drift_scan(features_of(spark, sf_dir), users, replace(cfg, max_rows_per_slice=20))
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (whole, parts))
    assert a and a == b


def test_day_offset_counts_from_the_first_event(spark):
    df = spark.sql("select timestamp'2024-01-01 22:00:00' as ts union all select timestamp'2024-01-02 21:00:00' "
                   "union all select timestamp'2024-01-02 22:00:00'")
    assert [r["day"] for r in drift.with_day(df).orderBy("ts").collect()] == [0, 0, 1]
    assert drift.active_users(spark.createDataFrame([(1, True), (2, None)], "user_id int, is_cold_start boolean")).agg(
        F.max("user_id")).first()[0] == 2
