"""A stream gives what the batch job gives, whatever the order of arrival."""

import datetime as dt
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wardline.config import DriftConfig
from wardline.operators.causal import add_dept_prior, add_fingerprint_mismatch, add_user_history, enrich
from wardline.operators.drift import drift_scan
from wardline.plans.results import TEST_CONFIG, entities_of, features_of, results_of
from wardline.session import checkpoint_dir
from wardline.sources.events import access_events
from wardline.sources.versions import publish, versions
from wardline.streaming import stateful, stateless


@pytest.fixture(scope="module")
def folder(spark):
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, df, folder, name, files=3):
    """Writes the table in shuffled files, then a far future row that moves the watermark on."""
    path = f"{folder}/{name}_in"
    df.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    last = df.orderBy(F.desc("ts")).limit(1).withColumns({
        "ts": F.lit(dt.datetime(2030, 1, 1)), "event_id": F.lit(-1).cast(df.schema["event_id"].dataType)})
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _finish(spark, stream, folder, name):
    stateless.run_available(stream, folder, name).awaitTermination(300)
    return spark.read.parquet(f"{folder}/{name}")


def _rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_user_and_device_features(spark, sf_dir, folder):
    ent = entities_of(spark, sf_dir)
    events = enrich(access_events(spark, sf_dir), ent.users, ent.hosts, ent.devices, TEST_CONFIG)
    ready = add_dept_prior(events, TEST_CONFIG)
    columns = ["event_id"] + [c.split()[0] for c in stateful.USER_OUTPUT.split(", ")]
    batch = add_user_history(add_fingerprint_mismatch(ready, TEST_CONFIG), TEST_CONFIG)
    source = _stream(spark, ready.drop("us"), folder, "user")
    online = _finish(spark, stateful.user_features(source, "60 days", TEST_CONFIG), folder, "user")
    assert _rows(online.where("event_id >= 0"), columns) == _rows(batch, columns)
    device = _finish(spark, stateful.fingerprint_mismatch(
        _stream(spark, ready.drop("us"), folder, "device"), "60 days"), folder, "device")
    pair = ["event_id", "fingerprint_mismatch"]
    assert _rows(device.where("event_id >= 0"), pair) == _rows(batch, pair)


def test_drift(spark, sf_dir, folder):
    cfg = DriftConfig(feature="entity_history_days")
    rows = features_of(spark, sf_dir).where("label = 'normal'").join(
        entities_of(spark, sf_dir).users.where("not is_cold_start").select("user_id"), "user_id", "left_semi")
    batch = drift_scan(features_of(spark, sf_dir), entities_of(spark, sf_dir).users, cfg)
    online = _finish(spark, stateful.drift_fires(
        _stream(spark, rows.select("user_id", "event_id", "ts", "label", cfg.feature), folder, "drift"),
        "60 days", cfg), folder, "drift")
    assert batch.count() > 0
    got = online.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_first").alias("firsts"))
    want = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.lit(1).cast("long").alias("firsts"))
    assert _rows(got, ["user_id", "n", "firsts"]) == _rows(want, ["user_id", "n", "firsts"])


def test_population_windows_and_late_rows(spark, folder):
    start = dt.datetime(2024, 1, 1)
    fires = spark.createDataFrame([(i, start + dt.timedelta(days=20 + i)) for i in range(4)], "event_id long, ts timestamp")
    stream = _stream(spark, fires, folder, "fires")
    out = _finish(spark, stateless.population_alert_windows(stream, 10), folder, "alerts").collect()
    # Windows of 8 days over fires on four days running, of ten entities: 2, 3, 4 x 5, 3, 2 fires.
    assert sorted(r["n_drifted_in_window"] for r in out) == [2, 2, 3, 3, 4, 4, 4, 4, 4]
    late = stateless.late_events(fires, int((start + dt.timedelta(days=22)).timestamp() * 1e6))
    assert late.count() == 2


def test_online_alerts(spark, sf_dir, folder):
    res = results_of(spark, sf_dir)
    made = ["pred_label", "confidence", "attack_prob", "predicted_attack_type", "classifier_confidence",
            "classifier_attack_prob", "unified_risk_score", "secondary_review_flag"]
    online = _finish(spark, stateless.online_alerts(
        _stream(spark, res.drop(*made), folder, "scored")), folder, "feed")
    columns = ["event_id", "unified_risk_score", "predicted_attack_type"]
    assert _rows(online.where("event_id >= 0"), columns) == _rows(res.where("unified_risk_score >= 50"), columns)


def test_retraining_once_a_spell(spark, folder):
    """Spells of alerts are 8 days long from their first: one training each, also when a run fails in between,
    starts again, or sees its alerts a second time."""
    place, start, calls = f"{folder}/retrain", dt.datetime(2024, 3, 1), []
    ends = [start + dt.timedelta(days=d) for d in (0, 1, 7, 8, 9, 30)]
    rows = spark.createDataFrame([(e - dt.timedelta(days=8), e, 3, .3) for e in ends],
                                 "start timestamp, end timestamp, n_drifted_in_window long, fraction double")
    rows.coalesce(1).write.parquet(f"{place}/in")

    def train(alert, version):
        calls.append((version, alert.count()))
        if len(calls) == 2:
            raise RuntimeError("lost in training")
        publish(spark, place, version)

    def run(progress):
        source = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
        stateless.retrain_on_alerts(source, place, f"{place}/{progress}", train).awaitTermination(300)

    with pytest.raises(Exception, match="lost in training"):
        run("progress")
    run("progress")
    assert calls == [("drift-20240301", 1), ("drift-20240309", 1), ("drift-20240309", 1), ("drift-20240331", 1)]
    assert versions(spark, place) == ["drift-20240301", "drift-20240309", "drift-20240331"]
    run("another progress")
    assert len(calls) == 4


class _Map(dict):
    """A map state in memory that counts what is asked of it."""

    calls = 0

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


class _Handle:
    def __init__(self):
        self.map, self.timers = _Map(), set()

    def getMapState(self, *_):
        return self.map

    def registerTimer(self, due):
        self.timers.add(due)


class _Told(stateful.InOrder):
    def open(self, handle):
        self.loads = 0

    def load(self):
        self.loads += 1

    def store(self):
        pass

    def row(self, key, r):
        yield r["us"], r["event_id"]


@pytest.mark.parametrize("chunk", [1, 7, 1_000])
def test_waiting_rows_come_in_order_with_few_state_calls(chunk):
    """Three batches out of order, with ties, null ids and rows that stay behind the watermark: each row once and in order,
    the key's state read once a batch, and calls that follow the entries instead of the rows."""
    job, handle, told = _Told(["us", "event_id"], ["us", "event_id"]), _Handle(), []
    job.CHUNK, job.GATHER = chunk, 60
    job.init(handle)
    rows = [((i * 7919 % 200) * 500_000, None if i % 50 == 0 else i) for i in range(200)]
    for n, watermark in enumerate((0, 40_000, 200_000)):  # ms; rows behind the watermark do not arrive
        new = [r for r in rows[n::3] if stateful._due(r) > (0, 0, 40_000)[n]]
        list(job.handleInputRows(("k",), ({"us": us, "event_id": i} for us, i in new), None))
        for due in sorted(t for t in handle.timers if t <= watermark):
            told += job.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w),
                                           SimpleNamespace(getExpiryTimeInMs=lambda d=due: d))
            handle.timers.discard(due)
    arrived = [r for n in range(3) for r in rows[n::3] if n < 2 or stateful._due(r) > 40_000]
    assert [tuple(r) for r in told] == sorted(arrived, key=stateful._place)
    assert not handle.map and job.loads <= 2
    if chunk == 1_000:
        assert handle.map.calls < 60
