import datetime as dt
import json
import uuid

import pytest

from wardline.operators.drift import first_fires
from wardline.session import checkpoint_dir
from wardline.sources import logs
from wardline.sources.entities import read_entities

DOC = {
    "users": {"u1": {"dept": "hr", "role": "x", "home_city": ["Pune", 18.5, 73.8, "IN"], "work_start_hr": 9,
                     "work_end_hr": 17.5, "devices": ["d1"], "normal_hosts": ["h1", "s1"], "drift_group": True,
                     "is_cold_start": False, "broad_access": False, "broad_access_hosts": []},
              "u2": {"dept": "it", "devices": [], "normal_hosts": [], "is_cold_start": True}},
    "devices": {"d1": {"owner": "u1", "fingerprint": {"os": "o", "browser": "b", "screen": "s"}}},
    "dept_hosts": {"hr": ["h1", "s1"], "it": ["h2"]}, "shared_hosts": ["s1"],
    "graph_edges": [["h1", "h2", {"kind": "intra_dept"}], ["h1", "s1", {"kind": "shared_link"}]],
    "config": {"drift_day": 20, "cold_start_day": 22, "start_date": "2024-01-01", "sim_days": 30},
}
LOG = """event_id,timestamp,user_id,dept,device_id,source_ip,geo_city,geo_country,geo_lat,geo_lon,host,status,label,attack_type,attack_id,spoofed_fingerprint
e1,2024-01-01 09:00:00,u1,hr,d1,1.1.1.1,Pune,IN,18.5,73.8,h1,success,normal,,,
e2,2024-01-01T09:05:00,u1,hr,d1,1.1.1.1,Pune,IN,18.5,73.8,h2,failure,attack,device_spoofing,a1,"{""os"": ""x"", ""browser"": ""y"", ""screen"": ""z""}"
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("sources")


def test_entities(spark, folder):
    (folder / "entities.json").write_text(json.dumps(DOC))
    ent = read_entities(spark, str(folder / "entities.json"))
    users = {r["user_id"]: r for r in ent.users.collect()}
    assert users["u1"]["home_city"]["lat"] == 18.5 and users["u2"]["is_cold_start"] and not users["u2"]["drift_group"]
    assert {tuple(r) for r in ent.hosts.collect()} == {("h1", "hr"), ("h2", "it"), ("s1", "shared")}
    assert {tuple(r) for r in ent.edges.collect()} == {("h1", "h2", "intra_dept"), ("h1", "s1", "shared_link")}
    assert tuple(ent.devices.first()) == ("d1", "u1", "o", "b", "s")
    assert ent.normal_hosts.count() == 2 and ent.config.first()["drift_day"] == 20


def test_event_csv(spark, folder):
    path = folder / "log.csv"
    path.write_text(LOG)
    rows = logs.read_event_csv(spark, str(path)).orderBy("event_id").collect()
    assert rows[0]["ts"] == dt.datetime(2024, 1, 1, 9) and rows[0]["attack_type"] is None
    assert json.loads(rows[1]["spoofed_fingerprint"])["os"] == "x" and rows[1]["geo_lat"] == 18.5
    narrow = "\n".join(",".join(line.split(",")[:15]) for line in LOG.splitlines()[:2])
    (folder / "narrow.csv").write_text(narrow)
    assert logs.read_event_csv(spark, str(folder / "narrow.csv")).first()["spoofed_fingerprint"] is None


def test_missing_input_is_none(spark, folder):
    assert logs.read_or_none(logs.read_table, spark, str(folder / "nowhere")) is None
    assert logs.read_or_none(logs.read_drift_log, spark, str(folder / "nowhere.json")) is None


def test_table_round_trip_and_nan(spark):
    path = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), float("nan")), ("b", dt.datetime(2024, 1, 2), 1.0)],
                               "event_id string, ts timestamp, x double")
    logs.write_table(df, path, ["event_id", "x", "ts"], by_day=True)
    back = logs.read_table(spark, path, ["event_id", "x"])
    assert sorted((r["event_id"], r["x"]) for r in back.collect()) == [("a", None), ("b", 1.0)]
    one_day = spark.read.parquet(path).where("event_date = date'2024-01-02'")
    assert "PartitionFilters: [isnotnull(event_date" in one_day._jdf.queryExecution().executedPlan().toString()


def test_drift_log(spark, folder):
    log = {"monitored_feature": "hour_zscore", "adwin_delta": 0.05, "per_entity_first_fire_day": {"u1": 3, "u2": 5},
           "validation_against_ground_truth": {"tp": 1, "fp": 1, "fn": 0, "tn": 2},
           "population_alerts": [{"day": 5, "n_drifted_in_window": 2, "fraction": 0.5}]}
    (folder / "drift.json").write_text(json.dumps(log, indent=1))
    df = logs.read_drift_log(spark, str(folder / "drift.json"))
    fires = logs.drift_log_first_fires(df)
    assert {tuple(r) for r in fires.collect()} == {("u1", 3), ("u2", 5)}
    assert tuple(logs.drift_log_alerts(df).first()) == (5, 2, 0.5)
    out = f"{checkpoint_dir(spark)}/d-{uuid.uuid4().hex}"
    logs.write_drift_tables(out, first_fires(fires), logs.drift_log_alerts(df), df.select("validation_against_ground_truth.*"))
    assert spark.read.parquet(f"{out}/first_fires").count() == 2


def test_attack_sessions(spark, folder):
    (folder / "s.json").write_text(json.dumps([{"attack_id": "a", "type": "brute_force", "user_id": "u", "n_events": 4}]))
    assert tuple(logs.read_attack_sessions(spark, str(folder / "s.json")).first()) == ("a", "brute_force", "u", 4)
