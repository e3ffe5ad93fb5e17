"""Features of a day from the state of the day before, against the job over the whole log."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wardline.operators.increment import State, advance, day_features, read_state, write_state
from wardline.operators.skew import union_all
from wardline.plans.features import feature_table
from wardline.plans.results import TEST_CONFIG
from wardline.sources.events import access_entities, access_events


def _log(spark, sf_dir, case=""):
    """Some hundred events; the case changes keys or times."""
    events = access_events(spark, sf_dir).where("event_id < 240")
    k = F.col("event_id") % 10
    if case == "null keys":
        events = events.withColumns({"user_id": F.when(k > 3, F.col("user_id")), "device_id": F.when(k > 1, F.col("device_id"))})
    if case == "heavy user":
        events = events.withColumn("user_id", F.when(k < 5, F.lit(7)).otherwise(F.col("user_id")))
    if case == "ties":
        events = events.withColumn("ts", F.date_trunc("day", "ts"))
    return events.withColumn("_n", F.lit("of the caller"))


def _in_parts(events, entities, cfg, cuts, folder):
    us, before, parts = F.unix_micros("ts"), None, []
    for i, (start, end) in enumerate(zip([None, *cuts], [*cuts, None])):
        rows = events if start is None else events.where(us >= start)
        rows = rows if end is None else rows.where(us < end)
        parts.append(advance(rows, entities, before, f"{folder}/{i}", cfg, end))
        before = f"{folder}/{i}"
    return union_all(parts)


@pytest.mark.parametrize("case", ["plain", "null keys", "heavy user", "ties"])
def test_parts_equal_the_whole(spark, sf_dir, tmp_path, case):
    """Cuts in the middle, for the plain log also right before an empty stretch; the heavy case is scanned in slices."""
    events = _log(spark, sf_dir, case)
    entities = access_entities(_log(spark, sf_dir))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    middle = events.where(F.unix_micros("ts") >= (low + high) // 2).agg(F.min(F.unix_micros("ts"))).first()[0]
    cuts = [low + (high - low) // 4, middle - 1, middle] if case == "plain" else [middle]
    cfg = replace(TEST_CONFIG, hour_history=9, dept_history=30, max_rows_per_task=30 if case == "heavy user" else 5_000_000)
    whole = feature_table(events, entities, replace(cfg, max_rows_per_task=5_000_000))
    parts = _in_parts(events, entities, cfg, cuts, tmp_path)
    want = sorted(map(str, whole.select(sorted(whole.columns)).collect()))
    assert len(want) == 240
    assert sorted(map(str, parts.select(sorted(whole.columns)).collect())) == want


def test_state_is_bounded_by_its_windows(spark, sf_dir):
    events = _log(spark, sf_dir)
    cfg = replace(TEST_CONFIG, hour_history=3, dept_history=5)
    _, state = day_features(events, access_entities(events), State({}), cfg)
    assert state.tables["user_hours"].groupBy("user_id").count().agg(F.max("count")).first()[0] == 3
    assert state.tables["dept_hours"].groupBy("home_dept").count().agg(F.max("count")).first()[0] == 5
    assert state.tables["recent"].agg(F.min("us")).first()[0] >= state.until - 3 * 86_400_000_000


def test_late_undated_and_empty_days(spark, sf_dir, tmp_path):
    """Rows before the day or without a time are refused; an empty first day and an empty later day give no rows."""
    events = _log(spark, sf_dir)
    entities = access_entities(events)
    assert advance(events.limit(0), entities, None, f"{tmp_path}/0", TEST_CONFIG, 0).count() == 0
    advance(events, entities, f"{tmp_path}/0", f"{tmp_path}/1", TEST_CONFIG)
    with pytest.raises(ValueError, match="240 rows lie before the day"):
        advance(events, entities, f"{tmp_path}/1", f"{tmp_path}/2", TEST_CONFIG)
    undated = events.withColumn("ts", F.when(F.col("event_id") > 0, F.col("ts")))
    with pytest.raises(ValueError, match="1 rows lie before the day or have no time"):
        advance(undated, entities, None, f"{tmp_path}/2", TEST_CONFIG)
    assert advance(events.limit(0), entities, f"{tmp_path}/1", f"{tmp_path}/2", TEST_CONFIG).count() == 0
    same = [sorted(map(str, read_state(spark, f"{tmp_path}/{i}").tables["users"].collect())) for i in (1, 2)]
    assert same[0] == same[1] and len(same[0]) == entities.users.count()


def test_half_written_state_is_not_read(spark, sf_dir, tmp_path):
    """A run that failed before its last table left no state; the next run writes it anew, and then it stays."""
    events = _log(spark, sf_dir)
    _, state = day_features(events, access_entities(events), State({}), TEST_CONFIG)
    state.tables["users"].limit(1).write.parquet(f"{tmp_path}/s/users")
    with pytest.raises(FileNotFoundError):
        read_state(spark, f"{tmp_path}/s")
    write_state(state, f"{tmp_path}/s")
    assert read_state(spark, f"{tmp_path}/s").tables["users"].count() == state.tables["users"].count()
    with pytest.raises(ValueError, match="already holds"):
        write_state(state, f"{tmp_path}/s")
