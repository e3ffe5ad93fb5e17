"""Keyed stateful jobs on event streams: the online twins of the causal features and the drift scan.

Rows of a key wait until the watermark has passed them and are then handled in (time, event_id) order,
so that a stream gives the values of the batch job whatever the order of arrival. Rows behind the
watermark are dropped by the engine; ``late_events`` collects them in a side table.
"""

from __future__ import annotations

import datetime as dt
import heapq
import math
import pickle
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wardline.config import DriftConfig, FeatureConfig
from wardline.functions.adwin import Adwin
from wardline.functions.scalars import HOUR_TO_RADIANS
from wardline.operators.causal import history_columns

US = 1_000_000
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark passes them; subclasses handle one row at a time.

    Waiting rows lie in entries of at most ``CHUNK`` rows in time order, each under the time its first row is due, with one
    timer. The first timer of a key hands on all rows that are due, so state is read and written once a key and batch."""

    CHUNK, GATHER = 1_000, 100_000  # rows of an entry, and rows that are sorted at a time

    def __init__(self, columns: list[str], out: list[str]):
        self.columns, self.out = columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due long", "rows binary")
        self.open(handle)

    def _hold(self, rows: list[tuple]) -> None:
        rows.sort(key=_place)
        for at in range(0, len(rows), self.CHUNK):
            part = rows[at:at + self.CHUNK]
            due = _due(part[0])
            if self.waiting.containsKey((due,)):
                part = pickle.loads(bytes(self.waiting.getValue((due,))[0])) + part
                part.sort(key=_place)
            self.waiting.updateValue((due,), (pickle.dumps(part),))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: list[tuple] = []
        for r in rows:
            new.append(tuple(None if v is None or v != v else v for v in (r[c] for c in self.columns)))
            if len(new) == self.GATHER:
                self._hold(new)
                new = []
        if new:
            self._hold(new)
        return iter(())

    def _ready(self, watermark: int) -> Iterator[tuple]:
        """Takes the rows that are due out of the state, in order; at no time more than entries that overlap are held."""
        dues = sorted(k[0] for k in self.waiting.keys())
        held: list[tuple] = []  # a heap of (place, number, row): numbers keep entirely equal places apart
        left, number = [], 0
        for due in dues:
            if due > watermark:
                break
            while held and _due(held[0][2]) < due:
                yield heapq.heappop(held)[2]
            for r in pickle.loads(bytes(self.waiting.getValue((due,))[0])):
                if _due(r) > watermark:
                    left.append(r)
                else:
                    heapq.heappush(held, (_place(r), number, r))
                    number += 1
            self.waiting.removeKey((due,))
        while held:
            yield heapq.heappop(held)[2]
        if left:
            self._hold(left)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Later timers of the key find nothing: the first has handed on what was due."""
        if not self.waiting.containsKey((expiredTimerInfo.getExpiryTimeInMs(),)):
            return
        self.load()
        named = Row(*self.out)
        for r in self._ready(timerValues.getCurrentWatermarkInMs()):
            for done in self.row(key[0], dict(zip(self.columns, r, strict=True))):
                yield named(*done)
        self.store()

    def close(self) -> None:
        pass


def _due(row: tuple) -> int:
    """The watermark in ms that has passed the row's second."""
    return (row[0] // US + 1) * 1000


def _place(row: tuple) -> tuple:
    """(time, event_id), without an id first."""
    return row[0], row[1] is not None, row[1] or 0


def _time(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def _run(df: DataFrame, key: str, processor: StatefulProcessor, out: T.StructType) -> DataFrame:
    return df.groupBy(key).transformWithState(
        statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime")


def prepared(events: DataFrame, delay: str) -> DataFrame:
    """Watermark on a proper timestamp, and the order column."""
    return (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
            .withColumn("us", F.unix_micros("ts")))


# ---- user features -----------------------------------------------------------------------------

class Recent:
    """Happenings of a bounded time, counted by kind; each goes when its time is over."""

    def __init__(self):
        self.happened, self.kinds = deque(), Counter()

    def add(self, us: int, kind=None) -> None:
        self.happened.append((us, kind))
        self.kinds[kind] += 1

    def forget(self, before: int) -> Recent:
        while self.happened and self.happened[0][0] < before:
            kind = self.happened.popleft()[1]
            self.kinds[kind] -= 1
            if not self.kinds[kind]:
                del self.kinds[kind]
        return self


class RecentHours:
    """Sums of sine and cosine over the latest hours; the oldest is taken off as a new one comes."""

    def __init__(self, most: int):
        self.most, self.points, self.sums = most, deque(), (0.0, 0.0)

    def add(self, hour: float) -> None:
        new = math.sin(hour * HOUR_TO_RADIANS), math.cos(hour * HOUR_TO_RADIANS)
        old = self.points.popleft() if len(self.points) == self.most else (0.0, 0.0)
        self.points.append(new)
        self.sums = tuple(total + come - gone for total, come, gone in zip(self.sums, new, old, strict=True))


USER_INPUT = ["us", "event_id", "hour", "geo_lat", "geo_lon", "device_id", "host", "owner_dept",
              "is_foreign_dept", "status", "prior_mean", "prior_std"]
USER_OUTPUT = ("hour_zscore double, geo_distance_km double, geo_velocity_kmh double, "
               "time_since_last_event_min double, is_new_device int, is_new_host int, is_foreign_dept int, "
               "is_first_time_in_this_dept int, foreign_dept_burst_distinct int, new_host_burst_count int, "
               "failure_burst_count int, entity_history_days double, entity_history_event_count int, "
               "is_cold_start_entity int, cold_start_blend_weight double")


CARRIED = ["us", "event_id", "hour", "geo_lat", "geo_lon", "is_foreign_dept", "prior_mean", "prior_std"]
USER_STATE = ("_n long, _first_us long, _last struct<us: long, geo_lat: double, geo_lon: double>, _sin double, _cos double, "
              "_dev_n int, _host_n int, _dept_n int, foreign_dept_burst_distinct int, new_host_burst_count int, "
              "failure_burst_count int")


class UserHistory(InOrder):
    """Hands each event on with what was known of its user before it; features follow from that as column expressions.

    State per user: depth, first and last event, sums of recent hours and recent happenings in one value, and a map of
    things seen."""

    def __init__(self, cfg: FeatureConfig, out: list[str]):
        super().__init__(USER_INPUT, out)
        self.cfg = cfg

    def open(self, handle) -> None:
        self.known = handle.getValueState("known", "body binary")
        self.seen = handle.getMapState("seen", "item string", "first_us long")

    def load(self) -> None:
        if self.known.exists():
            self.depth, self.first, self.last, self.hours, self.recent = pickle.loads(bytes(self.known.get()[0]))
        else:
            self.depth, self.first, self.last = 0, None, None
            self.hours = RecentHours(self.cfg.hour_history)
            self.recent = {name: Recent() for name in ("foreign", "new_host", "failure")}
        self.fresh, self.met = self.depth == 0, set()  # met: what is known to be in ``seen``, without asking again

    def store(self) -> None:
        self.known.update((pickle.dumps((self.depth, self.first, self.last, self.hours, self.recent)),))

    def _seen_before(self, kind: str, item, us: int) -> int:
        name = f"{kind}:{item}"
        if name in self.met:
            return 1
        self.met.add(name)
        if not self.fresh and self.seen.containsKey((name,)):
            return 1
        self.seen.updateValue((name,), (us,))
        return 0

    def row(self, user, r):
        us, recent = r["us"], self.recent
        seen = [self._seen_before(kind, r[column], us)
                for kind, column in (("device", "device_id"), ("host", "host"), ("dept", "owner_dept"))]
        lateral = us - self.cfg.lateral_window_s * US
        yield (user, _time(us), *[r[c] for c in CARRIED], self.depth, self.first, self.last,
               *self.hours.sums, *seen, len(recent["foreign"].forget(lateral).kinds),
               len(recent["new_host"].forget(lateral).happened),
               len(recent["failure"].forget(us - self.cfg.failure_window_s * US).happened))
        for name, kind, holds in (("foreign", r["owner_dept"], r["is_foreign_dept"]), ("new_host", None, not seen[1]),
                                  ("failure", None, r["status"] == "failure")):
            if holds:
                recent[name].add(us, kind)
        self.hours.add(r["hour"])
        self.first = us if self.first is None else self.first
        self.last = {"us": us, "geo_lat": r["geo_lat"], "geo_lon": r["geo_lon"]}
        self.depth += 1


def user_features(events: DataFrame, delay: str = "10 minutes", cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Online user features of enriched events that already carry prior_mean and prior_std."""
    df = prepared(events, delay)
    out = T.StructType([df.schema["user_id"], T.StructField("ts", T.TimestampType()), *[df.schema[c] for c in CARRIED],
                        *T._parse_datatype_string(USER_STATE).fields])
    known = _run(df.select("user_id", "ts", *USER_INPUT), "user_id", UserHistory(cfg, out.names), out)
    return known.withColumns(history_columns(F.col("_sin"), F.col("_cos"), cfg)).select(
        "user_id", "event_id", "ts", *[c.split()[0] for c in USER_OUTPUT.split(", ")])


def with_hour_prior(events: DataFrame, snapshot: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Department prior from a periodic batch snapshot (home_dept, prior_mean, prior_std): departments
    are few and busy, so a keyed state would serialise the stream."""
    joined = events.join(F.broadcast(snapshot), "home_dept", "left")  # one row per department
    return joined.withColumns({"prior_mean": F.coalesce("prior_mean", F.lit(cfg.default_mean_hour)),
                               "prior_std": F.coalesce("prior_std", F.lit(cfg.default_std_hour))})


# ---- device fingerprints -------------------------------------------------------------------------

class FingerprintHistory(InOrder):
    """State per device: fingerprint -> (times seen, place of the first), and the usual one so far."""

    def open(self, handle) -> None:
        self.fps = handle.getMapState("fps", "fp string", "n long, place long")
        self.usual = handle.getValueState("usual", "events long, fp string, n long, place long")

    def load(self) -> None:
        kept = self.usual.get() if self.usual.exists() else None
        self.events, self.fp, self.n, self.place = kept or (0, None, 0, 0)
        self.fresh, self.met = kept is None, {}  # met: fingerprints of this batch, written at its end

    def store(self) -> None:
        for fp, value in self.met.items():
            self.fps.updateValue((fp,), value)
        self.usual.update((self.events, self.fp, self.n, self.place))

    def row(self, device, r):
        fp, wrong = r["fp"], 0
        if fp is not None:
            wrong = int(self.fp is not None and fp != self.fp)
            if fp not in self.met:
                known = not self.fresh and self.fps.containsKey((fp,))
                self.met[fp] = tuple(self.fps.getValue((fp,))) if known else (0, self.events)
            n, place = self.met[fp]
            self.met[fp] = n + 1, place
            if (n + 1, -place) > (self.n, -self.place):  # only this one's count has grown
                self.fp, self.n, self.place = fp, n + 1, place
            self.events += 1
        yield device, r["event_id"], _time(r["us"]), wrong


def fingerprint_mismatch(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Online (device_id, event_id, ts, fingerprint_mismatch) from the claimed fingerprint ``fp`` (struct)."""
    df = prepared(events, delay).withColumn("fp", F.when(F.col("fp").isNotNull(), F.to_json("fp")))
    columns = ["us", "event_id", "fp"]
    out = T.StructType([T.StructField("device_id", df.schema["device_id"].dataType),
                        T.StructField("event_id", df.schema["event_id"].dataType),
                        T.StructField("ts", T.TimestampType()), T.StructField("fingerprint_mismatch", T.IntegerType())])
    return _run(df.select("device_id", "ts", *columns), "device_id",
                FingerprintHistory(columns, out.names), out)


# ---- drift -----------------------------------------------------------------------------------------

class DriftDetector(InOrder):
    """State per user: the change detector and whether it has fired before."""

    def __init__(self, delta: float, columns, out):
        super().__init__(columns, out)
        self.delta = delta

    def open(self, handle) -> None:
        self.body = handle.getValueState("detector", "body binary, fired boolean")

    def load(self) -> None:
        kept = self.body.get() if self.body.exists() else None
        self.detector, self.fired = (pickle.loads(bytes(kept[0])), kept[1]) if kept else (Adwin(self.delta), False)

    def store(self) -> None:
        self.body.update((pickle.dumps(self.detector), self.fired))

    def row(self, user, r):
        if r["x"] is not None and self.detector.update(float(r["x"])):
            yield user, _time(r["us"]), not self.fired
            self.fired = True


def drift_fires(features: DataFrame, delay: str = "10 minutes", cfg: DriftConfig = DriftConfig()) -> DataFrame:
    """Online (user_id, ts, is_first) of every detection on normal rows."""
    df = prepared(features.where("label = 'normal'"), delay).withColumn("x", F.col(cfg.feature).cast("double"))
    columns = ["us", "event_id", "x"]
    out = T.StructType([T.StructField("user_id", df.schema["user_id"].dataType),
                        T.StructField("ts", T.TimestampType()), T.StructField("is_first", T.BooleanType())])
    return _run(df.select("user_id", "ts", *columns), "user_id",
                DriftDetector(cfg.delta, columns, out.names), out)
