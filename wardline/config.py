"""Tunable settings shared by the batch and streaming jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Model input columns, in model order.
FEATURES = [
    "hour_zscore",
    "geo_distance_km",
    "geo_velocity_kmh",
    "time_since_last_event_min",
    "is_new_device",
    "fingerprint_mismatch",
    "is_new_host",
    "is_foreign_dept",
    "is_first_time_in_this_dept",
    "foreign_dept_burst_distinct",
    "new_host_burst_count",
    "graph_dist_from_history",
    "failure_burst_count",
]

# History columns used for calibration, never as model input.
HISTORY_COLUMNS = [
    "entity_history_days",
    "entity_history_event_count",
    "is_cold_start_entity",
    "cold_start_blend_weight",
]

# Event columns carried through to the feature table.
PASSTHROUGH = [
    "event_id", "ts", "user_id", "dept", "host", "device_id",
    "status", "label", "attack_type", "attack_id",
]

# Target classes in class order.
CLASSES = [
    "brute_force", "credential_misuse", "device_spoofing",
    "impossible_travel", "lateral_movement", "normal",
]

# The analyst-facing signal family of every feature.
SIGNAL_FAMILY = {
    "hour_zscore": "time",
    "geo_distance_km": "geo",
    "geo_velocity_kmh": "geo",
    "is_new_device": "device",
    "fingerprint_mismatch": "device",
    "is_new_host": "graph",
    "is_foreign_dept": "graph",
    "is_first_time_in_this_dept": "graph",
    "foreign_dept_burst_distinct": "graph",
    "new_host_burst_count": "graph",
    "graph_dist_from_history": "graph",
    "time_since_last_event_min": "velocity",
    "failure_burst_count": "velocity",
}
FAMILIES = ["time", "geo", "device", "graph", "velocity"]


@dataclass(frozen=True)
class FeatureConfig:
    """Windows, caps and defaults of the causal features."""

    min_history: int = 15
    lateral_window_s: int = 15 * 60
    failure_window_s: int = 5 * 60
    hour_history: int = 500
    dept_history: int = 2000
    default_mean_hour: float = 13.0
    default_std_hour: float = 4.0
    unreachable: int = 99
    # A key with more rows than this is processed in time slices instead of by one task.
    max_rows_per_task: int = 5_000_000
    # Departments are few, so their tasks grow with the log: from this size on they are sliced.
    max_dept_rows_per_task: int = 250_000
    # Rows of light keys that one window task is given; only the number of tasks depends on it.
    window_rows_per_task: int = 100_000
    # Dimension tables with at most this many rows are broadcast.
    broadcast_rows: int = 500_000


@dataclass(frozen=True)
class DriftConfig:
    """Per-entity change detection and the population alarm."""

    feature: str = "hour_zscore"
    delta: float = 0.05
    window_days: int = 7
    alert_fraction: float = 0.15
    # An entity's rows are fed to the detector in slices of at most this many rows.
    max_rows_per_slice: int = 5_000_000
