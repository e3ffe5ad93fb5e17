"""Raw log to feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.config import FEATURES, HISTORY_COLUMNS, PASSTHROUGH, FeatureConfig
from wardline.operators.causal import add_dept_prior, add_fingerprint_mismatch, add_user_history, enrich
from wardline.operators.graph import first_visits, nearest_visited
from wardline.operators.skew import heavy_keys, with_row_key
from wardline.sources.entities import Entities

INT_FEATURES = {"is_new_device", "fingerprint_mismatch", "is_new_host", "is_foreign_dept",
                "is_first_time_in_this_dept", "foreign_dept_burst_distinct", "new_host_burst_count",
                "graph_dist_from_history", "failure_burst_count"}


def feature_table(events: DataFrame, entities: Entities, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """The 13 behavioural features and 4 history columns of every event.

    One shuffle each by department, device and user; the graph distance is worked out on the first
    visits only and joined back by user and host. Key columns that hold more rows than one task should
    process are found by one narrow count each and scanned in time slices.
    """
    keyed = events.select("user_id", "device_id", "dept", F.unix_micros("ts").alias("us"), "event_id", "host")
    total = events.count()
    heavy_users = heavy_keys(keyed, "user_id", "us", cfg.max_rows_per_task, total)
    heavy_devices = heavy_keys(keyed, "device_id", "us", cfg.max_rows_per_task, total)

    e = enrich(events, entities.users, entities.hosts, entities.devices, cfg)
    heavy_depts = heavy_keys(e.select("home_dept", "us"), "home_dept", "us",
                             min(cfg.max_rows_per_task, cfg.max_dept_rows_per_task), total)
    tasks = max(1, -(-total // cfg.window_rows_per_task))
    if heavy_users is not None or heavy_devices is not None or heavy_depts is not None:
        e = with_row_key(e)
    e = add_dept_prior(e, cfg, heavy_depts)
    e = add_fingerprint_mismatch(e, cfg, heavy_devices, tasks)
    e = add_user_history(e, cfg, heavy_users, tasks)
    reach = nearest_visited(first_visits(keyed), entities.edges, cfg)
    reach = reach.select(F.col("user_id").alias("_user"), F.col("host").alias("_host"), "graph_dist_from_history")
    first = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("host").eqNullSafe(F.col("_host")) & (F.col("is_new_host") == 1)
    e = e.join(reach, first, "left").withColumn(
        "graph_dist_from_history", F.coalesce("graph_dist_from_history", F.lit(0)).cast("int"))
    return e.select(*PASSTHROUGH, *FEATURES, *HISTORY_COLUMNS)
