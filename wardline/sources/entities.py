"""Entity metadata: one nested JSON document or ready-made tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entities:
    """Dimension tables of the access log.

    users(user_id, dept, is_cold_start, drift_group), hosts(host, owner_dept),
    devices(device_id, os, browser, screen), edges(src, dst, kind),
    normal_hosts(user_id, host), config(drift_day, ...).
    """

    users: DataFrame
    hosts: DataFrame
    devices: DataFrame
    edges: DataFrame
    normal_hosts: DataFrame | None = None
    config: DataFrame | None = None


_CITY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("country", T.StringType()),
])
_USER = T.StructType([
    T.StructField("dept", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("home_city", _CITY),
    T.StructField("work_start_hr", T.DoubleType()), T.StructField("work_end_hr", T.DoubleType()),
    T.StructField("devices", T.ArrayType(T.StringType())),
    T.StructField("normal_hosts", T.ArrayType(T.StringType())),
    T.StructField("drift_group", T.BooleanType()), T.StructField("is_cold_start", T.BooleanType()),
    T.StructField("broad_access", T.BooleanType()),
    T.StructField("broad_access_hosts", T.ArrayType(T.StringType())),
    T.StructField("upgrade_device", T.StringType()), T.StructField("upgrade_day", T.IntegerType()),
    T.StructField("post_drift_city", _CITY),
    T.StructField("post_drift_start_hr", T.DoubleType()), T.StructField("post_drift_end_hr", T.DoubleType()),
])
_DEVICE = T.StructType([
    T.StructField("owner", T.StringType()),
    T.StructField("fingerprint", T.StructType([
        T.StructField("os", T.StringType()), T.StructField("browser", T.StringType()),
        T.StructField("screen", T.StringType())])),
])
# A city and an edge are arrays of mixed types in the file; they are read as text and parsed below.
_USER_RAW = T.StructType([
    T.StructField(f.name, T.ArrayType(T.StringType()) if f.dataType == _CITY else f.dataType)
    for f in _USER.fields])
ENTITY_SCHEMA = T.StructType([
    T.StructField("users", T.MapType(T.StringType(), _USER_RAW)),
    T.StructField("devices", T.MapType(T.StringType(), _DEVICE)),
    T.StructField("dept_hosts", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("shared_hosts", T.ArrayType(T.StringType())),
    T.StructField("graph_edges", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("config", T.StructType([
        T.StructField("drift_day", T.IntegerType()), T.StructField("cold_start_day", T.IntegerType()),
        T.StructField("start_date", T.StringType()), T.StructField("sim_days", T.IntegerType())])),
])


def host_owners(dept_hosts: DataFrame, shared_hosts: DataFrame) -> DataFrame:
    """host -> owning department; shared hosts override any department."""
    every = dept_hosts.select("host", F.col("dept").alias("owner_dept"), F.lit(0).alias("_p")).unionByName(
        shared_hosts.select("host", F.lit("shared").alias("owner_dept"), F.lit(1).alias("_p")))
    return every.groupBy("host").agg(F.max_by("owner_dept", F.struct("_p", "owner_dept")).alias("owner_dept"))


def _city(parts):
    return F.struct(parts[0].alias("name"), parts[1].cast("double").alias("lat"),
                    parts[2].cast("double").alias("lon"), parts[3].alias("country"))


def read_entities(spark: SparkSession, path: str) -> Entities:
    """Normalises the nested entity document into dimension tables."""
    doc = spark.read.schema(ENTITY_SCHEMA).option("multiLine", True).json(path)
    users = doc.select(F.explode("users").alias("user_id", "u")).select("user_id", "u.*")
    users = users.withColumns({
        "home_city": _city(F.col("home_city")),
        "post_drift_city": F.when(F.col("post_drift_city").isNotNull(), _city(F.col("post_drift_city"))),
        "is_cold_start": F.coalesce("is_cold_start", F.lit(False)),
        "drift_group": F.coalesce("drift_group", F.lit(False)),
    })
    devices = (doc.select(F.explode("devices").alias("device_id", "d"))
               .select("device_id", "d.owner", "d.fingerprint.*"))
    dept_hosts = (doc.select(F.explode("dept_hosts").alias("dept", "hs"))
                  .select("dept", F.explode("hs").alias("host")))
    shared = doc.select(F.explode("shared_hosts").alias("host"))
    edge = doc.select(F.explode("graph_edges").alias("e"))
    edges = edge.select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"),
                        F.from_json(F.col("e")[2], "kind string")["kind"].alias("kind"))
    normal = users.select("user_id", F.explode("normal_hosts").alias("host"))
    return Entities(users, host_owners(dept_hosts, shared), devices, edges, normal, doc.select("config.*"))
