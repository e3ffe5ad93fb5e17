"""Access-log view over the generic ``events`` table.

Department, host, device, city and attack columns are derived from ids and properties by the rules in
FIXTURES.md, so that every row of the table becomes one access event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.entities import Entities

SPOOFED = '{"os":"os9","browser":"br9","screen":"sc9"}'


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    group = (F.col("user_id") % 5).cast("int")
    e = raw.withColumn("_g", group).withColumns({
        "dept": F.concat(F.lit("d"), group.cast("string")),
        "host": F.when(F.col("k") < 70, F.col("_g") * 18 + F.col("k") % 9)
                 .when(F.col("k") < 85, 90 + F.col("k") % 10)
                 .otherwise((F.col("k") * 7 + F.col("user_id")) % 90).cast("int"),
        "device_id": F.when(F.col("event_id") % 53 == 0, -F.col("event_id") - 1)
                      .otherwise(F.col("user_id") * 2 + F.col("k") % 2),
        "spoofed_fingerprint": F.when(F.col("event_id") % 41 == 0, F.lit(SPOOFED)),
        "status": F.when(F.col("event_type") == "error", "failure").otherwise("success"),
        "_city": F.when(F.col("event_id") % 37 == 0, 6 + F.col("user_id") % 9)
                  .otherwise(F.col("_g")).cast("int"),
        "attack_type": F.when(F.col("event_id") % 41 == 0, "device_spoofing")
                        .when(F.col("event_id") % 37 == 0, "impossible_travel")
                        .when(F.col("event_id") % 53 == 0, "credential_misuse")
                        .when((F.col("event_type") == "error") & (F.col("value") > 100), "brute_force")
                        .when(F.col("k") >= 97, "lateral_movement"),
    })

    return e.withColumns({
        "geo_city": F.concat(F.lit("place"), F.col("_city").cast("string")),
        "geo_lat": F.col("_city") * 37 % 121 - 60.25,
        "geo_lon": F.col("_city") * 83 % 331 - 165.5,
        "geo_country": F.concat(F.lit("land"), (F.col("_city") % 7).cast("string")),
        "label": F.when(F.col("attack_type").isNull(), "normal").otherwise("attack"),
        "attack_id": F.concat_ws("_", "attack_type", F.col("user_id").cast("string"),
                                 F.date_format("ts", "yyyy-MM-dd")),
    }).withColumn("attack_id", F.when(F.col("attack_type").isNotNull(), F.col("attack_id"))).drop(
        "_g", "_city", "k", "event_type", "value")


def access_entities(events: DataFrame) -> Entities:
    """Dimension tables of the users, hosts and devices that occur in the events."""
    users = events.select("user_id", "dept").distinct().withColumns({
        "is_cold_start": F.col("user_id") % 14 == 13,
        "drift_group": F.col("user_id") % 3 == 0,
    })
    hosts = events.select("host").distinct().withColumn(
        "owner_dept",
        F.when(F.col("host") >= 90, F.lit("shared"))
         .otherwise(F.concat(F.lit("d"), F.floor(F.col("host") / 18).cast("string"))))
    devices = events.where("device_id >= 0").select("device_id").distinct().withColumns({
        "os": F.concat(F.lit("os"), (F.col("device_id") % 5).cast("string")),
        "browser": F.concat(F.lit("br"), (F.col("device_id") % 4).cast("string")),
        "screen": F.concat(F.lit("sc"), (F.col("device_id") % 4).cast("string")),
    })
    owned = hosts.where("host < 90").select(F.col("host").alias("src"))
    ring = owned.select("src", ((F.floor(F.col("src") / 18) * 18 + (F.col("src") + 1 - F.floor(
        F.col("src") / 18) * 18) % 18).cast("int")).alias("dst"), F.lit("intra_dept").alias("kind"))
    shared = owned.where("src % 3 = 0").select(
        "src", (90 + F.col("src") % 10).cast("int").alias("dst"), F.lit("shared_link").alias("kind"))
    normal = events.select("user_id", "dept").distinct().select(
        "user_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("_i"), "dept").select(
        "user_id", (F.substring("dept", 2, 9).cast("int") * 18 + F.col("_i")).cast("int").alias("host"))
    return Entities(users, hosts, devices, ring.unionByName(shared), normal)
