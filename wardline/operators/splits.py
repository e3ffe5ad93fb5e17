"""Train / validation / test split that keeps every attack session whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import hash_percent
from wardline.operators.skew import SLICE, Agg, fits, lookup, running
from wardline.operators.ranks import MAX_SORTED_ROWS
from wardline.session import cut


def session_split(df: DataFrame, max_rows: int = MAX_SORTED_ROWS) -> DataFrame:
    """(attack_id, clf_split): 20 % test, 20 % validation, rest train per attack type.

    Sessions are ordered by md5 inside their type. The rank is a running count over md5 order, cut
    into hash ranges when there are more sessions than one task should sort.
    """
    sessions = df.where("attack_id is not null").groupBy("attack_id").agg(F.min("attack_type").alias("attack_type"))
    sessions = cut(sessions.withColumn("_h", F.md5(F.col("attack_id").cast("string"))))
    if not fits(sessions, max_rows):
        sessions = sessions.withColumn(SLICE, F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"))
    ranked = running(sessions, ["_h", "attack_id"], (["attack_type"], [Agg("_r", "count", F.lit(1))]))
    sizes = ranked.groupBy("attack_type").agg(F.ceil(F.count(F.lit(1)) * 0.2).alias("_fifth"))
    ranked = ranked.join(F.broadcast(sizes), "attack_type")  # one row per attack type
    return ranked.select("attack_id", F.when(F.col("_r") < F.col("_fifth"), "test")
                         .when(F.col("_r") < 2 * F.col("_fifth"), "val").otherwise("train").alias("clf_split"))


def three_way_split(df: DataFrame) -> DataFrame:
    """Adds clf_split: attack rows by session, normal rows by a stable hash (60/20/20)."""
    sessions = session_split(df)
    pct = hash_percent(F.col("event_id"))
    own = F.when(pct < 20, "test").when(pct < 40, "val").otherwise("train")
    attacks = lookup(df.where("attack_id is not null"), sessions, "attack_id", MAX_SORTED_ROWS, "inner")
    normals = df.where("attack_id is null").withColumn("clf_split", own)
    return attacks.unionByName(normals)


def leaking_sessions(df: DataFrame, split: str = "clf_split") -> DataFrame:
    """Attack sessions found in more than one split; must be empty."""
    return (df.where("attack_id is not null").groupBy("attack_id")
            .agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1"))
