"""Score references from daily quantile sketches: what a window of days needs is merged, and no old row is read again.

A sketch (Karnin, Lang and Liberty, 2016) holds a few thousand values whatever the number of rows, is built on the
map side and merges with others. Exact ranks (``ranks.quantiles``) stay the default; this is for histories that are too
long to be read each day.

Null and NaN scores are not counted. A window ends on its day, both ends included; days without rows have one while
an earlier day is still inside. Rows that share everything count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.scalars import clip, round_to
from wardline.operators.scoring import GLOBAL, is_normal
from wardline.operators.skew import lookup

#: Size parameter of a sketch; one of this size takes at most about 25 KB.
K = 800


def rank_error(k: int = K) -> float:
    """The stated bound on the error of a rank, as a share of the rows.

    A sketch of size k is within 2.296 / k ** 0.9723 in 99 of 100 asked ranks (2.6 deviations); the bound is
    2.5 times that, beyond six deviations.
    """
    return 2.5 * 2.296 / k ** 0.9723


def established_normals() -> Column:
    return is_normal() & (F.col("is_cold_start_entity") == 0)


def daily_sketches(rows: DataFrame, score: str = "ensemble_score_raw", by: str = "dept", k: int = K) -> DataFrame:
    """(day, ``by``, sketch): one sketch per day and group of the rows given."""
    value = F.col(score).cast("double")
    return (rows.where(value.isNotNull() & ~F.isnan(value))
            .groupBy(F.to_date("ts").alias("day"), by).agg(F.kll_sketch_agg_double(value, k).alias("sketch")))


def add_batch(rows: DataFrame, folder: str, batch: str, score: str = "ensemble_score_raw", by: str = "dept", k: int = K) -> None:
    """Stores the sketches of a batch of rows. A batch that is run again replaces its own sketches; late rows of an
    earlier day are one more sketch of that day."""
    daily_sketches(rows, score, by, k).write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def stored_sketches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def seen_on(df: DataFrame, days: int) -> DataFrame:
    """Hands every row on to the days whose window holds it: its own and the ``days`` - 1 after, up to the last day of the table."""
    last = df.agg(F.max("day").alias("_last"))
    ends = F.explode(F.sequence(F.col("day"), F.least(F.date_add("day", days - 1), F.col("_last"))))
    return df.join(F.broadcast(last)).withColumn("day", ends).drop("_last")  # one row


def with_global(df: DataFrame, by: str = "dept") -> DataFrame:
    """Every row for its group and once more for all groups."""
    return df.withColumn(by, F.explode(F.array(F.col(by), F.lit(GLOBAL))))


def window_references(sketches: DataFrame, days: int = 7, probs: dict[str, float] | None = None, by: str = "dept",
                      k: int = K) -> DataFrame:
    """(day, ``by``, n, one column a quantile, sketch) of the window that ends on each day, also for all groups together.

    The input is one small row per batch, day and group, so the work is days x groups x window length.
    """
    merged = (seen_on(with_global(sketches.select("day", by, "sketch"), by), days)
              .groupBy("day", by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch")))
    picks = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name)
             for name, p in (probs or {"ref_score": 0.5}).items()]
    return merged.select("day", by, F.kll_sketch_get_n_double("sketch").alias("n"), *picks, "sketch")


def blend_as_of(df: DataFrame, references: DataFrame, score: str = "ensemble_score_raw", by: str = "dept",
                broadcast_rows: int = 500_000) -> DataFrame:
    """final_risk_score from the window that ended the day before a row: its group's, else the one of all groups,
    else (no day before) the score itself."""
    named = references.select(F.date_add("day", 1).alias("_day"), by, "ref_score")
    own = named.where(F.col(by) != GLOBAL)
    general = named.where(F.col(by) == GLOBAL).select("_day", F.col("ref_score").alias("_general"))
    out = lookup(df.withColumn("_day", F.to_date("ts")), own, ["_day", by], broadcast_rows)
    out = lookup(out, general, ["_day"], broadcast_rows)
    w = clip(F.col("cold_start_blend_weight"), 0.0, 1.0)
    mixed = w * F.col(score) + (1 - w) * F.coalesce("ref_score", "_general", score)
    return out.withColumn("final_risk_score", round_to(clip(mixed, 0.0, 100.0), 2)).drop("ref_score", "_general", "_day")
