"""Exact ranks, percentiles and quantiles of a column without a one-task sort.

All work is done on the distinct values with their counts (combined on the map side). Many distinct
values are cut into ordered bins, scanned per bin, and the bin totals carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.skew import SLICE, Agg, fits, lookup, order_bins, running
from wardline.session import cut

MAX_SORTED_ROWS = 500_000


def _cumulate(counts: DataFrame, keys: list[str], value: str, sums: list[str],
              max_rows: int = MAX_SORTED_ROWS) -> DataFrame:
    """Adds ``before_<c>``: the sum of ``c`` over smaller values of the same keys."""
    counts = cut(counts)
    if not fits(counts, max_rows):
        counts = order_bins(counts, value)
    out = running(counts, [value], (keys, [Agg(f"before_{c}", "sum", F.col(c)) for c in sums]))
    return out.drop(SLICE)


def percentile_rank(df: DataFrame, score: str, out: str, is_reference: Column,
                    broadcast_rows: int = 500_000, max_rows: int = MAX_SORTED_ROWS) -> DataFrame:
    """Adds ``out`` = 100 * share of reference rows with a score <= the row's score."""
    counts = (df.groupBy(score).agg(F.sum(is_reference.cast("long")).alias("n")).where(F.col(score).isNotNull()))
    ranked = cut(_cumulate(counts, [], score, ["n"], max_rows))
    total = ranked.agg(F.sum("n").alias("_total"))
    rank = ranked.join(F.broadcast(total)).select(  # one-row total
        score, (100.0 * (F.col("before_n") + F.col("n")) / F.col("_total")).alias(out))
    return lookup(df, rank, score, broadcast_rows)


def auc(df: DataFrame, score: str, positive: Column, weight: str | None = None,
        max_rows: int = MAX_SORTED_ROWS) -> DataFrame:
    """One row with the area under the ROC curve; ties count one half. ``weight`` names a column with
    the number of rows a row stands for."""
    w = F.col(weight) if weight else F.lit(1)
    counts = df.groupBy(score).agg(F.sum(F.when(positive, w).otherwise(0)).alias("p"),
                                   F.sum(F.when(positive, 0).otherwise(w)).alias("n"))
    won = F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2.0))
    return _cumulate(counts, [], score, ["n"], max_rows).agg(
        (won / (F.sum("p") * F.sum("n").cast("double"))).alias("auc"))


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
              weight: str | None = None, max_rows: int = MAX_SORTED_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles (``name -> p``) of a column, per group of ``by``."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(w).cast("long").alias("c"))
    cum = cut(_cumulate(counts, by, value, ["c"], max_rows))
    sizes = cum.groupBy(*by).agg(F.sum("c").alias("_n"))
    cum = lookup(cum, sizes, by, max_rows) if by else cum.join(F.broadcast(sizes))  # one-row size

    def at(rank: Column) -> Column:
        holds = (F.col("before_c") <= rank) & (rank < F.col("before_c") + F.col("c"))
        return F.max(F.when(holds, F.col(value)))

    picks = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        picks.append((low + (high - low) * F.max(h - F.floor(h))).alias(name))
    return cum.groupBy(*by).agg(*picks)
