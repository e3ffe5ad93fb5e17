"""Ordered running aggregates that survive a key holding a large share of all rows.

A window partitioned by a key puts the whole key into one task. ``running`` computes the same
exclusive running aggregates ("everything strictly before this row") in two phases when the key has
heavy members: rows of a heavy key are sliced by time, each slice is scanned on its own, and the
totals of the earlier slices (one row per slice) are added. Light keys stay one slice, so a table
without heavy keys gets the plain window plan with a single shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import cut, stored

SLICE = "_slice"
ROW = "_row"
# Slice widths in seconds, widest first.
WIDTHS = [30 * 86_400, 7 * 86_400, 86_400, 6 * 3_600, 3_600, 600, 60, 1]


@dataclass(frozen=True)
class Agg:
    """One running aggregate: ``kind`` is sum, count, min, max or last."""

    name: str
    kind: str
    expr: Column


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows. A plain count combines on the map side; a limit
    of this size would first pull that many rows from every partition into one task."""
    return df.count() <= rows


def same_keys(fact: DataFrame, dim: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join by equal keys where null equals null; the key columns are those of ``fact``."""
    own = dim.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    equal = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return fact.join(own, equal, how).drop(*[f"_same_{k}" for k in keys])


def with_row_key(df: DataFrame) -> DataFrame:
    """A key of each row's own, written out so that it stays; other ids may repeat or be null."""
    return df if ROW in df.columns else stored(df.withColumn(ROW, F.monotonically_increasing_id()))


def lookup(fact: DataFrame, dim: DataFrame, on, broadcast_rows: int, how: str = "left", nulls: bool = False) -> DataFrame:
    """Dimension join: broadcast a dimension of checked size, otherwise leave the join to AQE,
    whose skew split handles heavy fact keys. ``nulls``: a null key is a key like others."""
    if fits(dim.select(*([on] if isinstance(on, str) else on)), broadcast_rows):
        dim = F.broadcast(dim)
    if nulls:
        return same_keys(fact, dim, [on] if isinstance(on, str) else list(on), how)
    return fact.join(dim, on, how)


def heavy_keys(df: DataFrame, key: str, us: str, max_rows: int,
               total: int | None = None) -> DataFrame | None:
    """Keys with more than ``max_rows`` rows and the widest time slice that keeps each of their
    slices within that size; None when there are none. At most rows/max_rows keys come back.
    ``total`` saves the row count when it is known."""
    rows = df.select(F.col(key), F.floor(F.col(us) / 1_000_000).alias("_sec"))
    if (rows.count() if total is None else total) <= max_rows:
        return None
    heavy = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows))
    if heavy.isEmpty():
        return None
    widths = F.explode(F.array(*[F.lit(w) for w in WIDTHS])).alias("_width")
    return cut(
        same_keys(rows, heavy.select(key), [key], "left_semi")
        .groupBy(key, "_sec").agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_sec", "_n", widths)
        .groupBy(key, "_width", F.floor(F.col("_sec") / F.col("_width")).alias("_bin"))
        .agg(F.sum("_n").alias("_n"))
        .groupBy(key, "_width").agg(F.max("_n").alias("_n"))
        .where((F.col("_n") <= max_rows) | (F.col("_width") == WIDTHS[-1]))
        .groupBy(key).agg(F.max("_width").alias("_width"))
    )


def with_slice(df: DataFrame, key: str, us: str, heavy: DataFrame,
               broadcast_rows: int = 500_000) -> DataFrame:
    """Adds the slice number; light keys get slice 0."""
    joined = lookup(df, heavy, key, broadcast_rows, nulls=True)
    number = F.floor(F.col(us) / 1_000_000 / F.col("_width")).cast("long")
    return joined.withColumn(SLICE, F.coalesce(number, F.lit(0))).drop("_width")


def dealt(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """``df`` dealt by ``key`` over a fixed number of tasks, which adaptive plans would merge by their compressed size."""
    return df if tasks is None else df.repartition(tasks, key)


def per_key(df: DataFrame, key: str, us: str, heavy: DataFrame | None, step,
            broadcast_rows: int = 500_000, tasks: int | None = None) -> DataFrame:
    """Runs ``step`` on the rows of the light keys, dealt over ``tasks``, and on those of the heavy keys with
    slices. Without heavy keys the table is otherwise passed through untouched."""
    if heavy is None:
        return step(dealt(df, key, tasks))
    df = cut(df)
    light = dealt(lookup(df, heavy.select(key), key, broadcast_rows, "left_anti", nulls=True), key, tasks)
    sliced = with_slice(lookup(df, heavy.select(key), key, broadcast_rows, "left_semi", nulls=True), key, us, heavy,
                        broadcast_rows)
    return step(light).unionByName(step(sliced).drop(SLICE))


def fold(agg: Agg) -> Column:
    if agg.kind == "sum":
        return F.sum(agg.expr)
    if agg.kind == "count":
        return F.count(agg.expr)
    if agg.kind == "min":
        return F.min(agg.expr)
    return F.max(agg.expr)


def merge(agg: Agg, local: Column, before: Column) -> Column:
    if agg.kind in ("sum", "count"):
        zero = F.lit(0)
        return F.coalesce(before, zero) + F.coalesce(local, zero)
    if agg.kind == "min":
        return F.least(before, local)
    if agg.kind == "max":
        return F.greatest(before, local)
    return F.coalesce(local, before)


def running(df: DataFrame, order: list[str], *groups: tuple[list[str], list[Agg]]) -> DataFrame:
    """Adds aggregates over the rows strictly before each row in ``order``, among the rows with the
    same keys; ``groups`` lists (keys, aggregates) pairs.

    ``last`` expects a struct that starts with the order columns. Sums and counts of no rows are 0,
    the others null. When ``df`` carries the slice column it is written out once, scanned per slice,
    and each row gets the totals of its key's earlier slices by an equality join.
    """
    if SLICE not in df.columns:
        for keys, aggs in groups:
            df = df.withColumns({
                a.name: F.coalesce(_local(a, keys, order), F.lit(0)) if a.kind in ("sum", "count")
                else _local(a, keys, order) for a in aggs})
        return df

    df = cut(df)
    out = df
    for keys, aggs in groups:
        out = out.withColumns({a.name: _local(a, keys + [SLICE], order) for a in aggs})
    for keys, aggs in groups:
        totals = df.groupBy(*keys, SLICE).agg(*[fold(a).alias(f"_t_{a.name}") for a in aggs])
        earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(SLICE).alias("_k_slice"),
            F.count(F.lit(1)).over(earlier).alias("_rank"),
            *[fold(Agg(a.name, "sum" if a.kind == "count" else a.kind, F.col(f"_t_{a.name}")))
              .over(earlier).alias(f"_c_{a.name}") for a in aggs]).where("_rank > 0").drop("_rank")
        same = F.col(SLICE) == F.col("_k_slice")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(carried, same, "left")
        out = out.withColumns({a.name: merge(a, F.col(a.name), F.col(f"_c_{a.name}")) for a in aggs})
        out = out.drop("_k_slice", *[f"_k_{k}" for k in keys], *[f"_c_{a.name}" for a in aggs])
    return out


def _local(agg: Agg, keys: list[str], order: list[str]) -> Column:
    win = Window.partitionBy(*keys).orderBy(*order)
    if agg.kind == "last":
        return F.lag(agg.expr, 1).over(win)
    return fold(agg).over(win.rowsBetween(Window.unboundedPreceding, -1))


def order_bins(df: DataFrame, column: str, cuts: int = 64, subs: int = 16) -> DataFrame:
    """Adds a bin number that grows with ``column`` and splits its rows into about equal parts.

    Quantile cut points (a bounded list) give the coarse bins; each is divided evenly. Used to
    rank a whole table by one column without sending it through one task.
    """
    probs = [i / cuts for i in range(cuts + 1)]
    got = df.agg(F.percentile_approx(column, probs, 10_000)).first()[0]
    if got is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    points = sorted(set(got))
    x = F.col(column)

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(x >= points[mid], place(mid, hi)).otherwise(place(lo, mid - 1))

    if len(points) == 1:
        return df.withColumn(SLICE, F.when(x < points[0], -1).when(x > points[0], 1).otherwise(0).cast("long"))
    last = len(points) - 1
    edges = F.array(*[F.lit(float(p)) for p in points])
    coarse = df.withColumn("_cut", place(0, last - 1))
    low, high = F.element_at(edges, F.col("_cut") + 1), F.element_at(edges, F.col("_cut") + 2)
    fine = F.floor((x - low) / (high - low) * subs)
    fine = F.least(F.greatest(fine, F.lit(0)), F.lit(subs - 1))
    return coarse.withColumn(SLICE, (F.col("_cut") * subs + fine).cast("long")).drop("_cut")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
