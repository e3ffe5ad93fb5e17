"""Interaction audit of text filters by exact constrained least squares.

Each document gets the set of filters that it fails. What a set of filters removes together is tabulated for
all 32 coalitions of each part; what one filter removes at a step of an order is a difference of two coalitions.
The Shapley values are the additive fit to the coalition table under kernel weights, constrained to add up to
what all filters remove together. Its normal equations are solved in rationals once, for a table of unknowns; the
solution is a row of rationals per filter, applied to each part's table in whole numbers.

The filter on copies compares whole texts by SHA-256 over the table: of the rows with one text, those with a larger
id than the smallest fail. Counts are combined by (text, part, other filters, labels) before texts meet, so many
copies of one text are a few rows; a part is at most 32 rows when its table is built.

Null text is empty, null part the empty string. A row with a null id is no copy, has no labels and makes no other row
a copy; rows that share id and text are separate rows, and none is a copy of the other. Labels of one id are joined by
"any". Only the named columns are read, so extra columns of any name change nothing. An empty table gives no part.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COPIES = "E"


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions: A few words, B repeated words, C capitals, D marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")  # one expression, so that it is computed once a row
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def kernel_weight(players: int, size: int) -> Fraction:
    """Weight of a coalition that is neither empty nor everyone."""
    return Fraction(players - 1, comb(players, size) * size * (players - size))


def _solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Gauss-Jordan elimination in rationals, for several right sides at once."""
    rows = [[*m, *r] for m, r in zip(matrix, right, strict=True)]
    for i in range(len(rows)):
        pivot = next(j for j in range(i, len(rows)) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i and (factor := rows[j][i]):
                rows[j] = [x - factor * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[len(matrix):] for r in rows]


def shapley_rows(players: int) -> list[list[Fraction]]:
    """coefficient[player][coalition] of the values in a coalition table (bit i of the index: player i).

    Minimises the weighted squares of value - sum of the members' shares over proper coalitions, subject to all
    shares adding up to the value of everyone less that of no one. Stationarity and the constraint, with its
    multiplier, are one linear system.
    """
    whole = (1 << players) - 1
    proper = range(1, whole)
    weight = {s: kernel_weight(players, s.bit_count()) for s in proper}
    matrix = [[sum((weight[s] for s in proper if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(players)] + [Fraction(1)]
              for i in range(players)]
    matrix.append([Fraction(1)] * players + [Fraction(0)])
    right = []
    for i in range(players):  # the value of no one is taken off every coalition
        row = [weight[s] if s in weight and s >> i & 1 else Fraction(0) for s in range(whole + 1)]
        row[0] = -sum(row, Fraction(0))
        right.append(row)
    right.append([Fraction((s == whole) - (s == 0)) for s in range(whole + 1)])
    return _solved(matrix, right)[:players]


def failing(docs: DataFrame, labels: DataFrame, filters=standard_filters, doc_id: str = "doc_id", text: str = "text",
            part: str = "source") -> DataFrame:
    """part, fails (bits of the filters in order, copies last), n, good, toxic: documents by what they fail."""
    body = F.coalesce(F.col(text), F.lit(""))
    conditions = filters(body)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(body, 256)).alias("text_key"), bits.alias("fails"))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic")))
    known = rows.where("id is not null").join(marks, "id", "left").na.fill(0, ["good", "toxic"])
    same = ["text_key", "part", "fails", "good", "toxic"]
    versions = known.groupBy("id", *same).agg(F.count("*").alias("n"))  # already dealt out by id
    groups = versions.groupBy(*same).agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("n"))
    first = F.min("least.id").over(Window.partitionBy("text_key"))  # a row per part and labels of a text
    single = F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = groups.select("part", "fails", "good", "toxic", "n", single.alias("single"))
    copy = 1 << len(conditions)
    both = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct("fails", F.col("single").alias("n")),
        F.struct((F.col("fails") + copy).alias("fails"), (F.col("n") - F.col("single")).alias("n"))))).where("n > 0")
    unnamed = rows.where("id is null").select("part", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"),
                                              "fails", F.lit(1).cast("long").alias("n"))
    return (both.unionByName(unnamed).groupBy("part", "fails")
            .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
                 F.sum(F.col("n") * F.col("toxic")).alias("toxic")))


def coalition_table(fails: DataFrame, players: int) -> DataFrame:
    """part, n, and removed, good, toxic: arrays over all coalitions of what the coalition removes."""
    kinds = {"removed": "n", "good": "good", "toxic": "toxic"}
    sums = [F.sum(F.when(F.col("fails").bitwiseAND(s) != 0, F.col(c)).otherwise(0)).alias(f"{name}_{s}")
            for name, c in kinds.items() for s in range(1 << players)]
    wide = fails.groupBy("part").agg(F.sum("n").alias("n"), *sums)
    return wide.select("part", "n", *[F.array(*[f"{name}_{s}" for s in range(1 << players)]).alias(name) for name in kinds])


def audit(docs: DataFrame, labels: DataFrame, filters=standard_filters, doc_id: str = "doc_id", text: str = "text",
          part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, and filter.

    ``filters`` gives failure conditions by one-letter name; the filter on copies comes last, as E in the standard set.
    ``shapley`` is the Shapley value times the number of orders, a whole number.
    """
    names = [*filters(F.lit("")), COPIES]
    players = len(names)
    table = coalition_table(failing(docs, labels, filters, doc_id, text, part), players)
    orders = factorial(players)
    shares = []
    for row in shapley_rows(players):
        scaled = [x * orders for x in row]
        if any(x.denominator != 1 for x in scaled):
            raise ArithmeticError("the solution is not in parts of the number of orders")
        shares.append(sum((F.col("removed")[s] * int(x) for s, x in enumerate(scaled) if x), F.lit(0).cast("long")))
    steps = table.select("part", "n", "removed", "good", "toxic", F.array(*shares).alias("shares"),
                         F.explode(F.lit(["".join(p) for p in permutations(names)])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(players))).alias("step"))
    at = [F.instr("filter_order", name) for name in names]
    steps = steps.withColumns({
        "before": sum((F.when(a < F.col("step"), 1 << i).otherwise(0) for i, a in enumerate(at)), F.lit(0)),
        "own": sum((F.when(a == F.col("step"), i).otherwise(0) for i, a in enumerate(at)), F.lit(0))})
    steps = steps.withColumn("bit", F.element_at(F.lit([1 << i for i in range(players)]), F.col("own") + 1))
    after = F.col("before").bitwiseOR(F.col("bit"))

    def gain(kind: str) -> Column:
        return F.get(kind, after) - F.get(kind, F.col("before"))

    whole = (1 << players) - 1
    return steps.select(
        "part", "filter_order", "step", (F.col("n") - F.get("removed", after)).alias("kept"), gain("removed").alias("removed"),
        (F.get("removed", F.col("bit")) - gain("removed")).alias("redundant"),
        (F.col("removed")[whole] - F.get("removed", F.lit(whole) - F.col("bit"))).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        F.get("shares", F.col("own")).alias("shapley"), F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"))
