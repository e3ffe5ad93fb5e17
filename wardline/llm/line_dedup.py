"""Line dedup by overlapping three-line windows.

Each run of three consecutive lines is hashed to 128 bits. A window that occurs more than once keeps its
first occurrence in the order of (id, text version, line); later occurrences are covered, overlapping
ones merge, and covered lines are removed. The counts are combined on the map side, and only windows that
repeat are joined back, by an equality join whose hot keys adaptive execution can split.

Windows of blank lines only do not count. A text of fewer than three lines has no window and stays. Null
text stays null. A text that loses all lines becomes empty. Rows with equal id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import text_key

LINES = 3


def _windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    lines = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("version"),
                        F.split(F.col(text), "\n", -1).alias("lines"))
    at = [F.get(F.col("lines"), F.col("at") + i) for i in range(LINES)]
    return (lines.select("doc", "version", "lines", F.posexplode("lines").alias("at", "line"))
            .where((F.col("at") + LINES <= F.size("lines")) & (F.trim(F.concat(*at)) != ""))
            .select(F.xxhash64(*at).alias("high"), F.xxhash64(F.lit(LINES), *reversed(at)).alias("low"),
                    "doc", "version", "at"))


def covered_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, version, covered: the lines to remove, counted from 0, for documents that lose any."""
    windows = _windows(docs, doc_id, text)
    place = F.struct("doc", "version", "at")
    repeated = (windows.groupBy("high", "low").agg(F.min(place).alias("first"), F.count("*").alias("n"))
                .where("n > 1").drop("n"))
    later = windows.join(repeated, ["high", "low"]).where(place != F.col("first"))
    return (later.groupBy("doc", "version")
            .agg(F.array_distinct(F.flatten(F.collect_set(F.array(*[F.col("at") + i for i in range(LINES)]))))
                 .alias("covered")))


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text after removal, and, after its own columns, n_lines, n_removed. Where ``docs`` has a column of
    such a name, its own stays and the added one gets underscores at its end."""
    cover = covered_lines(docs, doc_id, text)
    base = docs.select(F.struct("*").alias("row"), text_key(F.col(text)).alias("key"))  # no name of ``docs`` meets one of ours
    joined = (base.join(cover, F.col(f"row.{doc_id}").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("version")), "left")
              .select("row", "covered", F.split(f"row.{text}", "\n", -1).alias("lines")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "covered")  # in order, by a hash set
    rest = F.concat_ws("\n", F.transform(left, lambda i: F.get("lines", i)))
    rest = F.when(F.col("covered").isNull(), F.col(f"row.{text}")).otherwise(rest)
    return joined.select(
        *[rest.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(_free("n_lines", docs.columns)),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias(_free("n_removed", docs.columns)))
