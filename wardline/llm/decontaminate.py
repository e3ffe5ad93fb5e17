"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Words are the contract's; an item is cut into windows of ``WINDOW`` consecutive words (a shorter item is
one window). A window occurs in a document exactly when all its shingles do, in order, so one shingle is
a sufficient prefix: the rarest by corpus frequency, counted over all documents. Documents probe that
shingle; its offset in the window fixes where the window would begin (positional bound), the window must
end inside the text (length bound), and then the words are compared, so hash collisions cannot matter.

Shingles are three words, or the whole of a window that is shorter. Windows are dealt into blocks of
``BLOCK`` by hash; each block is broadcast in turn, so what is broadcast has a proven bound and texts are
never shuffled. Each document leaves the scan as one row of its own plus one row per verified window.

Null text has no words. Items with a null id or text are no items. Rows with equal id and text give one
row. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.tables import kept, lower_ascii, text_key

WINDOW = 10
SHINGLE = 3
BLOCK = 200_000
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NOT_A_WORD), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)])


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id, window (words), width of its shingles."""
    words = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    return (words.where(F.size("words") > 0)
            .select("item", "words", F.explode(starts).alias("at"))
            .select("item", F.slice("words", F.col("at") + 1, F.lit(window)).alias("window"))
            .distinct()
            .withColumn("width", F.least(F.size("window"), F.lit(SHINGLE))))


def _window_shingles(windows: DataFrame, width: int) -> DataFrame:
    offsets = F.sequence(F.lit(0), F.size("window") - width)
    return (windows.where(F.col("width") == width)
            .select("item", "window", "block", F.explode(offsets).alias("offset"))
            .withColumn("shingle", _shingle(F.col("window"), F.col("offset"), width)))


def _probed(docs: DataFrame, width: int) -> DataFrame:
    """One row per word: where it stands, and the shingle that begins there. An empty text has one row too."""
    return (docs.select("doc", "version", "words", F.size("words").alias("n_words"),
                        F.posexplode_outer("words").alias("at", "word"))
            .withColumn("shingle", _shingle(F.col("words"), F.col("at"), width)))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, version (of the text), n_words, n_hit, items (sorted ids as strings), contaminated."""
    bare = docs.select(F.col(doc_id).alias("doc"), text_key(F.col(text)).alias("version"),
                       words_of(F.col(text)).alias("words"))
    windows = item_windows(items, item_id, item_text, window)
    windows = kept(windows.withColumn("hash", F.xxhash64("window")))
    size = windows.groupBy("width").count().collect()  # three rows at most
    total = sum(r["count"] for r in size)
    blocks = max(1, -(-total // BLOCK))
    windows = windows.withColumn("block", F.pmod("hash", F.lit(blocks)))
    found = []
    for width in sorted(r["width"] for r in size):
        probed, parts = _probed(bare, width), _window_shingles(windows, width)
        for block in range(blocks):
            own = parts.where(F.col("block") == block)
            seen = (probed.select("shingle").join(F.broadcast(own.select("shingle").distinct()), "shingle")
                    .groupBy("shingle").agg(F.count("*").alias("seen")))
            rarest = (own.join(seen, "shingle", "left")
                      .groupBy("item", "window")
                      .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "shingle")).alias("p"))
                      .where("p.seen > 0")  # a shingle that no document has
                      .select("item", "window", "p.offset", "p.shingle"))
            first = not found  # this pass also brings the row of each document
            hits = (probed.join(F.broadcast(kept(rarest)), "shingle", "left" if first else "inner")
                    .withColumn("start", F.col("at") - F.col("offset"))
                    .withColumn("hit", F.coalesce(
                        (F.col("start") >= 0) & (F.col("start") + F.size("window") <= F.col("n_words"))
                        & (F.slice("words", F.greatest("start", F.lit(0)) + 1, F.size("window")) == F.col("window")),
                        F.lit(False))))
            found.append(hits.where(F.col("hit") | (F.coalesce("at", F.lit(0)) == 0) if first else F.col("hit"))
                         .select("doc", "version", "n_words", F.when(F.col("hit"), F.col("item")).alias("item"),
                                 F.when(F.col("hit"), F.struct("start", F.size("window").alias("n"))).alias("span")))
    if not found:
        found = [bare.select("doc", "version", F.size("words").alias("n_words"), F.lit(None).cast("string").alias("item"),
                             F.lit(None).cast("struct<start:int,n:int>").alias("span"))]
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
                              (a["sum"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))
                               ).alias("sum")),
        lambda a: a["sum"])
    return (_union(found).groupBy("doc", "version")
            .agg(F.max("n_words").cast("long").alias("n_words"), F.collect_set("span").alias("spans"),
                 F.sort_array(F.collect_set("item")).alias("items"))
            .select(F.col("doc").alias("doc_id"), "version", "n_words", covered.cast("long").alias("n_hit"), "items")
            .withColumn("contaminated", F.col("n_hit") > 0))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("bad_id"), "version")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"])
                     & (text_key(docs["text"]) == bad["version"]), "left_anti")
