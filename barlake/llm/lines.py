"""Removal of repeated lines by overlapping windows of three lines.

Every run of three consecutive lines that hold a word is hashed. A window that occurs more
than once in the corpus keeps its first occurrence, by (doc_id, position); the lines of all
later ones are removed, overlapping windows merged. Where a window repeats itself on top of its
first occurrence, the lines of the first stay. Lines without a word are never part of a window
and stay. Documents with fewer than three such lines have no window and stay as they are.

DataFrame functions only. Windows are shuffled as two 64-bit hashes and a place. Counts are
pre-aggregated; the table of repeated windows is stored, so its join with the places of a
frequent window is one that adaptive execution splits. Rows are numbered and stored once; places
belong to a row, so what is collected for it is at most one entry for each of its windows. Rows
with equal or null ids are documents of their own; null texts stay null; a null id sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.session import settle

LINES = 3
WORD = "[^\\x20\\x09-\\x0D]"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _worded(lines: str) -> Column:
    """Positions of the lines that hold a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1),
                    lambda p: F.get(F.col(lines), p).rlike(WORD))


def numbered(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """_row (all columns), doc_id, text, and row, a number of the row; stored, so that every
    reading has the same numbers."""
    rows = settle(docs.select(F.struct(*docs.columns).alias("_row"),
                              F.monotonically_increasing_id().alias("row")), "rows")
    return rows.select("_row", F.col("_row")[id].alias("doc_id"), F.col("_row")[text].alias("text"),
                       "row")


def windows(rows: DataFrame, size: int = LINES) -> DataFrame:
    """doc_id, tie (hash of the text), row, at (number of the window among the worded lines), k1,
    k2 (128 bits of hash)."""
    lines = rows.select("doc_id", "row", F.xxhash64("text").alias("tie"),
                        _split(F.col("text")).alias("lines")).withColumn(
        "worded", _worded("lines"))
    hashed = lines.where(F.size("worded") >= size).select("doc_id", "tie", "row", F.transform(
        "worded", lambda p: F.xxhash64(F.get("lines", p))).alias("a"), F.transform(
        "worded", lambda p: F.xxhash64(F.lit(1), F.get("lines", p))).alias("b"))
    starts = F.sequence(F.lit(0), F.size("a") - size)
    keys = F.transform(starts, lambda i: F.struct(
        i.alias("at"), *[F.xxhash64(*[F.get(F.col(side), i + j) for j in range(size)]).alias(key)
                         for side, key in (("a", "k1"), ("b", "k2"))]))
    return hashed.select("doc_id", "tie", "row", F.inline(keys))


def removed(rows: DataFrame, size: int = LINES) -> DataFrame:
    """row and gone: the numbers of its worded lines that later occurrences cover."""
    places = windows(rows, size)
    place = F.struct("doc_id", "tie", "row", "at")
    repeated = settle(places.groupBy("k1", "k2").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).where(
        "first.row <> last.row OR first.at <> last.at").select(
        "k1", "k2", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at")),
        "repeated")
    own = F.col("row") == F.col("first_row")
    start = F.when(own, F.greatest("at", F.col("first_at") + size)).otherwise(F.col("at"))
    later = places.select("k1", "k2", "row", "at").join(repeated, ["k1", "k2"]).where(
        ~(own & (F.col("at") == F.col("first_at"))))
    return later.select("row", start.alias("from"), (F.col("at") + size - 1).alias("to")).where(
        "`from` <= `to`").groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("from", "to")))).alias("gone"))


def deduplicate(docs: DataFrame, size: int = LINES, id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The documents, all columns in their order, the text without repeated windows, and two
    counts: n_worded and n_removed lines (in place of columns of these names)."""
    rows = numbered(docs, id, text)
    lines = (rows.join(removed(rows, size), "row", "left")
             .withColumn("_lines", _split(F.col("text")))
             .withColumn("_worded", _worded("_lines")))
    drop = F.transform("gone", lambda g: F.get("_worded", g))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), drop)
    whole = F.array_join(F.transform(kept, lambda p: F.get("_lines", p)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(whole)
    return lines.select(
        *[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns
          if c not in ("n_worded", "n_removed")],
        F.size("_worded").cast("long").alias("n_worded"), F.coalesce(
            F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
