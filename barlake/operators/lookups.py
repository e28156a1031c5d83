"""Price and rate lookups between tables, alignment and presence checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.asof import asof_join
from barlake.operators.series import running, slice_of
from barlake.schemas import NS_DAY, NS_MINUTE


def close_before(bars: DataFrame, midnight_ns: int) -> DataFrame:
    """Last close strictly before a midnight, per symbol."""
    return bars.where(F.col("ts_ns") <= midnight_ns - 1).groupBy("symbol").agg(
        F.max("ts_ns").alias("ts_ns"), F.max_by("close", "ts_ns").alias("close"))


def funding_marks(funding: DataFrame, bars: DataFrame, interval_ns: int = NS_MINUTE) -> DataFrame:
    """Mark of each settlement: close of the bar before it, else open of its own bar.

    Settlements with neither keep a NULL mark, to be counted or refused by the caller.
    """
    own = F.col("ts_ns") - F.pmod("ts_ns", F.lit(interval_ns))
    f = funding.withColumn("_own", own).withColumn("_before", F.col("_own") - interval_ns)
    before = bars.select("symbol", F.col("ts_ns").alias("_before"), F.col("close").alias("_c"))
    at = bars.select("symbol", F.col("ts_ns").alias("_own"), F.col("open").alias("_o"))
    return (f.join(before, ["symbol", "_before"], "left").join(at, ["symbol", "_own"], "left")
            .withColumn("mark", F.coalesce("_c", "_o")).drop("_own", "_before", "_c", "_o"))


def sum_per_interval(points: DataFrame, value: str, keys: Sequence[str], interval_ns: int,
                     out: str) -> DataFrame:
    """Sum over (k·interval, (k+1)·interval] on a regular grid; ``ts_ns`` is the open end."""
    k = slice_of(F.col("ts_ns") - 1, interval_ns)
    return points.groupBy(*keys, (k * interval_ns).alias("_start")).agg(
        F.sum(value).alias(out)).withColumnRenamed("_start", "ts_ns")


def sum_between(intervals: DataFrame, points: DataFrame, value: str, start: str, end: str,
                out: str = "total", keys: Sequence[str] = ("symbol",),
                width: int = NS_DAY) -> DataFrame:
    """Sum of points with start < ts <= end, as a difference of two running sums."""
    prefix = running(points, {"_p": ("sum", F.col(value))}, keys, width=width).select(
        *keys, F.col("ts_ns").alias("_t"), "_p")
    with_end = asof_join(intervals, prefix, keys, end, "_t", ["_p"], "_end", width)
    both = asof_join(with_end, prefix, keys, start, "_t", ["_p"], "_start", width)
    zero = F.lit(0.0)
    total = F.coalesce(F.col("_end_p"), zero) - F.coalesce(F.col("_start_p"), zero)
    return both.withColumn(out, total).drop("_end_p", "_start_p")


def date_index(panel: DataFrame) -> DataFrame:
    """Position of each distinct date of the frame; bounded by the calendar, not the rows."""
    return panel.select("ts_ns").distinct().withColumn(
        "_t", F.row_number().over(W.orderBy("ts_ns")) - 1)


def offset_join(panel: DataFrame, offsets: dict[str, int], value: str = "close") -> DataFrame:
    """Each row with the same symbol's value a number of frame dates away.

    The offset counts dates of the whole frame; a symbol without a row there gives NULL.
    """
    indexed = panel.join(date_index(panel), "ts_ns")
    out = indexed
    for name, k in offsets.items():
        other = indexed.select("symbol", (F.col("_t") - k).alias("_t"), F.col(value).alias(name))
        out = out.join(other, ["symbol", "_t"], "left")
    return out


def alignment(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many key rows exist on both sides and on one only."""
    a = left.select(*keys, F.lit(1).alias("_l"))
    b = right.select(*keys, F.lit(1).alias("_r"))
    return a.join(b, list(keys), "full_outer").agg(
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("matched"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("left_only"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("right_only"))


def present_today_and_tomorrow(rows: DataFrame, closes: DataFrame,
                               keys: Sequence[str] = ()) -> DataFrame:
    """Keep daily rows that have a close on their day and on the next."""
    days = closes.select(*keys, "ts_ns").distinct()
    before = days.withColumn("ts_ns", F.col("ts_ns") - NS_DAY)
    on = [*keys, "ts_ns"]
    return rows.join(days, on, "left_semi").join(before, on, "left_semi")


def leg_basis(spot: DataFrame, perp: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Closes of two legs at equal times and perp / spot - 1."""
    a = spot.select(*keys, "ts_ns", F.col("close").alias("spot"))
    b = perp.select(*keys, "ts_ns", F.col("close").alias("perp"))
    return a.join(b, [*keys, "ts_ns"]).withColumn(
        "basis", F.col("perp") / F.nullif(F.col("spot"), F.lit(0.0)) - 1.0)
