"""Checks on stored bars; every finding is one row (symbol, kind, ts_ns, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.series import running, slice_of
from barlake.schemas import NS_DAY


def sequence_anomalies(bars: DataFrame, interval_ns: int, position: str = "ts_ns",
                       width: int = NS_DAY) -> DataFrame:
    """Duplicate, unsorted and missing times between neighbours in stored order.

    ``position`` is the stored order of a symbol's rows and ``width`` its slice width.
    """
    rows = bars.select("symbol", "ts_ns", F.col(position).alias("_pos"))
    steps = running(rows, {"_prev": ("prev", F.col("ts_ns"))}, ts="_pos", width=width)
    d = F.col("ts_ns") - F.col("_prev")
    missing = F.call_function("div", d, F.lit(interval_ns)) - 1
    kind = F.when(d == 0, "duplicate_ts").when(d < 0, "non_monotonic").when(d > interval_ns, "gap")
    detail = (F.when(d == 0, "duplicate timestamp").when(d < 0, "timestamps not sorted")
              .otherwise(F.concat(missing.cast("string"), F.lit(" missing bars"))))
    return steps.select("symbol", kind.alias("kind"), "ts_ns", detail.alias("detail")).where(
        F.col("kind").isNotNull())


def high_below_low(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("high") < F.col("low")).select(
        "symbol", F.lit("high_lt_low").alias("kind"), "ts_ns",
        F.concat_ws(" ", F.lit("high under low:"), F.col("high").cast("string"),
                    F.col("low").cast("string")).alias("detail"))


def price_outliers(bars: DataFrame, factor: float = 100.0) -> DataFrame:
    """Closes more than ``factor`` away from their day's median.

    The median is over one symbol-day of bars, a group bounded by the bar interval.
    """
    medians = bars.groupBy("symbol", slice_of("ts_ns", NS_DAY).alias("_d")).agg(
        F.percentile("close", 0.5).alias("_m"))
    joined = bars.withColumn("_d", slice_of("ts_ns", NS_DAY)).join(medians, ["symbol", "_d"])
    out = (F.col("close") > F.col("_m") * factor) | (F.col("close") < F.col("_m") / factor)
    return joined.where(out).select(
        "symbol", F.lit("price_outlier").alias("kind"), "ts_ns",
        F.concat_ws(" ", F.lit("far from the day's median:"), F.col("close").cast("string"),
                    F.lit("against"), F.col("_m").cast("string")).alias("detail"))


def check_bars(bars: DataFrame, interval_ns: int, factor: float = 100.0,
               position: str = "ts_ns", width: int = NS_DAY) -> DataFrame:
    """All findings of a bar table."""
    return (sequence_anomalies(bars, interval_ns, position, width)
            .unionByName(high_below_low(bars)).unionByName(price_outliers(bars, factor)))


def duplicate_guard(df: DataFrame, keys: Sequence[str], ts: str = "ts_ns") -> DataFrame:
    """Rows against distinct times per key; ``unique`` where they agree."""
    return df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_times")).withColumn(
        "unique", F.col("n_rows") == F.col("n_times"))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             last: bool = False) -> DataFrame:
    """First (or last) row per key by ``order``; a partial aggregate, so no hot-key sort."""
    by = F.struct(*order)
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct("*"), by).alias("_r")).select("_r.*")


def rank_in_day(df: DataFrame, value: str, day: str = "ts_ns", out: str = "rank") -> DataFrame:
    """Ascending rank inside one date, ties by symbol; a date holds one row per symbol."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(day).orderBy(value, "symbol")))
