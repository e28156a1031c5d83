"""Bars from trades, resampling, daily marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.series import core_rows, in_blocks
from barlake.schemas import NS_DAY


def bucket_start(ts: str | Column, interval_ns: int) -> Column:
    """Start of the bucket a time falls in."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(interval_ns))


def ohlcv(order: str) -> list[Column]:
    """Bar aggregates over trades; ``order`` grows with time and has no ties in a symbol.

    A single ordering column keeps the whole aggregation in fixed-width hash buffers.
    """
    notional, taker_buy = F.col("price") * F.col("qty"), ~F.col("buyer_is_maker")
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum(notional).alias("quote_volume"),
        F.count(F.lit(1)).alias("n_trades"),
        F.coalesce(F.sum(F.when(taker_buy, F.col("qty"))), F.lit(0.0)).alias("taker_buy_volume"),
        F.coalesce(F.sum(F.when(taker_buy, notional)), F.lit(0.0)).alias("taker_buy_quote_volume"),
    ]


def bars_from_trades(trades: DataFrame, interval_ns: int, order: str = "agg_id") -> DataFrame:
    """One bar per symbol and bucket that has trades; silent buckets are absent.

    Aggregated on the map side first, so one hot symbol costs no extra shuffle.
    """
    return (
        trades.groupBy("symbol", bucket_start("ts_ns", interval_ns).alias("_start"))
        .agg(*ohlcv(order))
        .withColumnRenamed("_start", "ts_ns")
    )


def source_interval(bars: DataFrame, width: int = NS_DAY) -> DataFrame:
    """Smallest positive spacing per symbol; NULL for a symbol with a single bar."""
    blocks, w = in_blocks(bars.select("symbol", "ts_ns"), before=1, width=width)
    step = F.col("ts_ns") - F.lag("ts_ns").over(w)
    return (
        core_rows(blocks.withColumn("_step", step)).groupBy("symbol")
        .agg(F.min(F.when(F.col("_step") > 0, F.col("_step"))).alias("interval_ns"))
    )


def resample_bars(bars: DataFrame, target_ns: int, source_ns: int | None = None,
                  width: int = NS_DAY) -> DataFrame:
    """Roll bars up; keep only buckets whose first and last source bar are present.

    ``source_ns`` is the known bar interval; without it, it is inferred per symbol.
    """
    start = bucket_start("ts_ns", target_ns)
    rolled = bars.groupBy("symbol", start.alias("_start")).agg(
        F.min("ts_ns").alias("_first"), F.max("ts_ns").alias("_last"),
        F.min_by("open", "ts_ns").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "ts_ns").alias("close"),
        *[F.sum(c).alias(c) for c in ("volume", "quote_volume", "n_trades",
                                      "taker_buy_volume", "taker_buy_quote_volume")],
    )
    if source_ns is None:
        rolled = rolled.join(source_interval(bars, width), "symbol")
        step = F.col("interval_ns")
    else:
        step = F.lit(source_ns)
    whole = (F.col("_first") == F.col("_start")) & (
        F.col("_last") + step == F.col("_start") + target_ns)
    return rolled.where(whole).select(
        "symbol", F.col("_start").alias("ts_ns"), "open", "high", "low", "close", "volume",
        "quote_volume", "n_trades", "taker_buy_volume", "taker_buy_quote_volume")


def last_per_bucket(bars: DataFrame, interval_ns: int, value: str = "close") -> DataFrame:
    """Last value of each bucket."""
    return bars.groupBy("symbol", bucket_start("ts_ns", interval_ns).alias("_start")).agg(
        F.max_by(value, "ts_ns").alias(value)).withColumnRenamed("_start", "ts_ns")


def daily_marks(marks: DataFrame, keys: Sequence[str] = ("symbol",),
                tie: Sequence[str] = ()) -> DataFrame:
    """Rows stamped exactly at a UTC midnight, the last one by ``tie`` per time (by all other
    columns if none is named)."""
    at = marks.where(F.pmod("ts_ns", F.lit(NS_DAY)) == 0)
    tie = tie or [c for c in marks.columns if c not in (*keys, "ts_ns")]
    w = W.partitionBy(*keys, "ts_ns").orderBy(*[F.col(t).desc() for t in tie])
    return at.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
