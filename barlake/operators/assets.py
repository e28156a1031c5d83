"""Per-asset activity and volatility metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.operators import signals
from barlake.operators.bars import last_per_bucket
from barlake.operators.features import return_volatility
from barlake.operators.quantiles import grouped_quantiles
from barlake.operators.series import slice_of
from barlake.schemas import NS_DAY, NS_HOUR


def mean_of_daily_sums(bars: DataFrame, *columns: str) -> DataFrame:
    """Mean over UTC days of the daily sum of each column."""
    per_day = bars.groupBy("symbol", slice_of("ts_ns", NS_DAY).alias("_d")).agg(
        *[F.sum(c).alias(c) for c in columns])
    return per_day.groupBy("symbol").agg(*[F.avg(c).alias(f"{c}_daily") for c in columns])


def split_scannable(bars: DataFrame, min_bars: int = 2) -> tuple[DataFrame, DataFrame]:
    """Bars of symbols with enough of them, and the (symbol, n_bars) list of the others."""
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    skipped = sizes.where(F.col("n_bars") < min_bars)
    return bars.join(skipped, "symbol", "left_anti"), skipped


def asset_metrics(
    bars: DataFrame,
    funding: DataFrame | None = None,
    min_quote_volume_daily: float = 0.0,
    min_days: float = 20.0,
    lookback: int = 30,
    volume_factor: float = 2.0,
    width: int = NS_DAY,
) -> DataFrame:
    """Bars, volatility, activity, breakout frequency, funding and the ``dead`` flag."""
    size = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"), (F.max("ts_ns") - F.min("ts_ns")).alias("_span"))
    hourly = last_per_bucket(bars, NS_HOUR)
    hits = signals.breakout(bars, lookback, volume_factor, width=width).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_hits"))
    out = (
        size.join(return_volatility(bars, out="vol_bps_1m", width=width), "symbol")
        .join(return_volatility(hourly, out="vol_bps_1h", width=64 * NS_DAY), "symbol")
        .join(mean_of_daily_sums(bars, "quote_volume", "n_trades"), "symbol")
        .join(hits, "symbol", "left")
    )
    if funding is not None:
        rates = grouped_quantiles(funding, ["symbol"], "rate", {"_p95": 0.95},
                                  extra=[F.avg("rate").alias("_mean")])
        out = out.join(rates.drop("n"), "symbol", "left")
    else:
        out = out.withColumn("_mean", F.lit(None).cast("double")).withColumn(
            "_p95", F.lit(None).cast("double"))
    days = F.greatest(F.lit(1.0), F.col("n_bars") / 1440.0)
    span = F.col("_span") / F.lit(float(NS_DAY))
    return out.select(
        "symbol", "n_bars", "vol_bps_1m", "vol_bps_1h",
        F.col("quote_volume_daily"), F.col("n_trades_daily"),
        (F.coalesce(F.col("_hits"), F.lit(0)) / days).alias("breakout_freq"),
        (F.col("_mean") * 1e4).alias("funding_mean_bps"),
        (F.col("_p95") * 1e4).alias("funding_p95_bps"),
        ((F.col("quote_volume_daily") < min_quote_volume_daily) | (span < min_days)).alias("dead"))
