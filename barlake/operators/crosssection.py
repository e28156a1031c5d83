"""Cross-sectional momentum over a daily panel (symbol, ts_ns, close, quote_volume).

Windows here run over one symbol's days or one day's symbols: the calendar and the listing
bound both, whatever the size of the trade data behind the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.lookups import date_index
from barlake.operators.performance import newey_west
from barlake.session import settle


def liquid(panel: DataFrame, lookback: int = 30, quantile: float = 0.2,
           min_samples: int = 7) -> DataFrame:
    """Rows whose trailing median volume reaches the date's quantile (the higher neighbour)."""
    w = W.partitionBy("symbol").orderBy("ts_ns").rowsBetween(-(lookback - 1), 0)
    enough = F.count("quote_volume").over(w) >= min_samples
    med = panel.withColumn("_m", F.when(enough, F.percentile("quote_volume", 0.5).over(w)))
    known = F.sort_array(F.collect_list("_m"))
    cut = med.groupBy("ts_ns").agg(known.alias("_all")).where(F.size("_all") > 0).select(
        "ts_ns", F.element_at("_all", (F.ceil(F.lit(quantile) * (F.size("_all") - 1)) + 1)
                              .cast("int")).alias("_cut"))
    return med.join(cut, "ts_ns").where(F.col("_m") >= F.col("_cut")).select(
        "symbol", "ts_ns", "close")


def _defined(panel: DataFrame, cells: Sequence[tuple[int, int]]) -> DataFrame:
    """Past and forward return of each row for each (lookback, horizon) cell.

    Positions count the frame's dates, so a symbol's missing day gives no return. Rows of
    all cells come from one join per distinct offset.
    """
    indexed = panel.join(date_index(panel), "ts_ns")
    grid = F.array(*[F.struct(F.lit(a).alias("lookback"), F.lit(h).alias("horizon"))
                     for a, h in cells])
    rows = indexed.select("*", F.inline(grid))
    other = indexed.select("symbol", "_t", "close")
    past = other.select("symbol", F.col("_t").alias("_past"), F.col("close").alias("_c0"))
    ahead = other.select("symbol", F.col("_t").alias("_fwd"), F.col("close").alias("_c1"))
    return (
        rows.withColumn("_past", F.col("_t") - F.col("lookback"))
        .withColumn("_fwd", F.col("_t") + F.col("horizon"))
        .join(past, ["symbol", "_past"]).join(ahead, ["symbol", "_fwd"])
        .select("symbol", "ts_ns", "lookback", "horizon",
                (F.col("close") / F.col("_c0") - 1.0).alias("past"),
                (F.col("_c1") / F.col("close") - 1.0).alias("forward"))
    )


CELL = ["lookback", "horizon"]


def bucket_returns(panel: DataFrame, cells: Sequence[tuple[int, int]], n_buckets: int = 5,
                   top_fraction: float = 0.2) -> DataFrame:
    """Per date and cell: mean forward return (bps) of the top and bottom bucket, the
    larger-fraction bucket and the whole universe. Dates with two defined assets or more."""
    n_assets = panel.agg(F.countDistinct("symbol").alias("n_assets"))
    day = W.partitionBy("ts_ns", *CELL)
    ranked = _defined(panel, cells).join(F.broadcast(n_assets)).withColumns({
        "_up": F.row_number().over(day.orderBy("past", "symbol")),
        "_n": F.count(F.lit(1)).over(day)})
    k = F.greatest(F.lit(1), F.floor(F.col("n_assets") / n_buckets))
    kf = F.greatest(F.lit(1), F.floor(F.col("n_assets") * top_fraction))
    down = F.col("_n") - F.col("_up")
    return ranked.where(F.col("_n") >= 2).groupBy("ts_ns", *CELL).agg(
        F.max("n_assets").alias("n_assets"),
        (F.avg(F.when(down < k, F.col("forward"))) * 1e4).alias("top_bps"),
        (F.avg(F.when(F.col("_up") <= k, F.col("forward"))) * 1e4).alias("bottom_bps"),
        (F.avg(F.when(down < kf, F.col("forward"))) * 1e4).alias("top_fraction_bps"),
        (F.avg("forward") * 1e4).alias("universe_bps"))


def spread_summary(buckets: DataFrame, costs: Sequence[float], kind: str = "quintile"
                   ) -> DataFrame:
    """Mean, median, hit rate and autocorrelation-robust t of a spread per cell and cost.

    One row per date and cell comes in, so exact medians here are over a calendar.
    """
    if kind == "quintile":
        gross = F.col("top_bps") - F.col("bottom_bps")
    else:
        gross = F.col("top_fraction_bps") - F.col("universe_bps")
    cost = F.array(*[F.lit(float(c)) for c in costs])
    rows = buckets.select("ts_ns", *CELL, "n_assets", "top_bps", "bottom_bps",
                          "top_fraction_bps", "universe_bps", gross.alias("_g"),
                          F.explode(cost).alias("cost_bps")).withColumn(
        "spread", F.col("_g") - F.col("cost_bps"))
    keys = [*CELL, "cost_bps"]
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_dates"), F.max("n_assets").alias("n_assets"),
        F.avg("top_bps").alias("top_mean_bps"), F.avg("bottom_bps").alias("bottom_mean_bps"),
        F.avg("top_fraction_bps").alias("top_fraction_mean_bps"),
        F.avg("universe_bps").alias("universe_mean_bps"),
        F.avg("spread").alias("spread_mean_bps"),
        F.percentile("spread", 0.5).alias("spread_median_bps"),
        F.avg((F.col("spread") > 0).cast("double")).alias("hit_rate"))
    # The overlap of forward windows sets the lag of each cell.
    lag = F.greatest(F.lit(1), F.col("horizon") - 1)
    t = newey_west(rows, "spread", keys, lag, "t_stat")
    return stats.join(t, keys)


def cross_section_study(panel: DataFrame, cells: Sequence[tuple[int, int]],
                        costs: Sequence[float], lookback: int = 30, quantile: float = 0.2,
                        kind: str = "quintile") -> DataFrame:
    """Liquidity filter, then spreads over a grid of lookbacks, horizons and costs."""
    buckets = settle(bucket_returns(liquid(panel, lookback, quantile), cells), "buckets")
    return spread_summary(buckets, costs, kind)
