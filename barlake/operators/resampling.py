"""Bootstraps with counter-based draws: every run gives the same numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.functions.scalars import hashed_draw
from barlake.operators.performance import log_growth
from barlake.operators.quantiles import grouped_quantiles
from barlake.operators.series import SLICE, running, slice_of, with_row_index
from barlake.schemas import NS_DAY
from barlake.session import settle


def _paths(values: DataFrame, keys: Sequence[str], draws: DataFrame) -> DataFrame:
    """Values at the drawn positions: keys, sim, step, value."""
    return draws.join(values, [*keys, "_idx"]).select(*keys, "sim", "step", "value")


def _summary(ends: DataFrame, keys: Sequence[str], probs: dict[str, float],
             extra: Sequence[Column]) -> DataFrame:
    return grouped_quantiles(ends, keys, "final", probs, extra=extra)


def bootstrap_trades(trades: DataFrame, sims: int, seed: int, dd_threshold: float,
                     keys: Sequence[str] = ("run_id",), value: str = "net",
                     ts: str = "ts_ns", width: int = NS_DAY,
                     slice_steps: int = 4096) -> DataFrame:
    """Resample trades with replacement: final PnL quantiles and drawdown risk per key.

    The paths (sims times trades rows) are read once, in slices of ``slice_steps`` steps, so
    neither a key nor a path is sorted in one place. A slice is reduced to its sum, its highest and
    lowest point and its own drawdown, from which those of the path follow. Drawdown is in quote
    units from the peak of the cumulative sum itself.
    """
    keys = list(keys)
    values = settle(with_row_index(trades, keys, ts, width).select(
        *keys, "_idx", F.col(value).alias("value")), "values")
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sim = F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))
    # Each trade row stands for one step of every path; spread before the draws explode.
    grid = values.select(*keys, F.col("_idx").alias("step")).join(sizes, keys).withColumn(
        "sim", sim)
    draws = grid.withColumn("_idx", hashed_draw(F.col("_n"), str(seed), F.col("sim"),
                                                F.col("step")))
    paths = _paths(values, keys, draws)
    by = [*keys, "sim"]
    cell = [*by, SLICE]
    upto = W.partitionBy(*cell).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    cum = paths.withColumn(SLICE, slice_of("step", slice_steps)).withColumn(
        "_cum", F.coalesce(F.sum("value").over(upto), F.lit(0.0)))
    slices = settle(cum.withColumn("_peak", F.max("_cum").over(upto)).groupBy(*cell).agg(
        F.sum("value").alias("_sum"), F.max("_cum").alias("_high"), F.min("_cum").alias("_low"),
        F.max(F.col("_peak") - F.col("_cum")).alias("_dd"), F.count(F.lit(1)).alias("_n")), "slices")
    earlier = W.partitionBy(*by).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("_from", F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)))
    slices = slices.withColumn("_top", F.max(F.col("_from") + F.col("_high")).over(earlier))
    ends = settle(slices.groupBy(*by).agg(
        F.sum("_sum").alias("final"), F.max(F.greatest(
            F.col("_dd"), F.col("_top") - F.col("_from") - F.col("_low"))).alias("dd"),
        F.sum("_n").alias("_steps")), "paths")
    return _summary(ends, keys, {"p5": 0.05, "p50": 0.5, "p95": 0.95}, [
        F.max("_steps").alias("n_trades"), F.avg("final").alias("mean"),
        F.avg((F.col("dd") > dd_threshold).cast("double")).alias("prob_dd_over"),
    ]).withColumnRenamed("n", "n_sims")


def block_bootstrap(daily: DataFrame, sims: int, horizon: int, seed: int, block: int = 20,
                    keys: Sequence[str] = ("cell",), value: str = "net") -> DataFrame:
    """Paths of contiguous day blocks, cut to the horizon: tails of return and drawdown.

    Starts run from the first day to the last full block. The daily series is bounded by
    the calendar, a path by the horizon.
    """
    keys = list(keys)
    values = settle(with_row_index(daily, keys, width=4096 * NS_DAY).select(
        *keys, "_idx", F.col(value).alias("value")), "values")
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    short = F.raise_error(F.lit("series shorter than a block")).cast("bigint")
    starts = F.when(F.col("_n") >= block, F.col("_n") - block + 1).otherwise(short)
    grid = sizes.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    b = F.call_function("div", F.col("step"), F.lit(block))
    draws = grid.withColumn("_idx", hashed_draw(starts, str(seed), F.col("sim"), b)
                            + F.col("step") % block)
    by = [*keys, "sim"]
    paths = _paths(values, keys, draws).withColumn("_log", log_growth("value"))
    growth = running(paths, {"_g": ("sum", F.col("_log"))}, by, "step", 4096)
    peaks = running(growth, {"_p": ("max", F.col("_g"))}, by, "step", 4096)
    dd = F.lit(1.0) - F.exp(F.col("_g") - F.greatest(F.lit(0.0), F.col("_p")))
    ends = settle(peaks.groupBy(*by).agg(
        (F.exp(F.sum("_log")) - 1.0).alias("final"), F.max(dd).alias("dd")), "paths")
    probs = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return _summary(ends, keys, probs, [
        F.avg((F.col("final") < 0).cast("double")).alias("prob_final_negative"),
        F.avg((F.col("dd") > 0.02).cast("double")).alias("prob_dd_over_2pct"),
        F.avg((F.col("dd") > 0.05).cast("double")).alias("prob_dd_over_5pct")]).drop("n")
