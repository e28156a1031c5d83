"""What happens after an event: forward returns, excursions, tables and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators import signals
from barlake.operators.asof import slice_seeds
from barlake.operators.quantiles import grouped_quantiles
from barlake.operators.series import SLICE, in_slices, slice_of, with_slice
from barlake.schemas import NS_DAY, NS_HOUR, NS_SECOND
from barlake.session import settle


def forward_outcomes(
    events: DataFrame,
    bars: DataFrame,
    horizons_ns: Sequence[int],
    keys: Sequence[str] = ("symbol",),
    excursions: bool = True,
    width: int = NS_DAY,
) -> DataFrame:
    """One row per event and horizon: return and best / worst excursion in bps.

    The base price is the last close at or before the event, the exit the last close at or
    before event + horizon; without a close strictly after the base all are NULL. Events may
    fall anywhere in time and carry ``direction`` and any other columns.

    Bars and events are unioned into time slices that overlap by the longest horizon, so
    there is one shuffle and no event-by-bar pairing. The highest close of a window of
    length h is the larger of two running maxima over the h-aligned stretches it touches,
    so the cost per bar does not grow with h.
    """
    keys, reach = list(keys), max(horizons_ns)
    narrow = bars.select(*keys, "ts_ns", "close")
    ahead, _ = in_slices(narrow, after_ns=reach, keys=keys, width=width)
    seeds = slice_seeds(narrow, keys, "ts_ns", width)
    probes = with_slice(events.select(
        *keys, "ts_ns", F.struct("*").alias("_row")), width=width)
    rows = ahead.drop("_core").unionByName(seeds).unionByName(probes, allowMissingColumns=True)
    rows = rows.withColumn("_bar", F.when(F.col("close").isNotNull(), F.struct("ts_ns", "close")))
    cell = [*keys, SLICE]
    at = W.partitionBy(*cell).orderBy("ts_ns")
    rows = rows.withColumn("_base", F.last("_bar", True).over(
        at.rangeBetween(W.unboundedPreceding, 0)))
    exits = []
    for i, h in enumerate(horizons_ns):
        known = [F.col("ts_ns").alias("ts"), F.col("close").alias("close")]
        if excursions:
            g = f"_g{i}"
            rows = rows.withColumn(g, slice_of("ts_ns", h))
            forth = W.partitionBy(*cell, g).orderBy("ts_ns").rangeBetween(W.unboundedPreceding, 0)
            back = W.partitionBy(*cell, g).orderBy(F.col("ts_ns").desc()).rangeBetween(
                W.unboundedPreceding, 0)
            rows = rows.withColumns({
                f"_hi{i}": F.max("close").over(forth), f"_lo{i}": F.min("close").over(forth),
                f"_rhi{i}": F.max("close").over(back), f"_rlo{i}": F.min("close").over(back)})
            known += [F.col(g).alias("g"), F.col(f"_hi{i}").alias("hi"),
                      F.col(f"_lo{i}").alias("lo")]
        bar = F.when(F.col("close").isNotNull(), F.struct(*known))
        exits.append((f"_exit{i}", F.last(bar, True).over(
            at.rangeBetween(W.unboundedPreceding, h))))
    found = rows.withColumns(dict(exits)).where(F.col("_row").isNotNull())
    buy = F.col("_row.direction") == "buy"
    base = F.col("_base.close")
    outcomes = []
    for i, h in enumerate(horizons_ns):
        x = F.col(f"_exit{i}")
        later = x["ts"] > F.col("_base.ts_ns")
        sign = F.when(buy, 1.0).otherwise(-1.0)
        parts = [F.lit(h).alias("horizon_ns"),
                 F.when(later, (x["close"] / base - 1.0) * 1e4 * sign).alias("ret_bps")]
        if excursions:
            crossed = x["g"] > F.col(f"_g{i}")
            top = F.greatest(base, F.col(f"_rhi{i}"), F.when(crossed, x["hi"]))
            low = F.least(base, F.col(f"_rlo{i}"), F.when(crossed, x["lo"]))
            best = F.when(buy, top / base - 1.0).otherwise(1.0 - low / base)
            worst = F.when(buy, low / base - 1.0).otherwise(1.0 - top / base)
            parts += [F.when(later, best * 1e4).alias("mfe_bps"),
                      F.when(later, worst * 1e4).alias("mae_bps")]
        outcomes.append(F.struct(*parts))
    return found.select("_row.*", F.explode(F.array(*outcomes)).alias("_o")).select(
        *events.columns, "_o.*")


def edge_table(outcomes: DataFrame, by: Sequence[str] = (),
               cost_pairs: Mapping[str, float] | None = None) -> DataFrame:
    """Statistics per horizon (and ``by``); one row per cost pair if costs are given.

    The median takes a second pass, so the outcomes (events, not bars) are written once.
    """
    keys = [*by, "horizon_ns"]
    stored = settle(outcomes.select(*keys, "ret_bps", "mfe_bps", "mae_bps"), "outcomes")
    table = grouped_quantiles(
        stored, keys, "ret_bps", {"median_bps": 0.5}, extra=[
            F.count(F.lit(1)).alias("n_events"),
            F.avg("ret_bps").alias("mean_bps"),
            F.avg((F.col("ret_bps") > 0).cast("double")).alias("hit_rate"),
            F.avg("mfe_bps").alias("mfe_bps"),
            F.avg("mae_bps").alias("mae_bps"),
        ]).withColumnRenamed("n", "n_defined")
    if not cost_pairs:
        return table
    pairs = F.array(*[F.struct(F.lit(k).alias("cost"), F.lit(float(v)).alias("round_trip_bps"))
                      for k, v in cost_pairs.items()])
    return table.select("*", F.inline(pairs)).withColumn(
        "edge_bps", F.col("mean_bps") - F.col("round_trip_bps"))


def session_label(ts: str | Column = "ts_ns") -> Column:
    """UTC session of a time: 0-8, 8-16 or 16-24."""
    hour = F.pmod(slice_of(ts, NS_HOUR), F.lit(24))
    return F.when(hour < 8, "0-8").when(hour < 16, "8-16").otherwise("16-24")


def edge_by_label(events: DataFrame, bars: DataFrame, horizons_ns: Sequence[int], label: Column,
                  cost_pairs: Mapping[str, float] | None = None, width: int = NS_DAY) -> DataFrame:
    """Edge table per label; ``label`` is any column expression, also a pandas UDF."""
    labelled = events.withColumn("label", label)
    return edge_table(forward_outcomes(labelled, bars, horizons_ns, width=width),
                      ["label"], cost_pairs)


def every_bar_edge(bars: DataFrame, horizon_ns: int, min_bars: int = 5,
                   width: int = NS_DAY) -> DataFrame:
    """Mean forward return of buying at every bar; NULL below ``min_bars`` outcomes."""
    events = bars.select("symbol", "ts_ns", F.lit("buy").alias("direction"))
    out = forward_outcomes(events, bars, [horizon_ns], excursions=False, width=width)
    n = F.count("ret_bps")
    return out.groupBy("symbol").agg(
        n.alias("n_defined"), F.when(n >= min_bars, F.avg("ret_bps")).alias("mean_bps"))


def asset_edge(
    events: DataFrame,
    bars: DataFrame,
    horizon_ns: int = 300 * NS_SECOND,
    cost_bps: float = 4.0,
    min_events: int = 30,
    order: Sequence[str] = signals.SCAN_ORDER,
    width: int = NS_DAY,
) -> DataFrame:
    """Best signal per symbol at one horizon, for all symbols in one job.

    ``events`` holds all signals' events; the earlier name of ``order`` wins a tie.
    """
    out = forward_outcomes(events, bars, [horizon_ns], excursions=False, width=width)
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("signal"))
    per_signal = out.groupBy("symbol", "signal").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("ret_bps").alias("_mean"))
    best = F.max_by("signal", F.when(F.col("_mean").isNotNull(),
                                     F.struct("_mean", (-rank).alias("r"))))
    scored = per_signal.groupBy("symbol").agg(
        F.max("_mean").alias("score_bps"), best.alias("best_signal"), F.max("_n").alias("_n"))
    every = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_bars")).select("symbol")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return every.join(scored, "symbol", "left").select(
        "symbol", "score_bps", (F.col("score_bps") - cost_bps).alias("edge_net_bps"),
        "best_signal", n.alias("n_events"), (n < min_events).alias("few_events"))


def edge_sweep(events: DataFrame, bars: DataFrame, grid: DataFrame, horizon_ns: int,
               min_events: int = 100, width: int = NS_DAY) -> DataFrame:
    """Score of every parameter cell at one horizon, ranked; cells without events are kept.

    ``grid`` lists the cells; ``events`` carries the same cell columns. All cells are
    measured in one pass.
    """
    cell = grid.columns
    out = forward_outcomes(events, bars, [horizon_ns], excursions=False, width=width)
    stats = out.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("ret_bps").alias("score_bps"))
    n = F.coalesce(F.col("_n"), F.lit(0))
    ranked = grid.join(stats, cell, "left").select(
        *cell, "score_bps", n.alias("n_events"), (n < min_events).alias("few_events"))
    order = W.orderBy(F.col("score_bps").desc_nulls_last(), *cell)
    return ranked.withColumn("rank", F.row_number().over(order))


def universe_scan(metrics: DataFrame, edges: DataFrame, threshold_edge: float = 0.0) -> DataFrame:
    """Metrics and edge per symbol, ranked by net edge, with the candidate flag."""
    good = ~F.col("dead") & (F.col("edge_net_bps") > threshold_edge) & ~F.col("few_events")
    joined = metrics.join(edges, "symbol").withColumn("candidate", F.coalesce(good, F.lit(False)))
    # One row per symbol: the listing bounds this ordering, not the data.
    order = W.orderBy(F.col("edge_net_bps").desc_nulls_last(), "symbol")
    return joined.withColumn("rank", F.row_number().over(order))
