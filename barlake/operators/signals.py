"""Signal events from bars: (symbol, signal, ts_ns, direction).

A signal is any function DataFrame -> DataFrame of that shape; ``SIGNALS`` names the
built-in ones and ``register`` adds a user's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.features import flow_imbalance_in, zscore_in
from barlake.operators.series import BLOCK_ROWS, CORE, in_blocks
from barlake.schemas import NS_DAY

Signal = Callable[..., DataFrame]
SIGNALS: dict[str, Signal] = {}


def register(name: str) -> Callable[[Signal], Signal]:
    def add(fn: Signal) -> Signal:
        SIGNALS[name] = fn
        return fn
    return add


def zone(value: Column, low: float, high: float) -> Column:
    """-1 at or below ``low``, 1 at or above ``high``, else 0 (also for NULL)."""
    return F.when(value <= low, -1).when(value >= high, 1).otherwise(0)


def _crossings(df: DataFrame, w, value: str, limit: float, signal: str,
               below: str, above: str) -> DataFrame:
    """Events where the value enters a zone outside the band; no repeats inside it."""
    z = df.withColumn("_zone", zone(F.col(value), -limit, limit))
    entered = F.col("_zone") != F.coalesce(F.lag("_zone").over(w), F.lit(0))
    hit = z.withColumn("_hit", entered & (F.col("_zone") != 0)).where(F.col("_hit") & F.col(CORE))
    return hit.select("symbol", F.lit(signal).alias("signal"), "ts_ns",
                      F.when(F.col("_zone") < 0, below).otherwise(above).alias("direction"))


@register("meanrev")
def meanrev(bars: DataFrame, window: int = 120, entry_z: float = 2.5, value: str = "close",
            block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Z-score crossing: below the band buys, above sells."""
    narrow = bars.select("symbol", "ts_ns", value)
    blocks, w = in_blocks(narrow, before=window + 1, block_rows=block_rows, width=width)
    return _crossings(zscore_in(blocks, w, window, value), w, "z", entry_z,
                      "meanrev", "buy", "sell")


def breakout_side(df: DataFrame, w, lookback: int, volume_factor: float) -> DataFrame:
    """Add ``_side``: buy/sell where the close leaves the previous range on high volume."""
    f = w.rowsBetween(-lookback, -1)
    full = F.count("close").over(f) == lookback
    loud = F.col("volume") > F.lit(volume_factor) * F.avg("volume").over(f)
    side = F.when(F.col("close") > F.max("high").over(f), "buy").when(
        F.col("close") < F.min("low").over(f), "sell")
    return df.withColumn("_side", F.when(full & loud, side))


@register("breakout")
def breakout(bars: DataFrame, lookback: int = 30, volume_factor: float = 5.0,
             block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Close outside the previous ``lookback`` bars' range with above-average volume."""
    narrow = bars.select("symbol", "ts_ns", "high", "low", "close", "volume")
    blocks, w = in_blocks(narrow, before=lookback, block_rows=block_rows, width=width)
    hits = breakout_side(blocks, w, lookback, volume_factor).where(
        F.col("_side").isNotNull() & F.col(CORE))
    return hits.select("symbol", F.lit("breakout").alias("signal"), "ts_ns",
                       F.col("_side").alias("direction"))


@register("flow")
def flow(bars: DataFrame, window: int = 120, threshold: float = 0.5,
         block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Taker imbalance crossing: above the band buys, below sells."""
    narrow = bars.select("symbol", "ts_ns", "volume", "taker_buy_volume")
    blocks, w = in_blocks(narrow, before=window + 1, block_rows=block_rows, width=width)
    return _crossings(flow_imbalance_in(blocks, w, window), w, "flow", threshold,
                      "flow", "sell", "buy")


@register("momentum")
def momentum(bars: DataFrame, lookback: int, threshold: float,
             block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Lookback return crossing: above the band buys, below sells."""
    narrow = bars.select("symbol", "ts_ns", "close")
    blocks, w = in_blocks(narrow, before=lookback + 1, block_rows=block_rows, width=width)
    past = F.nullif(F.lag("close", lookback).over(w), F.lit(0.0))
    return _crossings(blocks.withColumn("_r", F.col("close") / past - 1.0), w, "_r", threshold,
                      "momentum", "sell", "buy")


@register("basis")
def basis(legs: DataFrame, window: int, entry_z: float, block_rows: int = BLOCK_ROWS,
          width: int = NS_DAY) -> DataFrame:
    """Z-score crossing of perp / spot - 1 over (symbol, ts_ns, spot, perp)."""
    b = F.col("perp") / F.nullif(F.col("spot"), F.lit(0.0)) - 1.0
    narrow = legs.select("symbol", "ts_ns", b.alias("_b"))
    blocks, w = in_blocks(narrow, before=window + 1, block_rows=block_rows, width=width)
    return _crossings(zscore_in(blocks, w, window, "_b"), w, "z", entry_z,
                      "basis", "buy", "sell")


@register("funding_extreme")
def funding_extreme(funding: DataFrame, threshold: float) -> DataFrame:
    """Every settlement at or beyond the threshold: positive sells, negative buys."""
    side = F.when(F.col("rate") >= threshold, "sell").when(F.col("rate") <= -threshold, "buy")
    return funding.select("symbol", F.lit("funding_extreme").alias("signal"), "ts_ns",
                          side.alias("direction")).where(F.col("direction").isNotNull())


@register("funding_percentile")
def funding_percentile(funding: DataFrame, window: int, pct: float, direction: str = "buy",
                       block_rows: int = BLOCK_ROWS, width: int = 64 * NS_DAY) -> DataFrame:
    """Rates at or above a percentile of the previous settlements and above their median."""
    narrow = funding.select("symbol", "ts_ns", "rate").where(F.col("rate").isNotNull())
    blocks, w = in_blocks(narrow, before=window, block_rows=block_rows, width=width)
    past = w.rowsBetween(-window, -1)
    enough = F.count("rate").over(past) >= max(5, window // 2)
    hit = (F.col("rate") >= F.percentile("rate", pct / 100.0).over(past)) & (
        F.col("rate") > F.percentile("rate", 0.5).over(past))
    return blocks.withColumn("_hit", enough & hit).where(F.col("_hit") & F.col(CORE)).select(
        "symbol", F.lit("funding_percentile").alias("signal"), "ts_ns",
        F.lit(direction).alias("direction"))


def meanrev_grid(bars: DataFrame, windows: list[int], entry_zs: list[float],
                 value: str = "close", block_rows: int = BLOCK_ROWS,
                 width: int = NS_DAY) -> DataFrame:
    """Mean-reversion events of every (width, entry_z) cell from one block layout."""
    blocks, w = in_blocks(bars.select("symbol", "ts_ns", value), before=max(windows) + 1,
                          block_rows=block_rows, width=width)
    for n in windows:
        blocks = zscore_in(blocks, w, n, value, f"_z{n}")
    blocks = blocks.withColumns({f"_p{n}": F.lag(f"_z{n}").over(w) for n in windows})
    cells = []
    for n in windows:
        for limit in entry_zs:
            now = zone(F.col(f"_z{n}"), -limit, limit)
            entered = (now != zone(F.col(f"_p{n}"), -limit, limit)) & (now != 0)
            cells.append(F.struct(
                F.lit(n).alias("width"), F.lit(float(limit)).alias("entry_z"),
                F.when(entered, F.when(now < 0, "buy").otherwise("sell")).alias("direction")))
    fired = F.filter(F.array(*cells), lambda c: c["direction"].isNotNull())
    return blocks.where(CORE).select("symbol", "ts_ns", F.inline(fired))


def scan_signals(
    bars: DataFrame,
    lookback: int = 30, volume_factor: float = 5.0,
    window: int = 120, entry_z: float = 2.5,
    flow_window: int = 120, flow_threshold: float = 0.5,
    block_rows: int = BLOCK_ROWS, width: int = NS_DAY,
) -> DataFrame:
    """Breakout, mean-reversion and flow events together, from one block layout."""
    narrow = bars.select("symbol", "ts_ns", "high", "low", "close", "volume", "taker_buy_volume")
    reach = max(lookback, window, flow_window) + 1
    blocks, w = in_blocks(narrow, before=reach, block_rows=block_rows, width=width)
    df = breakout_side(blocks, w, lookback, volume_factor)
    df = flow_imbalance_in(zscore_in(df, w, window), w, flow_window)
    df = df.withColumns({"_mz": zone(F.col("z"), -entry_z, entry_z),
                         "_fz": zone(F.col("flow"), -flow_threshold, flow_threshold)})
    df = df.withColumns({"_mp": F.coalesce(F.lag("_mz").over(w), F.lit(0)),
                         "_fp": F.coalesce(F.lag("_fz").over(w), F.lit(0))})
    m = F.when((F.col("_mz") != F.col("_mp")) & (F.col("_mz") != 0),
               F.when(F.col("_mz") < 0, "buy").otherwise("sell"))
    f = F.when((F.col("_fz") != F.col("_fp")) & (F.col("_fz") != 0),
               F.when(F.col("_fz") > 0, "buy").otherwise("sell"))
    fired = F.filter(F.array(*[
        F.struct(F.lit(n).alias("signal"), d.alias("direction"))
        for n, d in (("breakout", F.col("_side")), ("meanrev", m), ("flow", f))
    ]), lambda c: c["direction"].isNotNull())
    return df.where(CORE).select("symbol", "ts_ns", F.inline(fired))


# Order in which signals win a tie of scores.
SCAN_ORDER = ("breakout", "meanrev", "flow")


def breakout_levels(bars: DataFrame, lookback: int, volume_factor: float,
                    block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Breakout events with the edge of the range they left (``level``)."""
    narrow = bars.select("symbol", "ts_ns", "high", "low", "close", "volume")
    blocks, w = in_blocks(narrow, before=lookback, block_rows=block_rows, width=width)
    f = w.rowsBetween(-lookback, -1)
    rows = breakout_side(blocks, w, lookback, volume_factor).withColumns({
        "_top": F.max("high").over(f), "_low": F.min("low").over(f)})
    hits = rows.where(F.col("_side").isNotNull() & F.col(CORE))
    return hits.select("symbol", "ts_ns", F.col("_side").alias("direction"), F.when(
        F.col("_side") == "buy", F.col("_top")).otherwise(F.col("_low")).alias("level"))
