"""Rolling indicators over bars. Undefined values are NULL.

The ``*_in`` helpers add a column inside a given window, so that several indicators share
one block layout (one shuffle, one sort); the plain functions lay the blocks out themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators.quantiles import grouped_quantiles
from barlake.operators.series import (
    BLOCK_ROWS, core_rows, in_blocks, running, with_row_index)
from barlake.schemas import NS_DAY
from barlake.session import settle


def zscore_in(df: DataFrame, w: W, window: int, value: str = "close", out: str = "z") -> DataFrame:
    f = w.rowsBetween(-(window - 1), 0)
    v, sd = F.col(value), F.stddev_pop(value).over(f)
    full = (F.count(value).over(f) == window) & (sd > 0)
    return df.withColumn(out, F.when(full, (v - F.avg(value).over(f)) / sd))


def returns_in(df: DataFrame, w: W, value: str = "close", out: str = "ret") -> DataFrame:
    before = F.lag(value).over(w)
    return df.withColumn(out, F.col(value) / F.nullif(before, F.lit(0.0)) - 1.0)


def realized_vol_in(df: DataFrame, w: W, window: int, value: str = "close",
                    out: str = "vol") -> DataFrame:
    f = w.rowsBetween(-(window - 1), 0)
    full = F.count("_ret").over(f) == window
    return returns_in(df, w, value, "_ret").withColumn(
        out, F.when(full, F.stddev_pop("_ret").over(f))).drop("_ret")


def flow_imbalance_in(df: DataFrame, w: W, window: int, out: str = "flow") -> DataFrame:
    f = w.rowsBetween(-(window - 1), 0)
    total, buy = F.sum("volume").over(f), F.sum("taker_buy_volume").over(f)
    full = (F.count("volume").over(f) == window) & (total != 0)
    return df.withColumn(out, F.when(full, F.lit(2.0) * buy / total - 1.0))


def _blocked(bars: DataFrame, halo: int, add: Callable[[DataFrame, W], DataFrame],
             block_rows: int, width: int) -> DataFrame:
    blocks, w = in_blocks(bars, before=halo, block_rows=block_rows, width=width)
    return core_rows(add(blocks, w))


def zscore(bars: DataFrame, window: int, value: str = "close", out: str = "z",
           block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Distance from the rolling mean in population deviations; NULL until full or flat."""
    return _blocked(bars, window, lambda d, w: zscore_in(d, w, window, value, out),
                    block_rows, width)


def realized_vol(bars: DataFrame, window: int, value: str = "close", out: str = "vol",
                 block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Population deviation of the last ``window`` simple returns."""
    return _blocked(bars, window, lambda d, w: realized_vol_in(d, w, window, value, out),
                    block_rows, width)


def flow_imbalance(bars: DataFrame, window: int, out: str = "flow",
                   block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """Taker buys minus taker sells over all volume of the last ``window`` bars."""
    return _blocked(bars, window, lambda d, w: flow_imbalance_in(d, w, window, out),
                    block_rows, width)


def session_vwap(bars: DataFrame, price: str = "close", out: str = "vwap") -> DataFrame:
    """Volume-weighted price since UTC midnight. A symbol-day of bars is a bounded group."""
    day = F.col("ts_ns") - F.pmod("ts_ns", F.lit(NS_DAY))
    upto = W.partitionBy("symbol", "_day").orderBy("ts_ns").rowsBetween(W.unboundedPreceding, 0)
    pv = F.sum(F.col(price) * F.col("volume")).over(upto)
    vol = F.sum("volume").over(upto)
    return bars.withColumn("_day", day).withColumn(
        out, F.when(vol != 0, pv / vol)).drop("_day")


def ema(bars: DataFrame, span: int, value: str = "close", out: str = "ema",
        keys: Sequence[str] = ("symbol",), block_rows: int = BLOCK_ROWS,
        width: int = NS_DAY) -> DataFrame:
    """Exponential moving average seeded with the first value, exact for any length.

    The recurrence is affine, so a block maps the average it receives to the one it hands
    on as ``decay * carry + own``. ``own`` is a plain weighted sum per block; the chain of
    blocks is short (rows / block_rows) and walked per symbol; then every block replays its
    rows from its carry, all blocks in parallel.
    """
    keys, alpha = list(keys), 2.0 / (span + 1.0)
    rest = 1.0 - alpha
    rows = with_row_index(bars, keys, "ts_ns", width).withColumn(
        "_block", F.floor(F.col("_idx") / block_rows))
    cell = [*keys, "_block"]
    position = F.col("_idx") - F.col("_block") * block_rows
    # Weighted towards the block's end as if it were full; short last blocks hand on nothing.
    weight = F.when(F.col("_idx") == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(
        F.lit(rest), F.lit(block_rows - 1) - position)
    own = rows.groupBy(*cell).agg(F.sum(F.col(value) * weight).alias("_own"))
    decay = rest ** block_rows
    key_fields = [bars.schema[k] for k in keys]
    carry_schema = T.StructType([*key_fields, T.StructField("_block", T.LongType()),
                                 T.StructField("_carry", T.DoubleType())])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        carries, state = [], None
        for x in pdf["_own"]:
            carries.append(state)
            state = x if state is None else decay * state + x
        return pdf.assign(_carry=pd.Series(carries, index=pdf.index, dtype="float64"))[
            [*keys, "_block", "_carry"]]

    carry = own.groupBy(*keys).applyInPandas(chain, carry_schema)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        seed = pdf["_carry"].iloc[0]
        x = pdf[value].astype("float64")
        if pd.notna(seed):
            x = pd.concat([pd.Series([seed]), x])
        avg = x.ewm(alpha=alpha, adjust=False).mean()
        pdf[out] = avg.iloc[1:].to_numpy() if pd.notna(seed) else avg.to_numpy()
        return pdf[names]

    schema = T.StructType([*bars.schema.fields, T.StructField(out, T.DoubleType())])
    names = schema.names
    return rows.join(carry, cell).groupBy(*cell).applyInPandas(replay, schema)


def vol_regime(bars: DataFrame, window: int, out: str = "regime",
               block_rows: int = BLOCK_ROWS, width: int = NS_DAY) -> DataFrame:
    """``high`` where volatility is above the symbol's median, else ``low``.

    Bars without a defined volatility keep the last label; before any, ``low``.
    """
    vols = settle(realized_vol(bars, window, out="_vol", block_rows=block_rows, width=width))
    medians = grouped_quantiles(vols, ["symbol"], "_vol", {"_median": 0.5}).drop("n")
    label = F.when(F.col("_vol") > F.col("_median"), "high").when(
        F.col("_vol").isNotNull(), "low")
    labelled = running(vols.join(medians, "symbol", "left"), {out: ("last", label)}, width=width)
    return labelled.withColumn(out, F.coalesce(F.col(out), F.lit("low"))).drop("_vol", "_median")


def return_volatility(bars: DataFrame, value: str = "close", out: str = "vol_bps",
                      width: int = NS_DAY) -> DataFrame:
    """Population deviation of all simple returns per symbol in bps; 0 below two values."""
    blocks, w = in_blocks(bars.select("symbol", "ts_ns", value), before=1, width=width)
    rets = core_rows(returns_in(blocks, w, value))
    return rets.groupBy("symbol").agg(
        (F.coalesce(F.stddev_pop("ret"), F.lit(0.0)) * 1e4).alias(out))


def turnover(position: str | Column, w: W) -> Column:
    """Absolute change of position, the first row against flat."""
    p = F.col(position) if isinstance(position, str) else position
    return F.abs(p - F.coalesce(F.lag(p).over(w), F.lit(0.0)))


