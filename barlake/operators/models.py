"""Daily position models over parameter cells: trend, cash-and-carry, flow screen.

All run on daily series: a (symbol, cell) group holds one row per calendar day, so windows
and groups here are bounded by the length of the calendar; symbols and cells run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.lookups import sum_per_interval
from barlake.operators.performance import DAILY_PARTS, consecutive_days
from barlake.schemas import NS_DAY


def hysteresis(enter: Column, leave: Column, w: W) -> Column:
    """1 from an entry until the next exit, else 0. The two conditions must be disjoint."""
    event = F.when(enter, 1).when(leave, 0)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit(0))


@dataclass(frozen=True)
class TrendCell:
    name: str
    lookback: int
    mode: str  # long_short, long_flat or buy_hold
    cost_bps: float


def trend_model(closes: DataFrame, marked_funding: DataFrame,
                cells: Sequence[TrendCell]) -> DataFrame:
    """Daily trend returns per (symbol, cell) with exact turnover costs.

    ``closes``: symbol, ts_ns (consecutive daily opens), close. ``marked_funding``: symbol,
    ts_ns, amount = rate times mark. A decision at the close of day t earns t to t+1. Target
    quantity depends on equity, so the fee recursion runs day by day inside each cell.
    """
    for c in cells:
        if c.mode not in ("long_short", "long_flat", "buy_hold") or c.lookback <= 0:
            raise ValueError(f"bad cell {c}")
    w = W.partitionBy("symbol").orderBy("ts_ns")
    paid = sum_per_interval(marked_funding, "amount", ["symbol"], NS_DAY, "_paid").withColumn(
        "ts_ns", F.col("ts_ns") - NS_DAY)
    days = consecutive_days(closes, ["symbol"]).withColumn("_next", F.lead("close").over(w))
    lookbacks = sorted({c.lookback for c in cells})
    days = days.withColumns({f"_r{n}": F.col("close") / F.lag("close", n).over(w) - 1.0
                             for n in lookbacks})
    cell_rows = []
    for c in cells:
        r = F.col(f"_r{c.lookback}")
        position = {"buy_hold": F.lit(1.0), "long_short": F.coalesce(F.signum(r), F.lit(0.0)),
                    "long_flat": F.when(r > 0, 1.0).otherwise(0.0)}[c.mode]
        cell_rows.append(F.struct(F.lit(c.name).alias("cell"), position.alias("position"),
                                  F.lit(c.cost_bps / 1e4).alias("_cost")))
    rows = days.join(paid, ["symbol", "ts_ns"], "left").where(F.col("_next").isNotNull()).select(
        "symbol", "ts_ns", (F.col("_next") / F.col("close") - 1.0).alias("market"),
        (F.coalesce(F.col("_paid"), F.lit(0.0)) / F.col("close")).alias("_f"),
        F.inline(F.array(*cell_rows)))

    def account(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ns")
        pos, market = pdf["position"].to_numpy(), pdf["market"].to_numpy()
        funding, cost = -pos * pdf["_f"].to_numpy(), float(pdf["_cost"].iloc[0])
        turnover, net = np.zeros(len(pdf)), np.zeros(len(pdf))
        drifted = 0.0
        for i in range(len(pdf)):
            turnover[i] = abs(pos[i] - drifted)
            net[i] = pos[i] * market[i] + funding[i] - turnover[i] * cost
            if net[i] <= -1.0:
                raise ValueError(f"return at or below -1 in cell {pdf['cell'].iloc[0]}")
            drifted = pos[i] * (1.0 + market[i]) / (1.0 + net[i])
        return pd.DataFrame({
            "symbol": pdf["symbol"], "cell": pdf["cell"], "ts_ns": pdf["ts_ns"],
            "position": pos, "market": market, "net": net, "exposure": np.abs(pos),
            "turnover": turnover, "gross": pos * market, "fee": turnover * cost,
            "funding": funding})

    return rows.groupBy("symbol", "cell").applyInPandas(
        account, "symbol string, cell string, ts_ns long, position double, market double, "
        + ", ".join(f"{c} double" for c in DAILY_PARTS))


@dataclass(frozen=True)
class CarryCell:
    name: str
    lookback: int
    entry_funding: float
    exit_funding: float
    entry_basis: float
    exit_basis: float
    spot_cost_bps: float
    perp_cost_bps: float
    mode: str = "filtered"  # or always


def carry_model(legs: DataFrame, funding: DataFrame, cells: Sequence[CarryCell],
                key: str = "pair") -> DataFrame:
    """Long spot, short perp of equal quantity, entered and left on funding and basis.

    ``legs``: key, ts_ns (consecutive daily opens), spot, perp; ``funding``: key, ts_ns, rate.
    Per entry, PnL is linear in the equity at entry, so every return is a ratio of running
    sums inside the episode and no day depends on the one before it.
    """
    for c in cells:
        if c.mode not in ("filtered", "always") or c.lookback <= 0:
            raise ValueError(f"bad cell {c}")
        if c.mode == "filtered" and not (
                c.entry_funding > c.exit_funding and c.entry_basis > c.exit_basis):
            raise ValueError("entry thresholds must lie above the exit thresholds")
    w = W.partitionBy(key).orderBy("ts_ns")
    rates = sum_per_interval(funding, "rate", [key], NS_DAY, "_rate")
    days = consecutive_days(legs, [key]).join(rates, [key, "ts_ns"], "left").withColumn(
        "_rate", F.coalesce("_rate", F.lit(0.0)))
    trailing = {f"_s{n}": F.when(F.count("spot").over(w.rowsBetween(-(n - 1), 0)) == n,
                                 F.sum("_rate").over(w.rowsBetween(-(n - 1), 0)))
                for n in sorted({c.lookback for c in cells})}
    days = days.withColumns({
        **trailing, "_ns": F.lead("spot").over(w), "_np": F.lead("perp").over(w),
        "_nr": F.lead("_rate").over(w), "_basis": F.col("perp") / F.col("spot") - 1.0})
    basis, cell_rows = F.col("_basis"), []
    for c in cells:
        s = F.col(f"_s{c.lookback}")
        if c.mode == "always":
            event = F.when(s.isNotNull(), 1)
        else:
            event = F.when((s >= c.entry_funding) & (basis >= c.entry_basis), 1).when(
                (s <= c.exit_funding) | (basis <= c.exit_basis), 0)
        cell_rows.append(F.struct(
            F.lit(c.name).alias("cell"), event.alias("_event"),
            F.lit(c.spot_cost_bps / 1e4).alias("_sc"), F.lit(c.perp_cost_bps / 1e4).alias("_pc")))
    rows = days.where(F.col("_ns").isNotNull()).select("*", F.inline(F.array(*cell_rows)))
    cw = W.partitionBy(key, "cell").orderBy("ts_ns")
    upto = cw.rowsBetween(W.unboundedPreceding, 0)
    held = F.coalesce(F.last("_event", ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumn("position", held)
    was = F.coalesce(F.lag("position").over(cw), F.lit(0))
    rows = rows.withColumn("_in", (F.col("position") == 1) & (was == 0)).withColumn(
        "_out", (F.col("position") == 0) & (was == 1))
    rows = rows.withColumn("_episode", F.sum(F.col("_in").cast("int")).over(upto))
    ew = W.partitionBy(key, "cell", "_episode").orderBy("ts_ns")
    so_far = ew.rowsBetween(W.unboundedPreceding, 0)
    q = F.lit(1.0) / (F.first("spot").over(so_far) + F.first("perp").over(so_far))
    on, traded = F.col("position") == 1, F.col("_in") | F.col("_out")
    zero = F.lit(0.0)
    rows = rows.withColumn("_q", F.when(F.col("_episode") > 0, q).otherwise(zero)).withColumns({
        "_price": F.when(on, F.col("_q") * ((F.col("_ns") - F.col("spot"))
                                            - (F.col("_np") - F.col("perp")))).otherwise(zero),
        "_fund": F.when(on, F.col("_q") * F.col("perp") * F.col("_nr")).otherwise(zero),
        "_fee": F.when(traded, F.col("_q") * (F.col("spot") * F.col("_sc")
                                              + F.col("perp") * F.col("_pc"))).otherwise(zero)})
    step = F.col("_price") + F.col("_fund") - F.col("_fee")
    rows = rows.withColumn("_after", F.lit(1.0) + F.sum(step).over(so_far))
    before = F.coalesce(F.lag("_after").over(ew), F.lit(1.0))
    rows = rows.withColumn("_before", before)
    broke = F.raise_error(F.lit("equity exhausted")).cast("double")
    ratio = F.col("_after") / F.col("_before") - 1.0
    return rows.select(
        key, "cell", (F.col("ts_ns") + NS_DAY).alias("ts_ns"),
        F.col("position").cast("double").alias("position"),
        (F.col("_price") / F.col("_before")).alias("gross"),
        (F.col("_fund") / F.col("_before")).alias("funding"),
        (F.col("_fee") / F.col("_before")).alias("fee"),
        F.when(F.col("_after") > 0, ratio).otherwise(broke).alias("net"),
        F.col("position").cast("double").alias("exposure"),
        F.when(traded, 1.0).otherwise(zero).alias("turnover"))


def flow_screen(flows: DataFrame, lookback: int, cost_bps: float, keys: Sequence[str] = ("set",),
                entry: str = "entry", leave: str = "exit") -> DataFrame:
    """Short while summed net inflow stays high; flat again once it is small either way.

    ``flows``: keys, ts_ns, deposit, withdraw, close, and the thresholds as columns. Day t
    uses flows up to t and earns the move to the next row's close; the last day pays fees only.
    """
    w = W.partitionBy(*keys).orderBy("ts_ns")
    f = w.rowsBetween(-(lookback - 1), 0)
    full = F.count("deposit").over(f) == lookback
    net = F.when(full, F.sum("deposit").over(f) - F.sum("withdraw").over(f))
    bad = F.raise_error(F.lit("entry must exceed exit")).cast("boolean")
    enter = F.when(F.col(entry) > F.col(leave), F.col("net_flow") >= F.col(entry)).otherwise(bad)
    rows = flows.withColumn("net_flow", net)
    held = hysteresis(enter, F.abs("net_flow") <= F.col(leave), w)
    rows = rows.withColumn("position", -held.cast("double"))
    change = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    move = F.coalesce(F.lead("close").over(w) / F.col("close") - 1.0, F.lit(0.0))
    rows = rows.withColumns({"turnover": change, "market": move})
    fee = F.when(F.col("turnover") != 0, cost_bps / 1e4).otherwise(0.0)
    gross = F.col("position") * F.col("market")
    return rows.withColumns({
        "exposure": F.abs("position"), "gross": gross, "fee": fee, "funding": F.lit(0.0),
        "net": gross - fee, "net_flow": F.coalesce("net_flow", F.lit(0.0))})


def best_per_group(table: DataFrame, by: Sequence[str], score: str,
                   tie: Sequence[str]) -> DataFrame:
    """Row with the highest score per group; a partial aggregate, ties by ``tie``."""
    row = F.struct("*")
    ranked = table.groupBy(*by).agg(F.max(score).alias("_top"))
    top = table.join(ranked, list(by)).where(F.col(score) == F.col("_top")).drop("_top")
    return top.groupBy(*by).agg(F.min_by(row, F.struct(*tie)).alias("_r")).select("_r.*")
