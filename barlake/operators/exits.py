"""Trade lists of rules whose exits compete: the rule's own, a longest hold and a stop.

Every event is followed to each of its exits on its own, as if it were traded: the bar that decides
by the rule, the bar that ends the longest hold, the first bar that touches the stop. The earliest one
counts. Only then one position at a time is chosen (``chains``), as an exit does not depend on
which events were passed over. Orders decided on a bar fill at the next bar's open. A stop stands from the
bar after the entry's fill on, at a distance from the close of the event's bar; it fills inside its bar, before
that bar's own decision, at the stop or at an open beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.asof import asof_join
from barlake.operators.chains import non_overlapping
from barlake.operators.series import core_rows, in_blocks, running, with_row_index
from barlake.operators.touch import first_touch
from barlake.schemas import NS_DAY
from barlake.session import settle


def numbered_bars(bars: DataFrame, width: int = NS_DAY, *more: str) -> DataFrame:
    """symbol, ts_ns, n (number in its series), next_ts and next_open, and columns asked for; stored."""
    blocks, w = in_blocks(bars.select("symbol", "ts_ns", "open", *more), 0, 1, width=width)
    ahead = core_rows(blocks.withColumns({
        "next_ts": F.lead("ts_ns").over(w), "next_open": F.lead("open").over(w)}))
    return settle(with_row_index(ahead, width=width).withColumnRenamed("_idx", "n").drop("open"), "bars")


def competing_exits(events: DataFrame, steps: DataFrame, bars: DataFrame, max_hold_bars: int | None = None,
                    stop_bps: float | None = None, width: int = NS_DAY) -> DataFrame:
    """Entry and earliest exit of each event.

    ``events``: symbol, ts_ns (the deciding bar), direction (1 or -1), close, rule_n (number of the bar
    that decides to leave by the rule, NULL for none). ``steps``: ``numbered_bars``. Adds entry_ts,
    entry_open, exit_ts, exit_open and reason (stop, rule, hold); a position that is open at the end has
    NULLs. Events without a next bar are left out.
    """
    at = steps.select("symbol", "ts_ns", "n", F.col("next_ts").alias("entry_ts"),
                      F.col("next_open").alias("entry_open"))
    found = events.join(at, ["symbol", "ts_ns"]).where("entry_ts IS NOT NULL")
    cap = F.col("n") + max_hold_bars if max_hold_bars else F.lit(None).cast("bigint")
    found = found.withColumn("_n", F.least("rule_n", cap))
    leave = steps.select("symbol", F.col("n").alias("_n"), F.col("ts_ns").alias("_decided"),
                         F.col("next_ts").alias("exit_ts"), F.col("next_open").alias("exit_open"))
    found = found.join(leave, ["symbol", "_n"], "left").withColumn("reason", F.when(
        F.col("exit_ts").isNotNull(), F.when(F.col("_n") == F.col("rule_n"), "rule").otherwise("hold")))
    if stop_bps is None:
        return found.drop("_n", "_decided", "rule_n", "n")
    d = F.col("direction")
    asks = found.withColumns({"_stop": F.col("close") * (1 - d * stop_bps / 1e4),
                              "arrive_ns": F.col("entry_ts") + 1})
    hit = first_touch(asks, bars, "_stop", d > 0, False, "low", "high", values=["open"], width=width)
    first = F.col("hit_ts_ns").isNotNull() & (F.col("_decided").isNull() | (
        F.col("hit_ts_ns") <= F.col("_decided")))
    worse = F.when(d > 0, F.least("hit_open", "_stop")).otherwise(F.greatest("hit_open", "_stop"))
    return hit.withColumns({
        "exit_ts": F.when(first, F.col("hit_ts_ns")).otherwise(F.col("exit_ts")),
        "exit_open": F.when(first, worse).otherwise(F.col("exit_open")),
        "reason": F.when(first, "stop").otherwise(F.col("reason"))}).drop(
        "_n", "_decided", "rule_n", "n", "_stop", "arrive_ns", "hit_ts_ns", "hit_open")


def one_at_a_time(candidates: DataFrame, slippage_bps: float, taker_bps: float,
                  width: int = NS_DAY, free: Column | None = None) -> DataFrame:
    """Greedy choice by event time, closed trades only, with prices and costs. ``free``: when the next
    event counts, by default the exit bar."""
    from barlake.operators.trades import priced

    end = F.col("exit_ts") if free is None else free
    chosen = non_overlapping(candidates.withColumn("_free", end), ("symbol",), "ts_ns", "_free", width)
    return priced(chosen.drop("_free").where("exit_ts IS NOT NULL"), slippage_bps, taker_bps)


def band_exit_trades(rows: DataFrame, bars: DataFrame, value: str, enter: float, leave: float,
                     slippage_bps: float, taker_bps: float, stop_bps: float | None = None,
                     max_hold_bars: int | None = None, width: int = NS_DAY) -> DataFrame:
    """Mean reversion with all exits: buy at or below -enter, sell at or above it; leave once the value is
    back inside ``leave``, at the stop, or after ``max_hold_bars`` bars.

    ``rows``: symbol, ts_ns and the value (NULL while unknown: no decision by the rule).
    """
    if enter <= leave:
        raise ValueError("the entry threshold must lie beyond the exit threshold")
    steps = numbered_bars(bars, width, "close")
    known = steps.join(rows.select("symbol", "ts_ns", F.col(value).alias("_x")), ["symbol", "ts_ns"], "left")
    x = F.col("_x")
    back = running(known.withColumn("_back", -F.col("ts_ns")), {
        "_long": ("last", F.when(x >= -leave, F.col("n"))),
        "_short": ("last", F.when(x <= leave, F.col("n")))}, ts="_back", width=width)
    d = F.when(x <= -enter, 1).when(x >= enter, -1)
    events = back.withColumn("direction", d).where("direction IS NOT NULL").select(
        "symbol", "ts_ns", "direction", "close",
        F.when(F.col("direction") > 0, F.col("_long")).otherwise(F.col("_short")).alias("rule_n"))
    return one_at_a_time(competing_exits(events, steps, bars, max_hold_bars, stop_bps, width),
                         slippage_bps, taker_bps, width)


def range_exit_trades(events: DataFrame, bars: DataFrame, max_hold_bars: int | None, slippage_bps: float,
                      taker_bps: float, stop_bps: float | None = None, width: int = NS_DAY) -> DataFrame:
    """Breakout trades that leave once a close is back inside the entry range, at the stop, or after
    ``max_hold_bars`` bars. ``events``: symbol, ts_ns, direction (buy, sell), level."""
    steps = numbered_bars(bars, width, "close")
    asks = events.withColumns({"arrive_ns": F.col("ts_ns") + 1, "event_ts": F.col("ts_ns")})
    back = first_touch(asks, steps.select("symbol", "ts_ns", "close", "n"), "level",
                       F.col("direction") == "buy", True, "close", "close", values=["n"], width=width)
    close = steps.select("symbol", F.col("ts_ns").alias("event_ts"), "close")
    told = back.join(close, ["symbol", "event_ts"]).select(
        "symbol", "ts_ns", F.when(F.col("direction") == "buy", 1).otherwise(-1).alias("direction"),
        "close", F.col("hit_n").alias("rule_n"))
    return one_at_a_time(competing_exits(told, steps, bars, max_hold_bars, stop_bps, width),
                         slippage_bps, taker_bps, width)


def fixed_hold_trades(events: DataFrame, bars: DataFrame, hold_bars: int, slippage_bps: float,
                      taker_bps: float, width: int = NS_DAY) -> DataFrame:
    """Trades that enter at the next bar's open and leave ``hold_bars`` bars later. One position at a
    time: events while a trade is open are passed over. ``events``: symbol, ts_ns, direction."""
    steps = numbered_bars(bars, width)
    told = events.select("symbol", "ts_ns", F.when(F.col("direction") == "buy", 1).otherwise(-1).alias(
        "direction"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("bigint").alias("rule_n"))
    return one_at_a_time(competing_exits(told, steps, bars, hold_bars, None, width).drop("close", "reason"),
                         slippage_bps, taker_bps, width)


def settlement_hold_trades(events: DataFrame, bars: DataFrame, hold_bars: int, interval_ns: int,
                           latency_ns: int, slippage_bps: float, taker_bps: float,
                           width: int = NS_DAY) -> DataFrame:
    """Trades opened by funding settlements, between bars, and held for ``hold_bars`` bars.

    The order of an event fills on the first bar that closes ``latency_ns`` after it or later, at
    its open. The hold counts from the bar after the fill; the exit fills on the bar after its last one. A
    settlement at or before the close of the exit's bar finds the position open and is passed over.
    """
    steps = numbered_bars(bars, width)
    own = settle(with_row_index(bars.select("symbol", "ts_ns", "open"), width=width), "opens")
    closes = own.select("symbol", (-(F.col("ts_ns") + interval_ns)).alias("_axis"), "_idx",
                        F.col("ts_ns").alias("entry_ts"), F.col("open").alias("entry_open"))
    asks = events.select("symbol", "ts_ns", F.when(F.col("direction") == "buy", 1).otherwise(-1).alias(
        "direction"), (-(F.col("ts_ns") + latency_ns)).alias("_want"))
    entered = asof_join(asks, closes, left_ts="_want", right_ts="_axis",
                        values=["_idx", "entry_ts", "entry_open"], width=width).where("entry_ts IS NOT NULL")
    leave = steps.select("symbol", (F.col("n") - hold_bars).alias("_idx"), F.col("next_ts").alias("exit_ts"),
                         F.col("next_open").alias("exit_open"))
    found = entered.join(leave, ["symbol", "_idx"], "left").drop("_idx", "_want")
    return one_at_a_time(found, slippage_bps, taker_bps, width, F.col("exit_ts") + interval_ns + 1)
