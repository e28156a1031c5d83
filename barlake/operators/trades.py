"""Round trips from fills, trade lists from signals, folds, stress and sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.functions.scalars import exact_units
from barlake.operators.asof import asof_join
from barlake.operators.series import BLOCK_ROWS, core_rows, in_blocks, running, with_row_index
from barlake.schemas import NS_DAY
from barlake.session import settle

PLACES = 12  # decimals of quantities whose instrument names no step


def signed_qty():
    return F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))


def positions(fills: DataFrame, keys: Sequence[str] = ("run_id",), width: int = NS_DAY,
              step: str | None = None) -> DataFrame:
    """Position after each fill. Quantities are summed as whole numbers of the instrument's step
    (column ``step``; without one, 12 decimals), taken from their decimal text, so a position is zero
    exactly where it closes, whatever its size and history."""
    units = exact_units(signed_qty(), step and F.col(step), PLACES)
    out = running(fills, {"_units": ("sum", units)}, keys, width=width, tie=["order_id"])
    one = F.col(step) if step else F.lit(10.0 ** -PLACES)
    return out.withColumn("position", F.col("_units").cast("double") * one.cast("double")).drop("_units")


def round_trips(fills: DataFrame, keys: Sequence[str] = ("run_id",), width: int = NS_DAY,
                funding: DataFrame | None = None, step: str | None = None) -> DataFrame:
    """One row per stretch from flat to flat; open stretches are left out. ``step``: column with
    the quantity step of the instrument.

    Gross is the cash the fills brought in. ``net`` follows the published identity (slippage
    is subtracted although fill prices include it); ``net_cash`` is the account's own change.
    ``funding``: payments (keys, ts_ns, paid), booked to the trip open at their time.
    """
    keys = list(keys)
    # Three scans follow one another; storing the first keeps them from repeating each other.
    pos = settle(positions(fills, keys, width, step), "positions")
    slip = F.col("slippage_cost") if "slippage_cost" in fills.columns else F.lit(0.0)
    rows = running(pos.withColumn("_slip", slip), {
        "_was": ("prev", F.col("position"))}, keys, width=width, tie=["order_id"])
    opened = F.coalesce(F.col("_was"), F.lit(0.0)) == 0
    rows = running(rows.withColumn("_open", opened.cast("int")), {
        "trip": ("sum", F.col("_open"))}, keys, width=width, tie=["order_id"])
    at = F.struct("ts_ns", "order_id")
    trips = rows.groupBy(*keys, "trip").agg(
        F.min("ts_ns").alias("entry_ts"), F.max("ts_ns").alias("exit_ts"),
        F.min_by("side", at).alias("side"), F.min_by("qty", at).alias("qty"),
        F.min_by("price", at).alias("entry_price"), F.max_by("price", at).alias("exit_price"),
        F.max_by("position", at).alias("_end"),
        F.sum(-signed_qty() * F.col("price")).alias("gross"),
        F.sum("fee").alias("fees"), F.sum("_slip").alias("slippage"))
    trips = trips.where(F.col("_end") == 0).drop("_end")
    if funding is None:
        trips = trips.withColumn("funding", F.lit(0.0))
    else:
        starts = trips.select(*keys, F.col("entry_ts").alias("ts_ns"), "trip", "exit_ts")
        owner = asof_join(funding, starts, keys, values=["trip", "exit_ts"], prefix="_", width=width,
                          strict=True)
        paid = owner.where(F.col("ts_ns") <= F.col("_exit_ts")).groupBy(
            *keys, F.col("_trip").alias("trip")).agg(F.sum("paid").alias("funding"))
        trips = trips.join(paid, [*keys, "trip"], "left").withColumn(
            "funding", F.coalesce("funding", F.lit(0.0)))
    cash = F.col("gross") - F.col("fees") - F.col("funding")
    return trips.withColumns({"net": cash - F.col("slippage"), "net_cash": cash,
                              "hold_ns": F.col("exit_ts") - F.col("entry_ts")})


def ledger(trips: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals and the number of rows breaking net = gross - fees - slippage - funding."""
    want = F.col("gross") - F.col("fees") - F.col("slippage") - F.col("funding")
    scale = F.greatest(F.lit(1.0), F.abs("gross"), F.abs("net"))
    off = F.abs(F.col("net") - want) > 1e-9 * scale
    totals = trips.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("gross", "fees", "slippage", "funding", "net")],
        F.count(F.when(off, 1)).alias("violations"))
    gap = F.abs(F.col("net") - (F.col("gross") - F.col("fees") - F.col("slippage")
                                - F.col("funding")))
    return totals.withColumn("total_ok", gap <= 1e-9 * F.greatest(F.lit(1.0), F.abs("gross")))


def funding_payments(fills: DataFrame, settlements: DataFrame, marks: DataFrame,
                     keys: Sequence[str] = ("run_id",), width: int = NS_DAY) -> DataFrame:
    """Rate times mark times signed position at each settlement; longs pay positive rates."""
    pos = positions(fills, keys, width).select(*keys, "ts_ns", "order_id", "position")
    a = asof_join(settlements, pos, keys, values=["position"], width=width, tie=["order_id"])
    b = asof_join(a, marks, keys, values=["price"], prefix="mark_", width=width)
    return b.withColumn("paid", F.col("rate") * F.col("mark_price") * F.col("position"))


# -- positions from bar rules -------------------------------------------------------------

# A rule maps each of the states -1, 0, 1 to a next state; states are stored as 0, 1, 2.


def state_machine(rows: DataFrame, step: Mapping[str, object], keys: Sequence[str],
                  out: str = "position", width: int = NS_DAY,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run a three-state rule over each series; ``step`` gives the next state by current one.

    ``step`` maps "short", "flat" and "long" to a column with the next position (-1, 0, 1).
    Rules compose, so every block is reduced to its overall rule, the short chain of blocks
    is walked per key, and all blocks replay their rows from the state they receive.
    """
    keys = list(keys)
    codes = [(F.coalesce(step[s], F.lit(0)) + 1).cast("byte") for s in ("short", "flat", "long")]
    coded = rows.withColumns({f"_s{i}": c for i, c in enumerate(codes)})
    indexed = with_row_index(coded, keys, width=width).withColumn(
        "_block", F.floor(F.col("_idx") / block_rows))
    cell = [*keys, "_block"]
    key_fields = [rows.schema[k] for k in keys]

    def composed(pdf: pd.DataFrame) -> np.ndarray:
        """Rule from the block's start to after each row, by repeated doubling."""
        f = pdf[["_s0", "_s1", "_s2"]].to_numpy(dtype=np.int8)
        reach = 1
        while reach < len(f):
            f[reach:] = np.take_along_axis(f[reach:], f[:-reach].astype(np.intp), axis=1)
            reach *= 2
        return f

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        last = composed(pdf.sort_values("_idx"))[-1]
        head = {k: [pdf[k].iloc[0]] for k in cell}
        return pd.DataFrame({**head, "_f0": [last[0]], "_f1": [last[1]], "_f2": [last[2]]})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, entry = pdf.sort_values("_block"), 1, []
        for f in pdf[["_f0", "_f1", "_f2"]].to_numpy():
            entry.append(state)
            state = int(f[state])
        return pdf.assign(_state=np.array(entry, dtype=np.int8))[[*cell, "_state"]]

    byte = T.ByteType()
    block = T.StructField("_block", T.LongType())
    rule_schema = T.StructType([*key_fields, block, *[T.StructField(f"_f{i}", byte)
                                                      for i in range(3)]])
    carry_schema = T.StructType([*key_fields, block, T.StructField("_state", byte)])
    narrow = indexed.select(*cell, "_idx", "_s0", "_s1", "_s2")
    carry = (narrow.groupBy(*cell).applyInPandas(whole, rule_schema)
             .groupBy(*keys).applyInPandas(chain, carry_schema))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_idx")
        state = composed(pdf)[:, int(pdf["_state"].iloc[0])]
        return pdf.assign(**{out: state.astype("int32") - 1})[names]

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType())])
    names = schema.names
    return indexed.join(carry, cell).groupBy(*cell).applyInPandas(replay, schema)


def band_positions(rows: DataFrame, value: str, enter: float | Column, leave: float,
                   keys: Sequence[str] = ("symbol",), width: int = NS_DAY,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean reversion: buy at or below -enter, sell at or above it, one position at a time.

    A long is closed once the value is back at -leave or above, a short at leave or below; a
    closing bar does not open the other side.
    """
    x = F.col(value)
    return state_machine(rows, {
        "long": F.when(x >= -leave, 0).otherwise(1),
        "short": F.when(x <= leave, 0).otherwise(-1),
        "flat": F.when(x <= -enter, 1).when(x >= enter, -1).otherwise(0),
    }, keys, width=width, block_rows=block_rows)


def flow_positions(rows: DataFrame, value: str, enter: float, keys: Sequence[str] = ("symbol",),
                   width: int = NS_DAY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Follow the flow beyond the threshold; close when its sign turns."""
    x = F.col(value)
    return state_machine(rows, {
        "long": F.when(x < 0, 0).otherwise(1), "short": F.when(x > 0, 0).otherwise(-1),
        "flat": F.when(x >= enter, 1).when(x <= -enter, -1).otherwise(0),
    }, keys, width=width, block_rows=block_rows)


def position_trades(rows: DataFrame, bars: DataFrame, slippage_bps: float, taker_bps: float,
                    keys: Sequence[str] = ("symbol",), width: int = NS_DAY) -> DataFrame:
    """Trade list of a position column: each change fills at the next bar's open.

    ``rows``: keys, ts_ns, position. One trade per stretch of equal non-zero position; a
    stretch whose exit has no next bar is left out. ``bars`` has the opens of all rows.
    """
    keys = list(keys)
    joined = rows.select(*keys, "ts_ns", "position").join(
        bars.select(*keys, "ts_ns", "open"), [*keys, "ts_ns"])
    blocks, w = in_blocks(joined, 1, 1, keys, width=width)
    nxt = blocks.withColumns({
        "_next_open": F.lead("open").over(w), "_next_ts": F.lead("ts_ns").over(w),
        "_was": F.coalesce(F.lag("position").over(w), F.lit(0))})
    turns = core_rows(nxt).where(F.col("position") != F.col("_was"))
    legs = turns.select(
        *keys, "ts_ns", F.col("_next_ts").alias("fill_ts"), F.col("_next_open").alias("price"),
        "position", F.col("_was").alias("closed"))
    # Every change either opens from flat or closes to flat, so closes pair with the open before.
    paired = running(legs, {
        "entry_ts": ("last", F.when(F.col("position") != 0, F.col("fill_ts"))),
        "entry_open": ("last", F.when(F.col("position") != 0, F.col("price")))}, keys, width=width)
    closed = paired.where((F.col("position") == 0) & F.col("fill_ts").isNotNull())
    return priced(closed.select(
        *keys, F.col("closed").alias("direction"), "entry_ts", "entry_open",
        F.col("fill_ts").alias("exit_ts"), F.col("price").alias("exit_open")),
        slippage_bps, taker_bps)


def priced(trades: DataFrame, slippage_bps: float, taker_bps: float) -> DataFrame:
    """Prices with slippage against the side, fees, and the trade's parts for one unit."""
    d = F.col("direction")
    entry = F.col("entry_open") * (F.lit(1.0) + d * slippage_bps / 1e4)
    leave = F.col("exit_open") * (F.lit(1.0) - d * slippage_bps / 1e4)
    out = trades.withColumns({"entry_price": entry, "exit_price": leave, "qty": F.lit(1.0)})
    out = out.withColumns({
        "gross": d * (F.col("exit_price") - F.col("entry_price")),
        "fees": (F.col("entry_price") + F.col("exit_price")) * taker_bps / 1e4,
        "slippage": (F.col("entry_open") + F.col("exit_open")) * slippage_bps / 1e4,
        "funding": F.lit(0.0), "hold_ns": F.col("exit_ts") - F.col("entry_ts")})
    return out.withColumn(
        "net", F.col("gross") - F.col("fees") - F.col("slippage") - F.col("funding"))


# -- folds, stress, sweeps ----------------------------------------------------------------

def assign_folds(bars: DataFrame, train: int, test: int, keys: Sequence[str] = ("symbol",),
                 width: int = NS_DAY) -> DataFrame:
    """Consecutive train + test stretches by bar number; an incomplete last one is dropped."""
    keys, size = list(keys), train + test
    idx = with_row_index(bars, keys, width=width)
    total = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    fold = F.call_function("div", F.col("_idx"), F.lit(size))
    return idx.join(total, keys).withColumn("fold", fold).where(
        (F.col("fold") + 1) * size <= F.col("_n")).withColumn(
        "role", F.when(F.col("_idx") % size < train, "train").otherwise("test")).drop("_idx", "_n")


def fold_bounds(folds: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return folds.groupBy(*keys, "fold", "role").agg(
        F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))


def band_cells(bars: DataFrame, windows: Sequence[int], entry_zs: Sequence[float], exit_z: float,
               slippage_bps: float, taker_bps: float, keys: Sequence[str] = ("symbol",),
               width: int = NS_DAY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean-reversion trade list of every (width, entry_z) cell over every series of ``keys``.

    All windows come from one block layout; all cells' state machines run as series of one other.
    The grid is a constant, so rows grow by its size.
    """
    from barlake.operators.features import zscore_in

    keys = list(keys)
    blocks, w = in_blocks(bars.select(*keys, "ts_ns", "open", "close"), before=max(windows) + 1, keys=keys,
                          width=width, block_rows=block_rows)
    for n in windows:
        blocks = zscore_in(blocks, w, n, "close", f"_z{n}")
    cells = F.array(*[F.struct(F.lit(n).alias("width"), F.lit(float(z)).alias("entry_z"), F.col(
        f"_z{n}").alias("z")) for n in windows for z in entry_zs])
    rows = settle(core_rows(blocks).select(*keys, "ts_ns", "open", F.inline(cells)), "cells")
    by = [*keys, "width", "entry_z"]
    held = settle(band_positions(rows, "z", F.col("entry_z"), exit_z, by, width, block_rows), "positions")
    return position_trades(held.select(*by, "ts_ns", "position"), rows, slippage_bps, taker_bps, by, width)


CELL_SUMS = ("n_trades", "net_total", "gross_total", "fees_total")


def scored_cells(trades: DataFrame, every: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trade counts, sums and expectancy of each row of ``every`` (columns ``by``); cells without
    trades stay, with zero sums and no expectancy."""
    found = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("net").alias("net_total"),
        F.sum("gross").alias("gross_total"), F.sum("fees").alias("fees_total"),
        (F.avg("net") / F.avg(F.col("entry_price") * F.col("qty")) * 1e4).alias("expectancy_bps"))
    return every.join(found, list(by), "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in CELL_SUMS})


def walk_forward(scored: DataFrame, cell: Sequence[str], keys: Sequence[str] = ("symbol",),
                 score: str = "expectancy_bps") -> DataFrame:
    """Per fold: the cell with the best train score (none comes last) and its test result.

    ``scored``: keys, fold, role, cell and sums of every cell, with or without trades.
    """
    keys, cell = list(keys), list(cell)
    order = W.partitionBy(*keys, "fold").orderBy(F.col(score).desc_nulls_last(), *cell)
    best = scored.where("role = 'train'").withColumn("_rn", F.row_number().over(order)).where(
        "_rn = 1").select(*keys, "fold", *cell, F.col(score).alias("train_score"))
    test = scored.where("role = 'test'").select(*keys, "fold", *cell, *CELL_SUMS, score)
    return best.join(test, [*keys, "fold", *cell])


def out_of_sample(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums over folds, net per trade, and the share of folds with a profit."""
    n = F.sum("n_trades")
    return folds.groupBy(*keys).agg(
        n.alias("n_trades"), F.sum("net_total").alias("net_total"),
        F.sum("gross_total").alias("gross_total"), F.sum("fees_total").alias("fees_total"),
        F.when(n > 0, F.sum("net_total") / n).otherwise(0.0).alias("expectancy_quote"),
        F.avg((F.col("net_total") > 0).cast("double")).alias("pct_positive_folds"))


# Scenario: fee factor, slippage factor, added latency in milliseconds (fixed values).
STRESS = {
    "fees_x1.5": (1.5, 1.0, 0),
    "slippage_x2": (1.0, 2.0, 0),
    "latency_plus_250ms": (1.0, 1.0, 250),
    "combined": (1.5, 2.0, 250),
}


def retimed(trades: DataFrame, tape: DataFrame, latency_ns: int, width: int = NS_DAY) -> DataFrame:
    """Trades whose legs fill on the tape: each at the first trade ``latency_ns`` after its time or later.
    Adds entry_fill, exit_fill; a trade with a leg the tape cannot fill is left out."""
    later = tape.select("symbol", (-F.col("ts_ns")).alias("_axis"), (-F.col("agg_id")).alias("_id"), "price")
    out = trades
    for leg in ("entry", "exit"):
        asks = out.withColumn("_want", -(F.col(f"{leg}_ts") + latency_ns))
        out = asof_join(asks, later, left_ts="_want", right_ts="_axis", values=["price"], prefix=f"_{leg}_",
                        width=width, tie=["_id"]).drop("_want").withColumnRenamed(
            f"_{leg}_price", f"{leg}_fill")
    return out.where("entry_fill IS NOT NULL AND exit_fill IS NOT NULL")


def stress_table(trades: DataFrame, tape: DataFrame, latency_ns: int, slippage_bps: float, taker_bps: float,
                 keys: Sequence[str] = ("symbol",), width: int = NS_DAY) -> DataFrame:
    """Expectancy of the same trades under degraded costs and later arrivals; survives if above zero.

    Legs are timed anew on the tape once for each added latency, then every scenario is priced.
    """
    base = settle(trades.select(*dict.fromkeys(["symbol", *keys]), "direction", "entry_ts", "exit_ts"), "trades")
    priced_cases = []
    for added in sorted({ms for *_, ms in STRESS.values()}):
        cases = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("_f"), F.lit(s).alias("_s"))
                          for n, (f, s, ms) in STRESS.items() if ms == added])
        legs = retimed(base, tape, latency_ns + added * 10 ** 6, width)
        priced_cases.append(legs.select(*keys, "direction", "entry_fill", "exit_fill", F.inline(cases)))
    rows = priced_cases[0]
    for more in priced_cases[1:]:
        rows = rows.unionByName(more)
    d, slip = F.col("direction"), F.col("_s") * slippage_bps / 1e4
    entry = F.col("entry_fill") * (F.lit(1.0) + d * slip)
    leave = F.col("exit_fill") * (F.lit(1.0) - d * slip)
    fees = (entry + leave) * F.col("_f") * taker_bps / 1e4
    cost = (F.col("entry_fill") + F.col("exit_fill")) * slip
    rows = rows.withColumns({"_net": d * (leave - entry) - fees - cost, "_entry": entry})
    out = rows.groupBy(*keys, "scenario").agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("_net").alias("net_total"),
        (F.avg("_net") / F.avg("_entry") * 1e4).alias("expectancy_bps"))
    return out.withColumn("survives", F.col("expectancy_bps") > 0)


def rank_cells(table: DataFrame, score: str, tie: Sequence[str], min_trades: int) -> DataFrame:
    """Cells by score, NULL last, with a flag for thin ones. One row per cell."""
    order = W.orderBy(F.col(score).desc_nulls_last(), *tie)
    return table.withColumns({"rank": F.row_number().over(order),
                              "few_trades": F.col("n_trades") < min_trades})
