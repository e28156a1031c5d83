"""Prices a table of independent orders would have got on a trade tape or on bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions.scalars import exact_units, hashed_draw, slipped
from barlake.operators.asof import asof_join
from barlake.operators.series import running
from barlake.operators.touch import first_touch
from barlake.schemas import NS_DAY, NS_HOUR
from barlake.session import settle


UNIT, PLACES = 1e-9, 9  # step of quantities and notionals in running sums
SMALL = 1e-12  # the same for positions and cash, whose every term is rounded to it


def arrival(orders: DataFrame, latency_ns: int, jitter_ns: int = 0, seed: int = 0) -> DataFrame:
    """Arrival time: submission plus latency, plus a jitter drawn from the order's id."""
    at = F.col("submitted_ns") + latency_ns
    if jitter_ns:
        at = at + hashed_draw(F.lit(jitter_ns), str(seed), F.col("order_id"))
    return orders.withColumn("arrive_ns", at)


def slippage_cost(reference: str | Column, fill: str | Column) -> Column:
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    ref = F.col(reference) if isinstance(reference, str) else reference
    price = F.col(fill) if isinstance(fill, str) else fill
    return F.coalesce((price - ref) * F.col("qty") * sign, F.lit(0.0))


def would_cross(orders: DataFrame, tape: DataFrame, width: int = NS_DAY) -> DataFrame:
    """Whether a limit order meets the last traded price when it arrives."""
    seen = asof_join(orders, tape.select("symbol", "ts_ns", "price", "agg_id"),
                     left_ts="arrive_ns", values=["price"], prefix="last_", width=width,
                     tie=["agg_id"])
    buy, p, limit = F.col("side") == "buy", F.col("last_price"), F.col("limit_price")
    return seen.withColumn("crosses", F.coalesce(
        F.when(buy, p <= limit).otherwise(p >= limit), F.lit(False)))


def market_fills(orders: DataFrame, tape: DataFrame, width: int = NS_DAY,
                 qty_width: float = 10_000.0) -> DataFrame:
    """Volume-weighted fill of each order from the aggressor side's trades.

    Along one symbol and side, trades are intervals on the axis of cumulative quantity. An
    order takes the stretch [q0, q0 + qty] after its arrival, so its cost is a difference of
    cumulative notionals; both ends are as-of lookups. Orders the tape cannot fill get NULLs.
    """
    side = F.when(F.col("buyer_is_maker"), "sell").otherwise("buy")
    keys = ["symbol", "side"]
    # Whole numbers of a small step, from decimal texts: terms, sums and differences are exact.
    notional = F.col("price").cast("decimal(19,9)") * F.col("qty").cast("decimal(24,9)")
    flow = tape.select("symbol", side.alias("side"), "ts_ns", "agg_id", "price", "qty")
    flow = running(flow, {
        "_q": ("sum", exact_units("qty", places=PLACES)),
        "_cost": ("sum", exact_units(notional, places=PLACES))}, keys, width=width, tie=["agg_id"])
    flow = flow.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("_q", "_cost")})
    flow = settle(flow.select(*keys, "ts_ns", "agg_id", "price", "_q", "_cost"), "prefix")
    before = flow.select(*keys, "ts_ns", "agg_id", "_q", "_cost")
    start = asof_join(orders, before, keys, left_ts="arrive_ns", values=["_q", "_cost"], prefix="a",
                      width=width, tie=["agg_id"], strict=True)
    zero = F.lit(0).cast("decimal(38,0)")
    start = start.withColumns({"a_q": F.coalesce("a_q", zero), "a_cost": F.coalesce("a_cost", zero)})
    # First trade whose cumulative quantity reaches the target: an as-of on the mirrored axis.
    start = start.withColumn("_want", (-(F.col("a_q") + exact_units("qty", places=PLACES))
                                       ).cast("decimal(38,0)"))
    mirrored = flow.select(*keys, (-F.col("_q")).cast("decimal(38,0)").alias("_axis"), "ts_ns", "price", "_q", "_cost")
    done = asof_join(start, mirrored, keys, left_ts="_want", right_ts="_axis",
                     values=["ts_ns", "price", "_q", "_cost"], prefix="z", width=qty_width / UNIT)
    surplus = (F.col("z_q") + F.col("_want")).cast("double") * UNIT
    notional = ((F.col("z_cost") - F.col("a_cost")).cast("double") * UNIT
                - surplus * F.col("zprice"))
    return done.select(*orders.columns, F.col("zts_ns").alias("fill_ts"),
                       (notional / F.col("qty")).alias("fill_price"))


def limit_fills(orders: DataFrame, tape: DataFrame, pessimistic: bool = True,
                width: int = NS_HOUR) -> DataFrame:
    """Limit orders: first trade through (optimistic: at or through) the limit, at the limit."""
    hit = first_touch(orders, tape, "limit_price", F.col("side") == "buy", pessimistic,
                      tie=["agg_id"], width=width)
    got = F.col("hit_ts_ns").isNotNull()
    return hit.withColumns({"fill_ts": F.col("hit_ts_ns"),
                            "fill_price": F.when(got, F.col("limit_price"))}).drop(
        "hit_ts_ns", "hit_price")


def stop_fills(orders: DataFrame, tape: DataFrame, width: int = NS_HOUR) -> DataFrame:
    """Stop orders: first trade at or across the stop, at that trade's price."""
    hit = first_touch(orders, tape, "stop_price", F.col("side") == "sell", False,
                      tie=["agg_id"], width=width)
    return hit.withColumnRenamed("hit_ts_ns", "fill_ts").withColumnRenamed("hit_price", "fill_price")


def bar_market_fills(orders: DataFrame, bars: DataFrame, interval_ns: int, slippage_bps: float,
                     width: int = NS_DAY) -> DataFrame:
    """Market orders on bars: the first bar closing at or after arrival, at its open."""
    closes = bars.select("symbol", (-(F.col("ts_ns") + interval_ns)).alias("_axis"), "open",
                         (F.col("ts_ns") + interval_ns).alias("_close"))
    o = orders.withColumn("_want", -F.col("arrive_ns"))
    got = asof_join(o, closes, left_ts="_want", right_ts="_axis", values=["open", "_close"],
                    prefix="b", width=width)
    return got.select(*orders.columns, F.col("b_close").alias("fill_ts"),
                      slipped("bopen", "side", slippage_bps).alias("fill_price"))


def bar_limit_fills(orders: DataFrame, bars: DataFrame, interval_ns: int,
                    pessimistic: bool = True, width: int = 64 * NS_HOUR) -> DataFrame:
    """Limit orders on bars closing at or after arrival: low (high) beyond the limit."""
    closing = bars.withColumn("ts_ns", F.col("ts_ns") + interval_ns)
    hit = first_touch(orders, closing, "limit_price", F.col("side") == "buy", pessimistic,
                      "low", "high", values=[], width=width)
    return hit.withColumn("fill_price", F.when(F.col("hit_ts_ns").isNotNull(), F.col(
        "limit_price"))).withColumnRenamed("hit_ts_ns", "fill_ts")


def bar_stop_fills(orders: DataFrame, bars: DataFrame, interval_ns: int, slippage_bps: float,
                   width: int = 64 * NS_HOUR) -> DataFrame:
    """Stop orders on bars: at the stop, or at the open where the bar opens beyond it."""
    closing = bars.withColumn("ts_ns", F.col("ts_ns") + interval_ns)
    hit = first_touch(orders, closing, "stop_price", F.col("side") == "sell", False,
                      "low", "high", values=["open"], width=width)
    worse = F.when(F.col("side") == "buy", F.greatest("hit_open", "stop_price")).otherwise(
        F.least("hit_open", "stop_price"))
    raw = F.when(F.col("hit_ts_ns").isNotNull(), worse)
    return hit.withColumn("fill_price", slipped(raw, "side", slippage_bps)).withColumnRenamed(
        "hit_ts_ns", "fill_ts").drop("hit_open")


def equity_marks(fills: DataFrame, marks: DataFrame, cash0: float,
                 keys: Sequence[str] = ("run_id",), width: int = NS_DAY) -> DataFrame:
    """Cash plus position times close at each mark; fees are paid from cash. Quantities and cash are
    summed in whole units."""
    qty = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    state = running(fills, {
        "_pos": ("sum", exact_units(qty)),
        "_paid": ("sum", exact_units(qty * F.col("price") + F.col("fee")))},
        keys, width=width, tie=["order_id"])
    held = asof_join(marks, state.select(*keys, "ts_ns", "order_id", "_pos", "_paid"), keys,
                     values=["_pos", "_paid"], width=width, tie=["order_id"])
    pos, paid = (F.coalesce(F.col(c).cast("double") * SMALL, F.lit(0.0)) for c in ("_pos", "_paid"))
    return held.withColumn("equity", F.lit(cash0) - paid + pos * F.col("close")).drop("_pos", "_paid")


# Order of what happens at one time: settlements, interest, fills, then the mark is taken.
SETTLED, ACCRUED, FILLED, MARKED = range(4)
MAX_ROUNDS = 50


def equity_account(fills: DataFrame, marks: DataFrame, cash0: float, settlements: DataFrame | None = None,
                   apr: float = 0.0, keys: Sequence[str] = ("run_id",), width: int = NS_DAY,
                   step: str | None = None) -> DataFrame:
    """Account state at each mark: position, cash (negative: borrowed), debt, funding paid so far,
    interest charged so far, and equity.

    ``fills``: keys, ts_ns, order_id, side, price, qty, fee (and the instrument's ``step``); ``marks``:
    keys, ts_ns, close, distinct times; ``settlements``: keys, ts_ns, rate, mark. Buys beyond the
    cash are borrowed and sales repay first, so what is owed is the negative part of one balance.
    Interest is simple on what is owed at a mark for the time since the mark before, and is added to it.

    All events form one series. A settlement's payment hangs on the position before it, an exact running
    sum. Interest makes the balance an affine map of itself from mark to mark, a factor where it is
    negative, and affine maps compose: with A the running product of factors, the balance is
    A (cash0 + sum of cash / A). Which marks find it negative is found from the balance without
    interest, which is the highest: each round charges the marks found so far and may find more,
    never fewer, until none is added.
    """
    keys = list(keys)
    nothing = F.lit(None).cast("double")
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    one = F.col(step).cast("double") if step else F.lit(SMALL)
    events = fills.select(
        *keys, "ts_ns", F.lit(FILLED).alias("_kind"), F.col("order_id").cast("bigint").alias("_order"),
        exact_units(sign * F.col("qty"), step and F.col(step)).alias("_units"), one.alias("_one"),
        (-sign * F.col("qty") * F.col("price") - F.col("fee")).alias("_cash"), nothing.alias("_rate"),
        nothing.alias("_price"), nothing.alias("_years"))

    def other(rows: DataFrame, kind: int, **given: Column) -> DataFrame:
        empty = {"_order": F.lit(0).cast("bigint"), "_units": F.lit(0).cast("decimal(28,0)"),
                 "_cash": F.lit(0.0), **{c: nothing for c in ("_one", "_rate", "_price", "_years")}} | given
        return rows.select(*keys, "ts_ns", F.lit(kind).alias("_kind"), *[c.alias(n) for n, c in empty.items()])

    timed = running(marks, {"_before": ("prev", F.col("ts_ns"))}, keys, width=width)
    years = (F.col("ts_ns") - F.col("_before")) / F.lit(365.0 * NS_DAY)
    events = events.unionByName(other(marks, MARKED, _price=F.col("close")))
    events = events.unionByName(other(timed, ACCRUED, _years=F.coalesce(years, F.lit(0.0))))
    if settlements is not None:
        events = events.unionByName(other(settlements, SETTLED, _rate=F.col("rate"), _price=F.col("mark")))
    order = ["_kind", "_order"]
    held = running(events, {"_held": ("sum", F.col("_units")), "_step": ("last", F.col("_one"))}, keys,
                   width=width, tie=order)
    position = F.coalesce(F.col("_held").cast("double") * F.col("_step"), F.lit(0.0))
    owed = F.when(F.col("_kind") == SETTLED, F.coalesce(F.col("_rate") * F.col("_price") * position, F.lit(0.0)))
    now = held.withColumns({"position": position, "_fund": F.coalesce(owed, F.lit(0.0))})
    now = settle(now.withColumn("_cash", F.col("_cash") - F.col("_fund")).select(
        *keys, "ts_ns", *order, "_price", "_years", "position", "_cash", "_fund"), "events")
    plain = running(now, {"_sum": ("sum", exact_units("_cash")),
                          "funding": ("sum", F.col("_fund"))}, keys, width=width, tie=order)
    plain = settle(plain.withColumn("_free", F.lit(cash0) + F.col("_sum").cast("double") * SMALL).drop(
        "_sum", "_fund"), "balance")
    state = plain.withColumn("cash", F.col("_free"))
    charged = -1
    for _ in range(MAX_ROUNDS if apr else 0):
        # A mark's interest row changes no cash, so it shows the balance that it is charged on.
        due = state.withColumn("_due", (F.col("_kind") == ACCRUED) & (F.col("cash") < 0) & (F.col("_years") > 0))
        found = due.agg(F.count(F.when(F.col("_due"), 1))).first()[0]
        if found == charged:
            break
        charged = found
        factor = F.when(F.col("_due"), F.log1p(F.col("_years") * apr)).otherwise(0.0)
        grown = running(due.drop("cash"), {"_log": ("sum", factor)}, keys, width=width, tie=order)
        grown = running(grown, {"_real": ("sum", F.col("_cash") * F.exp(-F.col("_log")))}, keys, width=width,
                        tie=order)
        balance = F.exp("_log") * (F.lit(cash0) + F.col("_real"))
        before = F.when(F.col("_due"), balance / (1 + F.col("_years") * apr)).otherwise(balance)
        # The row's own interest is left out again for the test of the next round.
        state = settle(grown.withColumn("cash", before).drop("_log", "_real", "_due"), "account")
    else:
        if apr:
            raise RuntimeError(f"interest not settled after {MAX_ROUNDS} rounds")
    out = state.where(F.col("_kind") == MARKED)
    return out.select(
        *keys, "ts_ns", F.col("_price").alias("close"), "position", "cash",
        F.greatest(F.lit(0.0), -F.col("cash")).alias("debt"), "funding",
        (F.col("_free") - F.col("cash")).alias("interest"),
        (F.col("cash") + F.col("position") * F.col("_price")).alias("equity"))
