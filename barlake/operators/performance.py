"""Return, drawdown and trade statistics.

Equity curves and fills may be arbitrarily long and use the two-level scans of ``series``.
Daily series are bounded by the calendar (one row per day and cell) and use plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.bars import daily_marks
from barlake.operators.features import realized_vol_in
from barlake.operators.lookups import alignment
from barlake.operators.quantiles import grouped_quantiles
from barlake.operators.series import BLOCK_ROWS, core_rows, in_blocks, running
from barlake.schemas import NS_DAY
from barlake.session import settle

YEAR_NS = 365 * NS_DAY


def _upto(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy("ts_ns").rowsBetween(W.unboundedPreceding, 0)


def drawdowns(curve: DataFrame, value: str = "equity", keys: Sequence[str] = ("run_id",),
              width: int = NS_DAY) -> DataFrame:
    """Running peak, relative drawdown and absolute drawdown of each row."""
    out = running(curve, {"peak": ("max", F.col(value))}, keys, width=width)
    fall = F.col("peak") - F.col(value)
    return out.withColumn("drawdown_abs", fall).withColumn(
        "drawdown", F.when(F.col("peak") > 0, fall / F.col("peak")))


def log_growth(value: str) -> Column:
    """log(1 + r); a return of -1 or less is an error."""
    bad = F.raise_error(F.lit("return at or below -1")).cast("double")
    return F.when(F.col(value) > -1, F.log1p(value)).when(F.col(value).isNotNull(), bad)


def compounded(returns: DataFrame, value: str, keys: Sequence[str], out: str = "growth",
               width: int = NS_DAY) -> DataFrame:
    """Running product of 1 + r; a return of -1 or less is an error."""
    return running(returns, {out: ("sum", log_growth(value))}, keys, width=width).withColumn(
        out, F.exp(F.col(out)))


def accrued_debt(marks: DataFrame, apr: float, debt0: float, keys: Sequence[str] = ("symbol",),
                 width: int = NS_DAY) -> DataFrame:
    """Debt after borrow interest accrued from mark to mark."""
    with_prev = running(marks, {"_prev": ("prev", F.col("ts_ns"))}, keys, width=width)
    part = F.coalesce((F.col("ts_ns") - F.col("_prev")) / F.lit(float(YEAR_NS)) * apr, F.lit(0.0))
    grown = compounded(with_prev.withColumn("_r", part), "_r", keys, "_g", width)
    return grown.withColumn("debt", F.lit(debt0) * F.col("_g")).drop("_prev", "_r", "_g")


def newey_west(df: DataFrame, value: str, keys: Sequence[str], lag: int | Column, out: str,
               ts: str = "ts_ns") -> DataFrame:
    """t-statistic of the mean with Bartlett weights; NULL if short or variance <= 0.

    For daily series: a group, one value per day of the calendar, becomes one array. ``lag``
    may differ by group and is not bounded.
    """
    lag = F.lit(lag) if isinstance(lag, int) else lag
    series = df.groupBy(*keys).agg(
        F.max(lag).alias("_lag"), F.avg(value).alias("_mean"), F.count(value).alias("_n"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(ts), F.col(value).alias("x")))),
                    lambda s: s["x"]).alias("_x"))
    series = series.withColumn("_d", F.transform("_x", lambda x: F.coalesce(
        x - F.col("_mean"), F.lit(0.0))))

    def products(k: Column) -> Column:
        """Sum of the deviations times those ``k`` rows earlier."""
        return F.aggregate(F.sequence(F.lit(0), F.size("_d") - 1), F.lit(0.0), lambda acc, i: acc
                           + F.coalesce(F.get("_d", i) * F.get("_d", i - k), F.lit(0.0)))

    last = F.least(F.col("_lag"), F.size("_d") - 1)
    lags = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(lags, F.lit(0.0), lambda acc, k: acc + (
        F.lit(1.0) - k / (F.col("_lag") + 1.0)) * products(k))
    var = (products(F.lit(0)) + F.lit(2.0) * tail) / F.col("_n")
    series = series.withColumn("_var", var)
    ok = (F.col("_n") >= F.col("_lag") + 2) & (F.col("_var") > 0)
    return series.select(*keys, F.when(ok, F.col("_mean") / F.sqrt(
        F.col("_var") / F.col("_n"))).alias(out))


def daily_summary(daily: DataFrame, keys: Sequence[str], hac_lag: int = 20) -> DataFrame:
    """Statistics of daily net returns with exposure, turnover, gross, fee and funding parts."""
    keys = list(keys)
    growth = F.exp(F.sum(log_growth("net")).over(_upto(keys)))
    path = daily.withColumn("_g", growth)
    peak = F.greatest(F.lit(1.0), F.max("_g").over(_upto(keys)))
    path = path.withColumn("_dd", F.lit(1.0) - F.col("_g") / peak)
    n, sd = F.count("net"), F.coalesce(F.stddev_samp("net"), F.lit(0.0))
    total = F.exp(F.sum(log_growth("net")))
    year = F.sqrt(F.lit(365.0))
    stats = path.groupBy(*keys).agg(
        n.alias("n_days"), (total - 1.0).alias("total_return"),
        (F.pow(total, F.lit(365.0) / n) - 1.0).alias("cagr"),
        (sd * year).alias("volatility"),
        F.when(sd > 0, F.avg("net") / sd * year).alias("sharpe"),
        F.greatest(F.lit(0.0), F.max("_dd")).alias("max_drawdown"),
        F.avg("exposure").alias("average_exposure"),
        F.avg((F.col("exposure") > 0).cast("double")).alias("fraction_exposed"),
        F.sum("turnover").alias("turnover_units"),
        (F.sum("turnover") / (n / 365.0)).alias("annual_turnover_units"),
        (F.sum("gross") * 1e4).alias("gross_bps"), (F.sum("fee") * 1e4).alias("fees_bps"),
        (F.sum("funding") * 1e4).alias("funding_bps"))
    return stats.join(newey_west(daily, "net", keys, hac_lag, "t_stat_nw"), keys)


DAILY_PARTS = ("net", "exposure", "turnover", "gross", "fee", "funding")


def consecutive_days(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, refused if a day is missing or comes twice. The test is part of a filter, so
    it stands whichever columns are read."""
    step = F.lead("ts_ns").over(W.partitionBy(*keys).orderBy("ts_ns")) - F.col("ts_ns")
    bad = F.raise_error(F.lit("days must follow each other without gaps")).cast("boolean")
    return rows.withColumn("_step", step).where(
        F.when(F.col("_step").isNull() | (F.col("_step") == NS_DAY), True).otherwise(bad)
    ).drop("_step")


def equal_weight(daily: DataFrame, keys: Sequence[str], member: str = "symbol") -> DataFrame:
    """Mean of every component over the members, per day; days lacking a member are refused."""
    members = daily.groupBy(*keys).agg(F.countDistinct(member).alias("_all"))
    mean = daily.groupBy(*keys, "ts_ns").agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in DAILY_PARTS])
    bad = F.raise_error(F.lit("members have different days")).cast("boolean")
    return mean.join(members, list(keys)).where(
        F.when(F.col("_n") == F.col("_all"), True).otherwise(bad)).drop("_n", "_all")


def curve_summary(marks: DataFrame, keys: Sequence[str], hac_lag: int = 20) -> DataFrame:
    """Statistics of midnight equity marks; a missing day is refused. A growth rate needs a positive
    start and an end that is not negative; otherwise, and without a return, it is NULL."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("ts_ns")
    days = consecutive_days(daily_marks(marks, keys), keys).withColumn("_p", F.lag("equity").over(w)).withColumn(
        "net", F.col("equity") / F.nullif("_p", F.lit(0.0)) - 1.0)
    peak = F.max("equity").over(_upto(keys))
    days = days.withColumn("_dd", F.when(peak > 0, F.lit(1.0) - F.col("equity") / peak))
    n, sd, year = F.count("net"), F.stddev_samp("net"), F.sqrt(F.lit(365.0))
    first, last = F.min_by("equity", "ts_ns"), F.max_by("equity", "ts_ns")
    stats = days.groupBy(*keys).agg(
        n.alias("n_days"), (last / F.nullif(first, F.lit(0.0)) - 1.0).alias("total_return"),
        F.when((first > 0) & (last >= 0) & (n > 0),
               F.pow(last / first, F.lit(365.0) / n) - 1.0).alias("cagr"),
        (sd * year).alias("volatility"),
        F.when(sd > 0, F.avg("net") / sd * year).alias("sharpe"),
        F.max("_dd").alias("max_drawdown"), first.alias("start_equity"), last.alias("end_equity"))
    t = newey_west(days.where(F.col("net").isNotNull()), "net", keys, hac_lag, "t_stat_nw")
    return stats.join(t, keys, "left")


def combine_legs(spot: DataFrame, perp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of two equity curves on equal times; ``alignment`` tells what falls out."""
    on = [*keys, "ts_ns"]
    a = spot.select(*on, F.col("equity").alias("_a"))
    b = perp.select(*on, F.col("equity").alias("_b"))
    return a.join(b, on).select(*on, (F.col("_a") + F.col("_b")).alias("equity"))


legs_alignment = alignment


def equity_metrics(equity: DataFrame, interval_ns: int, keys: Sequence[str] = ("run_id",),
                   width: int = NS_DAY, tie: Sequence[str] = ()) -> DataFrame:
    """Return, drawdown, calmar, sharpe and sortino per run. Returns are taken from positive values
    and falls from positive peaks only; the total is NULL where the first value is not positive."""
    e = F.col("equity")
    rows = running(equity, {"_prev": ("prev", e), "_peak": ("max", e)}, keys, width=width, tie=tie)
    r = F.when(F.col("_prev") > 0, e / F.col("_prev") - 1.0)
    rows = rows.withColumn("_r", r).withColumn(
        "_dd", F.when(F.col("_peak") > 0, (F.col("_peak") - e) / F.col("_peak")))
    annual = (YEAR_NS / interval_ns) ** 0.5
    down = F.sqrt(F.sum(F.when(F.col("_r") < 0, F.col("_r") * F.col("_r"))) / F.count("_r"))
    order = F.col("ts_ns") if not tie else F.struct("ts_ns", *tie)
    first = F.min_by("equity", order)
    total = F.when(first > 0, F.max_by("equity", order) / first - 1.0)
    dd = F.greatest(F.lit(0.0), F.max("_dd"))
    sd = F.stddev_pop("_r")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"), total.alias("total_return"),
        dd.alias("max_drawdown"), F.when(dd > 0, total / dd).alias("calmar"),
        F.when(sd > 0, F.avg("_r") / sd * annual).alias("sharpe"),
        F.when(down > 0, F.avg("_r") / down * annual).alias("sortino"))


def trade_metrics(trips: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Win, payoff, expectancy, cost and t statistics of round trips per run."""
    net = F.col("net")
    win, loss = F.avg(F.when(net > 0, net)), F.abs(F.avg(F.when(net < 0, net)))
    gained, lost = F.sum(F.when(net > 0, net)), F.abs(F.sum(F.when(net < 0, net)))
    n = F.count(F.lit(1))
    notional = F.avg(F.col("entry_price") * F.col("qty"))
    sd, gross = F.stddev_samp("net"), F.sum("gross")
    return trips.groupBy(*keys).agg(
        n.alias("n_trades"), F.avg((net > 0).cast("double")).alias("win_rate"),
        win.alias("avg_win"), loss.alias("avg_loss"),
        F.when(loss > 0, win / loss).alias("payoff"),
        F.when(lost > 0, F.coalesce(gained, F.lit(0.0)) / lost).alias("profit_factor"),
        F.when(notional > 0, F.avg("net") / notional * 1e4).alias("expectancy_bps"),
        F.avg("hold_ns").alias("avg_hold_ns"), gross.alias("gross_total"),
        F.sum("fees").alias("fees_total"), F.sum("slippage").alias("slippage_total"),
        F.sum("funding").alias("funding_total"), F.sum("net").alias("net_total"),
        F.when(gross > 0, F.sum("fees") / gross).alias("fee_drag"),
        F.when((n >= 2) & (sd > 0), F.avg("net") / (sd / F.sqrt(n))).alias("t_stat"))


def run_metrics(equity: DataFrame, trips: DataFrame, interval_ns: int,
                keys: Sequence[str] = ("run_id",), width: int = NS_DAY) -> DataFrame:
    """All statistics of a run; the trade part is NULL and the count 0 without trades. A total that
    is not defined is 0 without trades."""
    both = equity_metrics(equity, interval_ns, keys, width).join(
        trade_metrics(trips, keys), list(keys), "left")
    total = F.when(F.col("n_trades").isNull(), F.coalesce("total_return", F.lit(0.0))).otherwise(
        F.col("total_return"))
    return both.withColumns({"total_return": total, "n_trades": F.coalesce("n_trades", F.lit(0))})


def regime_metrics(curve: DataFrame, window: int, interval_ns: int,
                   keys: Sequence[str] = ("run_id",), block_rows: int = BLOCK_ROWS,
                   width: int = NS_DAY, tie: Sequence[str] = ()) -> DataFrame:
    """Statistics by volatility tercile of (keys, ts_ns, equity, close); rows of one time come in ``tie``
    order. Volatilities are taken to 12 decimals, so that windows of equal returns in another order do
    not fall on two sides of a cut; a run with ``window`` of them or fewer is ``low`` throughout."""
    keys = list(keys)
    blocks, w = in_blocks(curve, before=window, keys=keys, width=width, tie=tie, block_rows=block_rows)
    vols = core_rows(realized_vol_in(blocks, w, window)).where(F.col("vol").isNotNull())
    vols = settle(vols.select(*keys, "ts_ns", *tie, "equity", F.round("vol", 12).alias("vol")), "vols")
    cuts = grouped_quantiles(vols, keys, "vol", {"_q33": 0.333, "_q66": 0.667})
    v = F.col("vol")
    label = F.when((F.col("n") <= window) | (v <= F.col("_q33")), "low").when(
        v > F.col("_q66"), "high").otherwise("mid")
    labelled = settle(vols.join(cuts, keys).select(
        *keys, "ts_ns", *tie, "equity", "vol", label.alias("label")), "labels")
    by = [*keys, "label"]
    stats = equity_metrics(labelled, interval_ns, by, width, tie).drop("calmar", "sortino")
    return stats.join(labelled.groupBy(*by).agg(F.avg("vol").alias("vol_mean")), by)


def histogram(trips: DataFrame, keys: Sequence[str], value: str = "net",
              bins: int = 20) -> DataFrame:
    """Counts in equal bins between minimum and maximum; the last bin is closed."""
    edges = trips.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    edges = edges.withColumn("_hi", F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") + 1.0)
                             .otherwise(F.col("_hi")))
    b = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    return trips.join(edges, list(keys)).groupBy(
        *keys, F.least(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def compare_runs(metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per metric and run; ``pivot`` on the run shows them side by side."""
    names = [c for c in metrics.columns if c != key]
    wide = metrics.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    return wide.unpivot([key], names, "metric", "value")


def monthly_sums(points: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    from barlake.functions.scalars import ts_date

    month = F.date_format(ts_date("ts_ns"), "yyyy-MM")
    return points.groupBy(*keys, month.alias("month")).agg(F.sum(value).alias(out))


def leg_stats(orders: DataFrame, fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Orders, rejects, fills and traded sums per leg."""
    o = orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count(F.when(F.col("reject_reason").isNotNull(), 1)).alias("n_rejected"))
    f = fills.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fills"), F.sum("qty").alias("fill_qty"),
        F.sum("fee").alias("fees"), F.sum("slippage_cost").alias("slippage"))
    both = o.join(f, list(keys), "left")
    return both.select(*keys, "n_orders", "n_rejected", *[
        F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_fills", "fill_qty", "fees",
                                                          "slippage")])


def coverage(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smaller over larger filled quantity among the legs."""
    return stats.groupBy(*keys).agg(
        (F.min("fill_qty") / F.nullif(F.max("fill_qty"), F.lit(0.0))).alias("coverage"))


def margin_ratio(marks: DataFrame, qty: float, mmr: float, window: tuple[int, int],
                 keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Lowest equity / maintenance margin over daily marks, its day, drawdown in a window,
    and borrow interest as the change of implied debt of the spot leg.

    ``marks``: keys, ts_ns, equity, mark and spot_equity per day.
    """
    keys = list(keys)
    ratio = F.col("equity") / (F.lit(mmr) * qty * F.col("mark"))
    inside = F.col("ts_ns").between(*window)
    peak = F.max(F.when(inside, F.col("equity"))).over(_upto(keys))
    rows = marks.withColumn("_ratio", ratio).withColumn(
        "_dd", F.when(inside, F.lit(1.0) - F.col("equity") / peak))
    debt = F.lit(qty) * F.col("mark") - F.col("spot_equity")
    return rows.withColumn("_debt", debt).groupBy(*keys).agg(
        F.min("_ratio").alias("min_ratio"), F.min_by("ts_ns", F.struct("_ratio", "ts_ns"))
        .alias("min_ratio_ts"), F.max("_dd").alias("window_drawdown"),
        (F.max_by("_debt", "ts_ns") - F.min_by("_debt", "ts_ns")).alias("borrow_interest"))
