"""Queries over fills, trips, runs, verdicts and trade lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators import exits, features, performance, resampling, signals, trades, verdicts
from barlake.plans import market_queries as mq
from barlake.plans import views as v
from barlake.plans.registry import query
from barlake.plans.study_queries import draw_sql
from barlake.plans.views import D, H
from barlake.session import settle

TRIPS = """SELECT run_id, k AS trip, min(ts_ns) AS entry_ts, max(ts_ns) AS exit_ts,
    arg_min(side, ts_ns) AS side, arg_min(qty, ts_ns) AS qty, arg_min(price, ts_ns) AS entry_price,
    arg_max(price, ts_ns) AS exit_price, sum(CASE WHEN side = 'buy' THEN -qty ELSE qty END * price)
    AS gross, sum(fee) AS fees, 0.0::DOUBLE AS slippage, 0.0::DOUBLE AS funding,
    sum(CASE WHEN side = 'buy' THEN -qty ELSE qty END * price) - sum(fee) AS net,
    max(ts_ns) - min(ts_ns) AS hold_ns FROM (SELECT *, (row_number() OVER (PARTITION BY run_id
    ORDER BY ts_ns) + 2) // 3 AS k FROM fills) GROUP BY 1, 2 HAVING count(*) = 3"""
EQUITY = """SELECT run_id, ts_ns, price AS close, 10000 - sum(CASE WHEN side = 'buy' THEN qty ELSE -qty
    END * price + fee) OVER w + sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER w * price
    AS equity FROM fills WINDOW w AS (PARTITION BY run_id ORDER BY ts_ns)"""
TRIP_COLS = "qty entry_price exit_price gross fees slippage funding net"


def fills(spark, sf, tie=("agg_id",)):
    """Fills; ticks of one time are taken by their id, the order in which positions are summed."""
    return settle(v.fills(spark, sf, tie), "fills")


def trips(spark, sf):
    return settle(trades.round_trips(fills(spark, sf), width=8 * D), "trips")


def equity(spark, sf):
    """Account value after each fill, marked at the fill's price."""
    return marked(fills(spark, sf))


def marked(f, *ids):
    from barlake.operators.tca import equity_marks

    marks = f.select("run_id", "ts_ns", *ids, F.col("price").alias("close"))
    return settle(equity_marks(f, marks, 10000.0, width=8 * D), "equity")


@query("a21_w20_round_trips", "SELECT * FROM trips", "run_id entry_ts exit_ts side hold_ns",
       TRIP_COLS, trips=TRIPS)
def _(spark, sf):
    return trips(spark, sf)


@query("a22_ledger", """SELECT run_id, sum(gross) AS gross, sum(fees) AS fees, sum(slippage)
    AS slippage, sum(funding) AS funding, sum(net) AS net, 0::BIGINT AS violations, true AS total_ok
    FROM trips GROUP BY 1""", "run_id violations total_ok", "gross fees slippage funding net",
       trips=TRIPS)
def _(spark, sf):
    return trades.ledger(trips(spark, sf))


@query("x10_equity_marks", "SELECT run_id, ts_ns, close, equity FROM equity", "run_id ts_ns",
       "close equity", equity=EQUITY)
def _(spark, sf):
    return equity(spark, sf)


@query("w14_drawdowns", """SELECT run_id, ts_ns, peak, peak - equity AS drawdown_abs,
    (peak - equity) / peak AS drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY run_id
    ORDER BY ts_ns) AS peak FROM equity)""", "run_id ts_ns", "peak drawdown_abs drawdown",
       equity=EQUITY)
def _(spark, sf):
    return performance.drawdowns(equity(spark, sf), width=8 * D)


# Returns are taken from positive values and falls from positive peaks only.
EQ_METRICS = """SELECT {k}, n_bars, total_return, max_drawdown, CASE WHEN max_drawdown > 0
    THEN total_return / max_drawdown END AS calmar, CASE WHEN sd > 0 THEN m / sd * {a} END AS sharpe,
    CASE WHEN down > 0 THEN m / down * {a} END AS sortino FROM (SELECT {k}, count(*) AS n_bars,
    CASE WHEN arg_min(equity, ts_ns) > 0 THEN arg_max(equity, ts_ns) / arg_min(equity, ts_ns) - 1 END
    AS total_return, greatest(0, max((peak - equity) / peak) FILTER (peak > 0)) AS max_drawdown,
    avg(r) AS m, stddev_pop(r) AS sd, sqrt(sum(r * r) FILTER (r < 0) / count(r)) AS down
    FROM (SELECT *, max(equity) OVER w AS peak, CASE WHEN lag(equity) OVER w > 0
    THEN equity / lag(equity) OVER w - 1 END AS r
    FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY ts_ns)) GROUP BY {k})"""
PLAIN_METRICS = """SELECT {k}, n_bars, total_return, max_drawdown, CASE WHEN max_drawdown > 0
    THEN total_return / max_drawdown END AS calmar, CASE WHEN sd > 0 THEN m / sd * {a} END AS sharpe,
    CASE WHEN down > 0 THEN m / down * {a} END AS sortino FROM (SELECT {k}, count(*) AS n_bars,
    arg_max(equity, ts_ns) / arg_min(equity, ts_ns) - 1 AS total_return, max((peak - equity) / peak)
    AS max_drawdown, avg(r) AS m, stddev_pop(r) AS sd, sqrt(sum(r * r) FILTER (r < 0) / count(r))
    AS down FROM (SELECT *, max(equity) OVER w AS peak, equity / lag(equity) OVER w - 1 AS r
    FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY ts_ns)) GROUP BY {k})"""
ANNUAL = f"sqrt({365 * 24}::DOUBLE)"
TRADE_METRICS = """SELECT run_id, count(*) AS n_trades, avg((net > 0)::INT::DOUBLE) AS win_rate,
    avg(net) FILTER (net > 0) AS avg_win, abs(avg(net) FILTER (net < 0)) AS avg_loss,
    avg(net) FILTER (net > 0) / abs(avg(net) FILTER (net < 0)) AS payoff,
    coalesce(sum(net) FILTER (net > 0), 0) / abs(sum(net) FILTER (net < 0)) AS profit_factor,
    avg(net) / avg(entry_price * qty) * 1e4 AS expectancy_bps, avg(hold_ns) / 1e9 AS hold_s,
    sum(gross) AS gross_total, sum(fees) AS fees_total, sum(slippage) AS slippage_total,
    sum(funding) AS funding_total, sum(net) AS net_total,
    CASE WHEN sum(gross) > 0 THEN sum(fees) / sum(gross) END AS fee_drag,
    avg(net) / (stddev_samp(net) / sqrt(count(*))) AS t_stat FROM trips GROUP BY 1"""
EQ_COLS = "total_return max_drawdown"
TRADE_COLS = ("win_rate avg_win avg_loss payoff profit_factor expectancy_bps gross_total fees_total "
              "slippage_total funding_total net_total fee_drag")


RUN_METRICS = f"""SELECT * REPLACE (coalesce(n_trades, 0) AS n_trades, CASE WHEN n_trades IS NULL
    THEN coalesce(total_return, 0) ELSE total_return END AS total_return) FROM
    ({EQ_METRICS.format(k='run_id', a=ANNUAL, src='equity')}) LEFT JOIN ({TRADE_METRICS}) USING (run_id)"""


@query("a18_a19_run_metrics", RUN_METRICS, "run_id n_bars n_trades",
       f"{EQ_COLS} {TRADE_COLS}", "calmar sharpe sortino t_stat hold_s", equity=EQUITY, trips=TRIPS)
def _(spark, sf):
    return runs(spark, sf).withColumn("hold_s", F.col("avg_hold_ns") / 1e9)


def runs(spark, sf):
    return performance.run_metrics(equity(spark, sf), trips(spark, sf), H, width=8 * D)


@query("a20_regime_metrics", f"""SELECT * FROM ({EQ_METRICS.format(k='run_id, label', a=ANNUAL,
    src='labels')}) JOIN (SELECT run_id, label, avg(vol) AS vol_mean FROM labels GROUP BY 1, 2)
    USING (run_id, label)""", "run_id label n_bars", EQ_COLS + " vol_mean", "sharpe",
       fills=v.VIEW_SQL["fills"].replace("ORDER BY ts_ns)", "ORDER BY ts_ns, agg_id)"),
       equity=EQUITY.replace("run_id, ts_ns,", "run_id, ts_ns, order_id,"),
       marks="""SELECT run_id, row_number() OVER o AS k, equity, close / nullif(lag(close) OVER o, 0) - 1
       AS r FROM equity WINDOW o AS (PARTITION BY run_id ORDER BY ts_ns, order_id)""",
       rv="""SELECT run_id, k AS ts_ns, equity, CASE WHEN count(r) OVER w = 24 THEN
       round(stddev_pop(r) OVER w, 12) END AS vol FROM marks WINDOW w AS (PARTITION BY run_id ORDER BY k
       ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
       labels="""SELECT *, CASE WHEN n <= 24 OR vol <= a THEN 'low' WHEN vol > b THEN 'high' ELSE 'mid' END
       AS label FROM rv JOIN (SELECT run_id, count(vol) AS n, quantile_cont(vol, 0.333) AS a,
       quantile_cont(vol, 0.667) AS b FROM rv GROUP BY 1) USING (run_id) WHERE vol IS NOT NULL""")
def _(spark, sf):
    """Ticks and fills of one time come by their id; the SQL numbers them in that order."""
    curve = marked(fills(spark, sf), "order_id")
    return performance.regime_metrics(curve, 24, H, width=8 * D, tie=["order_id"])


@query("a26_curve_summary", f"""SELECT *, CASE WHEN start_equity > 0 AND end_equity >= 0 AND n_days > 0
    THEN (end_equity / start_equity) ^ (365.0::DOUBLE / n_days) - 1 END AS cagr
    FROM (SELECT run_id, count(r) AS n_days, arg_max(equity, ts_ns)
    / nullif(arg_min(equity, ts_ns), 0) - 1 AS total_return,
    max(1 - equity / peak) FILTER (peak > 0) AS max_drawdown,
    arg_min(equity, ts_ns) AS start_equity, arg_max(equity, ts_ns) AS end_equity,
    stddev_samp(r) * sqrt(365.0::DOUBLE) AS volatility, CASE WHEN stddev_samp(r) > 0
    THEN avg(r) / stddev_samp(r) * sqrt(365.0::DOUBLE) END AS sharpe
    FROM (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS r,
    max(equity) OVER w AS peak FROM daily_eq WINDOW w AS (PARTITION BY run_id ORDER BY ts_ns))
    GROUP BY 1)""", "run_id n_days", "total_return max_drawdown start_equity end_equity volatility",
       "cagr sharpe", grid=f"""SELECT run_id, unnest(generate_series(min(ts_ns) // {D} * {D},
       max(ts_ns) // {D} * {D}, {D})) AS ts_ns FROM equity GROUP BY 1""",
       daily_eq=f"""SELECT g.run_id, g.ts_ns, e.equity FROM grid g ASOF JOIN equity e
       ON e.run_id = g.run_id AND g.ts_ns + {D} > e.ts_ns""", equity=EQUITY)
def _(spark, sf):
    """The last value of every day, days without a fill included."""
    from barlake.operators.asof import asof_join

    e = equity(spark, sf)
    ends = e.groupBy("run_id").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("b"))
    first, last = (F.col(c) - F.pmod(c, F.lit(D)) for c in "ab")
    grid = ends.select("run_id", F.explode(F.sequence(first, last, F.lit(D))).alias("ts_ns")).withColumn(
        "_end", F.col("ts_ns") + D)
    marks = asof_join(grid, e, ["run_id"], left_ts="_end", values=["equity"], width=8 * D, strict=True)
    return performance.curve_summary(marks.drop("_end"), ["run_id"])


@query("a28_combine_legs", """SELECT a.run_id, a.ts_ns, a.equity + b.equity AS equity
    FROM equity_h a JOIN (SELECT run_id, coalesce(lead(run_id) OVER (ORDER BY run_id),
    first(run_id) OVER (ORDER BY run_id)) AS other FROM (SELECT DISTINCT run_id FROM equity_h)) n
    USING (run_id) JOIN equity_h b ON b.run_id = n.other AND b.ts_ns = a.ts_ns""", "run_id ts_ns",
       "equity", equity=EQUITY, equity_h=f"""SELECT run_id, ts_ns // {H} * {H} AS ts_ns,
       arg_max(equity, ts_ns) AS equity FROM equity GROUP BY 1, 2""")
def _(spark, sf):
    """Every run with the next one by name, the last with the first."""
    hour = F.col("ts_ns") - F.pmod("ts_ns", F.lit(H))
    e = settle(equity(spark, sf).groupBy("run_id", hour.alias("h")).agg(
        F.max_by("equity", "ts_ns").alias("equity")).withColumnRenamed("h", "ts_ns"), "hours")
    by_name = W.orderBy("run_id")  # one row per run
    following = e.select("run_id").distinct().select("run_id", F.coalesce(
        F.lead("run_id").over(by_name), F.first("run_id").over(by_name)).alias("other"))
    legs = e.withColumnRenamed("run_id", "other").join(following, "other")
    return performance.combine_legs(e, legs, ["run_id"])


@query("a34_histogram", """SELECT run_id, least(floor((net - lo) / (hi - lo) * 20), 19)::INT AS bin,
    count(*) AS n FROM trips JOIN (SELECT run_id, min(net) AS lo, max(net) AS hi FROM trips
    GROUP BY 1) USING (run_id) GROUP BY 1, 2""", "run_id bin n", trips=TRIPS)
def _(spark, sf):
    return performance.histogram(trips(spark, sf), ["run_id"])


@query("a35_compare_runs", f"""SELECT metric, run_id, value FROM (SELECT run_id,
    COLUMNS(* EXCLUDE (run_id))::DOUBLE FROM ({RUN_METRICS})) UNPIVOT INCLUDE NULLS (value FOR metric IN
    (COLUMNS(* EXCLUDE (run_id))))""", "metric run_id", r4="value",
       equity=EQUITY, trips=TRIPS)
def _(spark, sf):
    table = runs(spark, sf).withColumn("hold_s", F.col("avg_hold_ns") / 1e9).drop("avg_hold_ns")
    return performance.compare_runs(settle(table, "runs"))


@query("a36_monthly_funding", """SELECT pair, strftime(make_timestamp(ts_ns // 1000), '%Y-%m') AS month,
    sum(rate) AS rate FROM leg_funding GROUP BY 1, 2""", "pair month", "rate")
def _(spark, sf):
    return performance.monthly_sums(v.leg_funding(spark, sf), "rate", ["pair"], "rate")


@query("a37_leg_stats", """SELECT leg, n_orders, n_rejected, n_fills, fill_qty, fees, slippage,
    min(fill_qty) OVER () / max(fill_qty) OVER () AS coverage FROM (SELECT symbol AS leg, count(*)
    AS n_orders, count(*) FILTER (qty > 15) AS n_rejected FROM order_book_orders GROUP BY 1)
    JOIN (SELECT run_id AS leg, count(*) AS n_fills, sum(qty) AS fill_qty, sum(fee) AS fees,
    0.0::DOUBLE AS slippage FROM fills GROUP BY 1) USING (leg)""",
       "leg n_orders n_rejected n_fills", "fill_qty fees slippage coverage")
def _(spark, sf):
    o = v.order_book_orders(spark, sf).select(
        F.col("symbol").alias("leg"), F.when(F.col("qty") > 15, "too large").alias("reject_reason"))
    f = v.fills(spark, sf).withColumn("slippage_cost", F.lit(0.0)).withColumnRenamed("run_id", "leg")
    stats = performance.leg_stats(o, f, ["leg"])
    return stats.crossJoin(F.broadcast(performance.coverage(stats, [])))


@query("a38_j16_margin_ratio", f"""SELECT pair, min(ratio) AS min_ratio, arg_min(ts_ns, (ratio, ts_ns))
    AS min_ratio_ts, max(CASE WHEN inside THEN 1 - equity / peak END) AS window_drawdown,
    arg_max(2 * mark - se, ts_ns) - arg_min(2 * mark - se, ts_ns) AS borrow_interest FROM (
    SELECT *, equity / (0.005::DOUBLE * 2 * mark) AS ratio, max(CASE WHEN inside THEN equity END)
    OVER (ORDER BY ts_ns) AS peak FROM (SELECT pair, ts_ns, spot * 3 AS equity, perp AS mark,
    spot * 1.5 AS se, ts_ns BETWEEN {800000000 * 10**9} AND {850000000 * 10**9} AS inside FROM legs))
    GROUP BY 1""", "pair min_ratio_ts", "min_ratio window_drawdown borrow_interest")
def _(spark, sf):
    marks = v.legs(spark, sf).select(
        "pair", "ts_ns", (F.col("spot") * 3.0).alias("equity"), F.col("perp").alias("mark"),
        (F.col("spot") * 1.5).alias("spot_equity"))
    return performance.margin_ratio(marks, 2.0, 0.005, (800000000 * 10**9, 850000000 * 10**9),
                                    ["pair"])


@query("w26_interest_accrual", f"""SELECT symbol, ts_ns, 1000 * exp(sum(ln(1 + 0.1::DOUBLE *
    coalesce(ts_ns - p, 0) / {365 * D}.0::DOUBLE)) OVER (PARTITION BY symbol ORDER BY ts_ns)) AS debt
    FROM (SELECT symbol, ts_ns, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns) AS p
    FROM bars_1h)""", "symbol ts_ns", "debt")
def _(spark, sf):
    marks = mq.hourly(spark, sf).select("symbol", "ts_ns")
    return performance.accrued_debt(marks, 0.1, 1000.0, width=8 * D)


# -- verdicts -----------------------------------------------------------------------------

RUN_TABLE = f"""SELECT run_id, n_trades, expectancy_bps, CASE WHEN run_id <> 'view' THEN t_stat END
    AS t_stat, profit_factor, max_drawdown, expectancy_bps > 0 AS stress_ok,
    CASE WHEN run_id <> 'click' THEN win_rate END AS folds FROM
    ({PLAIN_METRICS.format(k='run_id', a=ANNUAL, src='equity')}) JOIN ({TRADE_METRICS}) USING (run_id)"""
def detail_sql(column: str, sign: str, limit: str | float) -> str:
    bound = float(verdicts.THRESHOLDS.get(limit, limit))
    given = {"stress_ok": "stress_ok::INT", "pct_positive_folds": "folds"}.get(column, column)
    return (f"'{column} ' || coalesce(CAST({given} AS DECIMAL(28, 4))::VARCHAR, 'missing') || "
            f"' {sign} {bound:.4f}'")


CRITERIA = f"""SELECT run_id, unnest(['trades', 'expectancy', 't_stat', 'profit_factor', 'drawdown',
    'stress', 'folds']) AS criterion, unnest([{", ".join(detail_sql(*c[1:]) for c in verdicts.CRITERIA)}])
    AS detail, unnest([n_trades >= 300, coalesce(expectancy_bps > 0, false),
    coalesce(t_stat >= 2, false), coalesce(profit_factor >= 1.2, false), coalesce(max_drawdown <= 0.25,
    false), coalesce(stress_ok, false), coalesce(folds >= 0.7, false)]) AS ok FROM rt"""


def run_table(spark, sf):
    r = runs(spark, sf)
    return settle(r.withColumns({
        "t_stat": F.when(F.col("run_id") != "view", F.col("t_stat")),
        "stress_ok": F.col("expectancy_bps") > 0,
        "pct_positive_folds": F.when(F.col("run_id") != "click", F.col("win_rate"))}), "runs")


@query("a41_criteria", "SELECT * FROM crit", "run_id criterion ok detail", rt=RUN_TABLE, crit=CRITERIA,
       equity=EQUITY, trips=TRIPS)
def _(spark, sf):
    return verdicts.criteria(run_table(spark, sf))


@query("a41_verdict", """SELECT run_id, bool_and(ok) AS go, count(*) FILTER (NOT ok) AS n_failed
    FROM crit GROUP BY 1""", "run_id go n_failed", rt=RUN_TABLE, crit=CRITERIA, equity=EQUITY,
       trips=TRIPS)
def _(spark, sf):
    return verdicts.verdict(verdicts.criteria(run_table(spark, sf)))


@query("a42_holdout_checks", """SELECT c_custkey AS run_id, c_acctbal > 0 AS first_positive,
    c_acctbal > 500 AS second_positive, c_acctbal > 3000 AS beats_benchmark, c_nationkey < 20
    AS no_rejected_exits, c_acctbal > 3000 AND c_nationkey < 20 AS survives FROM customer""",
       "run_id first_positive second_positive beats_benchmark no_rejected_exits survives")
def _(spark, sf):
    b = F.col("c_acctbal")
    t = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), b.alias("first_return"), (b - 500).alias("second_return"),
        b.alias("portfolio_return"), F.lit(3000.0).alias("benchmark_return"),
        F.greatest(F.lit(0), F.col("c_nationkey") - 19).alias("rejected_exits"))
    return verdicts.holdout_checks(t)


@query("a42_carry_checks", """SELECT c_custkey AS run_id, c_nationkey < 20 AND c_acctbal > 0
    AS execution_ok, c_acctbal < 5000 AS drawdown_ok, c_acctbal > 1000 AS net_ok,
    c_nationkey < 20 AND c_acctbal < 5000 AND c_acctbal > 1000 AS survives FROM customer""",
       "run_id execution_ok drawdown_ok net_ok survives")
def _(spark, sf):
    b = F.col("c_acctbal")
    t = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"), F.lit(1).alias("n_fills_spot"),
        F.lit(1).alias("n_fills_perp"),
        F.greatest(F.lit(0), F.col("c_nationkey") - 19).alias("n_rejected"),
        F.when(b > 0, 1.0).otherwise(0.5).alias("coverage"),
        F.when(b < 5000, 0.01).otherwise(0.5).alias("drawdown"),
        F.lit(1000.0).alias("equity_start"), b.alias("equity_end"))
    return verdicts.carry_checks(t)


@query("a43_holdout_overlaps", f"""SELECT count(*) FILTER (epoch_ns(o_orderdate) <= {900000000 * 10**9}
    AND epoch_ns(o_orderdate) + {30 * D} >= {890000000 * 10**9}) AS attempts, count(*) AS n_runs
    FROM orders""", "attempts n_runs")
def _(spark, sf):
    start = v.day_ns("o_orderdate")
    r = v.table(spark, sf, "orders").select(start.alias("start_ns"), (start + 30 * D).alias("end_ns"))
    return verdicts.holdout_overlaps(r, 890000000 * 10**9, 900000000 * 10**9)


# -- trade lists --------------------------------------------------------------------------

BAND = {
    "zs": mq.Z_SQL,
    "zrows": "SELECT symbol, ts_ns, z, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS rn "
             "FROM zs",
    "band": """SELECT symbol, 0::BIGINT AS rn, 0::BIGINT AS ts_ns, 0 AS position FROM zrows WHERE rn = 1
      UNION ALL SELECT z.symbol, z.rn, z.ts_ns, CASE WHEN z IS NULL THEN position
      WHEN position = 1 THEN CASE WHEN z >= -0.5 THEN 0 ELSE 1 END
      WHEN position = -1 THEN CASE WHEN z <= 0.5 THEN 0 ELSE -1 END
      WHEN z <= -1.5 THEN 1 WHEN z >= 1.5 THEN -1 ELSE 0 END
      FROM band b JOIN zrows z ON z.symbol = b.symbol AND z.rn = b.rn + 1""",
    "moves": """SELECT b.symbol, b.ts_ns, b.position, lag(b.position, 1, 0) OVER w AS was,
      lead(q.open) OVER w AS px, lead(b.ts_ns) OVER w AS fill_at FROM band b JOIN bars_1h q
      ON q.symbol = b.symbol AND q.ts_ns = b.ts_ns WINDOW w AS (PARTITION BY b.symbol
      ORDER BY b.ts_ns)""",
    "pairs": """SELECT symbol, was AS direction, lag(fill_at) OVER w AS entry_ts, lag(px) OVER w
      AS entry_open, fill_at AS exit_ts, px AS exit_open, position FROM moves WHERE position <> was
      WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns)""",
    "trade_list": """SELECT *, ep * q AS unused, direction * (xp - ep) AS gross, (ep + xp) * 5 / 1e4
      AS fees, (entry_open + exit_open) / 1e4 AS slippage, direction * (xp - ep) - (ep + xp) * 5 / 1e4
      - (entry_open + exit_open) / 1e4 AS net FROM (SELECT *, 1 AS q, entry_open * (1 + direction
      * 1.0::DOUBLE / 1e4) AS ep, exit_open * (1 - direction * 1.0::DOUBLE / 1e4) AS xp FROM pairs
      WHERE position = 0 AND exit_ts IS NOT NULL)""",
}


def band(spark, sf):
    b = mq.hourly(spark, sf)
    z = features.zscore(b, 24, width=mq.WIDE)
    return b, trades.band_positions(z.where("z IS NOT NULL").select("symbol", "ts_ns", "z"), "z",
                                    1.5, 0.5, width=mq.WIDE, block_rows=128)


@query("m11_band_positions", "SELECT b.symbol, b.ts_ns, b.position FROM band b JOIN zs USING (symbol, "
       "ts_ns) WHERE z IS NOT NULL", "symbol ts_ns position", **BAND)
def _(spark, sf):
    return band(spark, sf)[1]


def band_trades(spark, sf):
    b, pos = band(spark, sf)
    held = b.select("symbol", "ts_ns").join(pos.select("symbol", "ts_ns", "position"),
                                            ["symbol", "ts_ns"], "left").fillna(0, ["position"])
    return settle(trades.position_trades(held, b, 1.0, 5.0, width=mq.WIDE), "trades")


@query("m11_f3_trade_list", "SELECT symbol, direction, entry_ts, exit_ts, gross, fees, slippage, net "
       "FROM trade_list", "symbol direction entry_ts exit_ts", "gross fees slippage net", **BAND)
def _(spark, sf):
    return band_trades(spark, sf)


@query("m11_fixed_hold_trades", """SELECT c.symbol, c.ts_ns, c.exit_ts FROM chosen JOIN c
    ON c.symbol = chosen.symbol AND c.i = chosen.i""", "symbol ts_ns exit_ts",
       evs=mq.BREAKOUT_SQL,
       c="""SELECT e.symbol, e.ts_ns, x.exit_ts, row_number() OVER (PARTITION BY e.symbol
       ORDER BY e.ts_ns) AS i FROM evs e JOIN (SELECT symbol, ts_ns, lead(ts_ns, 7) OVER (
       PARTITION BY symbol ORDER BY ts_ns) AS exit_ts FROM bars_1h) x USING (symbol, ts_ns)
       WHERE exit_ts IS NOT NULL""",
       nxt="""SELECT a.symbol, a.i, min(b.i) AS j FROM c a LEFT JOIN c b ON a.symbol = b.symbol
       AND b.ts_ns >= a.exit_ts GROUP BY 1, 2""",
       chosen="""SELECT symbol, 1::BIGINT AS i FROM c WHERE i = 1 UNION ALL SELECT n.symbol, n.j
       FROM chosen c JOIN nxt n ON n.symbol = c.symbol AND n.i = c.i WHERE n.j IS NOT NULL""")
def _(spark, sf):
    b = mq.hourly(spark, sf)
    events = signals.breakout(b, 12, 1.5, width=mq.WIDE)
    return exits.fixed_hold_trades(events, b, 6, 1.0, 5.0, width=mq.WIDE)


@query("m11_range_exit_trades", """SELECT c.symbol, c.ts_ns, c.exit_ts, c.entry_open, c.exit_open
    FROM chosen JOIN c ON c.symbol = chosen.symbol AND c.i = chosen.i""", "symbol ts_ns exit_ts",
       "entry_open exit_open",
       nb="""SELECT symbol, ts_ns, open, high, low, close, volume, row_number() OVER w AS rn,
       lead(ts_ns) OVER w AS nts, lead(open) OVER w AS nopen, max(high) OVER f AS top, min(low) OVER f
       AS bot, CASE WHEN count(*) OVER f = 12 AND volume > 1.5 * avg(volume) OVER f THEN
       CASE WHEN close > max(high) OVER f THEN 1 WHEN close < min(low) OVER f THEN -1 END END AS d
       FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns), f AS (PARTITION BY symbol
       ORDER BY ts_ns ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
       ex="""SELECT e.symbol, e.rn, e.ts_ns, e.nopen AS entry_open, min(x.rn) AS xrn FROM nb e JOIN nb x
       ON x.symbol = e.symbol AND x.rn > e.rn AND (x.rn = e.rn + 8 OR CASE WHEN e.d = 1 THEN
       x.close < e.top ELSE x.close > e.bot END) WHERE e.d IS NOT NULL GROUP BY ALL""",
       c="""SELECT ex.symbol, ex.ts_ns, ex.entry_open, b.nts AS exit_ts, b.nopen AS exit_open,
       row_number() OVER (PARTITION BY ex.symbol ORDER BY ex.ts_ns) AS i FROM ex JOIN nb b
       ON b.symbol = ex.symbol AND b.rn = xrn WHERE b.nts IS NOT NULL""",
       nxt="""SELECT a.symbol, a.i, min(b.i) AS j FROM c a LEFT JOIN c b ON a.symbol = b.symbol
       AND b.ts_ns >= a.exit_ts GROUP BY 1, 2""",
       chosen="""SELECT symbol, 1::BIGINT AS i FROM c WHERE i = 1 UNION ALL SELECT n.symbol, n.j
       FROM chosen c JOIN nxt n ON n.symbol = c.symbol AND n.i = c.i WHERE n.j IS NOT NULL""")
def _(spark, sf):
    b = mq.hourly(spark, sf)
    events = signals.breakout_levels(b, 12, 1.5, width=mq.WIDE)
    return exits.range_exit_trades(events, b, 8, 1.0, 5.0, width=mq.WIDE)


# Positions bar by bar: what was pending leaves at the open, a stop inside the bar, then the bar decides.
STOP, HOLD = 300.0, 6
EXITS = {
    "zs": mq.Z_SQL,
    "zbars": """SELECT b.symbol, b.ts_ns, b.open, b.high, b.low, b.close, zs.z, row_number() OVER (
      PARTITION BY b.symbol ORDER BY b.ts_ns) AS rn FROM bars_1h b LEFT JOIN zs USING (symbol, ts_ns)""",
    "walked": f"""SELECT symbol, 0::BIGINT AS rn, 0 AS p, 0::BIGINT AS e, 0::DOUBLE AS c, '' AS x, 0 AS closed,
      0::BIGINT AS opened, '' AS reason FROM zbars WHERE rn = 1
      UNION ALL SELECT symbol, rn, CASE WHEN free THEN ent ELSE p END, CASE WHEN free THEN rn ELSE e END,
      CASE WHEN free THEN close ELSE c END, CASE WHEN free THEN '' WHEN CASE WHEN p = 1 THEN z >= -0.5
        ELSE z <= 0.5 END THEN 'rule' WHEN rn - e >= {HOLD} THEN 'hold' ELSE '' END,
      CASE WHEN gone THEN p ELSE 0 END, e, CASE WHEN x <> '' THEN x ELSE 'stop' END FROM (
      SELECT *, gone OR p = 0 AS free FROM (SELECT z.*, w.p, w.e, w.c, w.x,
        CASE WHEN z.z <= -1.5 THEN 1 WHEN z.z >= 1.5 THEN -1 ELSE 0 END AS ent,
        w.p <> 0 AND (w.x <> '' OR (z.rn >= w.e + 2 AND CASE WHEN w.p = 1
          THEN z.low <= w.c * (1 - {STOP}::DOUBLE / 1e4) ELSE z.high >= w.c * (1 + {STOP}::DOUBLE / 1e4) END)) AS gone
        FROM walked w JOIN zbars z ON z.symbol = w.symbol AND z.rn = w.rn + 1))""",
    "exit_trades": f"""SELECT w.symbol, closed AS direction, a.ts_ns AS entry_ts, a.open AS entry_open,
      b.ts_ns AS exit_ts, reason, CASE WHEN reason <> 'stop' THEN b.open WHEN closed = 1 THEN
      least(b.open, s.close * (1 - {STOP}::DOUBLE / 1e4)) ELSE greatest(b.open, s.close * (1 + {STOP}::DOUBLE / 1e4))
      END AS exit_open FROM walked w JOIN zbars s ON s.symbol = w.symbol AND s.rn = opened
      JOIN zbars a ON a.symbol = w.symbol AND a.rn = opened + 1
      JOIN zbars b ON b.symbol = w.symbol AND b.rn = w.rn WHERE closed <> 0""",
}
PRICED = """direction * (xp - ep) AS gross, (ep + xp) * 5 / 1e4 AS fees, (entry_open + exit_open) / 1e4 AS slippage,
    direction * (xp - ep) - (ep + xp) * 5 / 1e4 - (entry_open + exit_open) / 1e4 AS net"""
PRICES = """*, entry_open * (1 + direction * 1.0::DOUBLE / 1e4) AS ep,
    exit_open * (1 - direction * 1.0::DOUBLE / 1e4) AS xp"""
TRADE_KEEP, TRADE_R6 = "symbol direction entry_ts exit_ts", "entry_open exit_open gross fees slippage net"


def exit_trades(spark, sf):
    b = mq.hourly(spark, sf)
    z = features.zscore(b, 24, width=mq.WIDE)
    return settle(exits.band_exit_trades(z, b, "z", 1.5, 0.5, 1.0, 5.0, STOP, HOLD, mq.WIDE), "trades")


@query("m11_band_exit_trades", f"SELECT *, {PRICED} FROM (SELECT {PRICES} FROM exit_trades)",
       f"{TRADE_KEEP} reason", TRADE_R6, **EXITS)
def _(spark, sf):
    return exit_trades(spark, sf)


@query("m11_range_stop_trades", f"""SELECT *, {PRICED} FROM (SELECT {PRICES} FROM (SELECT c.* FROM chosen
    JOIN c ON c.symbol = chosen.symbol AND c.i = chosen.i WHERE c.exit_ts IS NOT NULL))""",
       f"{TRADE_KEEP} reason", TRADE_R6,
       nb="""SELECT symbol, ts_ns, open, high, low, close, volume, row_number() OVER w AS rn,
       lead(ts_ns) OVER w AS nts, lead(open) OVER w AS nopen, max(high) OVER f AS top, min(low) OVER f
       AS bot, CASE WHEN count(*) OVER f = 12 AND volume > 1.5 * avg(volume) OVER f THEN
       CASE WHEN close > max(high) OVER f THEN 1 WHEN close < min(low) OVER f THEN -1 END END AS d
       FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns), f AS (PARTITION BY symbol
       ORDER BY ts_ns ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
       ev="""SELECT *, close * (1 - d * 200.0::DOUBLE / 1e4) AS stop FROM nb WHERE d IS NOT NULL
       AND nts IS NOT NULL""",
       ru="""SELECT e.symbol, e.rn, min(x.rn) AS at FROM ev e JOIN nb x ON x.symbol = e.symbol
       AND x.rn > e.rn AND CASE WHEN e.d = 1 THEN x.close < e.top ELSE x.close > e.bot END GROUP BY ALL""",
       st="""SELECT e.symbol, e.rn, min(x.rn) AS at FROM ev e JOIN nb x ON x.symbol = e.symbol
       AND x.rn >= e.rn + 2 AND CASE WHEN e.d = 1 THEN x.low <= e.stop ELSE x.high >= e.stop END GROUP BY ALL""",
       c="""SELECT e.symbol, e.ts_ns, e.d AS direction, e.nts AS entry_ts, e.nopen AS entry_open,
       CASE WHEN st.at <= least(ru.at, e.rn + 8) THEN s.ts_ns ELSE x.nts END AS exit_ts,
       CASE WHEN st.at <= least(ru.at, e.rn + 8) THEN CASE WHEN e.d = 1 THEN least(s.open, e.stop)
         ELSE greatest(s.open, e.stop) END ELSE x.nopen END AS exit_open,
       CASE WHEN st.at <= least(ru.at, e.rn + 8) THEN 'stop' WHEN ru.at <= e.rn + 8 THEN 'rule' ELSE 'hold'
       END AS reason, row_number() OVER (PARTITION BY e.symbol ORDER BY e.ts_ns) AS i FROM ev e
       LEFT JOIN ru ON ru.symbol = e.symbol AND ru.rn = e.rn LEFT JOIN st ON st.symbol = e.symbol AND st.rn = e.rn
       LEFT JOIN nb s ON s.symbol = e.symbol AND s.rn = st.at
       LEFT JOIN nb x ON x.symbol = e.symbol AND x.rn = least(ru.at, e.rn + 8)""",
       nxt="""SELECT a.symbol, a.i, min(b.i) AS j FROM c a LEFT JOIN c b ON a.symbol = b.symbol
       AND b.ts_ns >= a.exit_ts GROUP BY 1, 2""",
       chosen="""SELECT symbol, 1::BIGINT AS i FROM c WHERE i = 1 UNION ALL SELECT n.symbol, n.j
       FROM chosen c JOIN nxt n ON n.symbol = c.symbol AND n.i = c.i WHERE n.j IS NOT NULL""")
def _(spark, sf):
    b = mq.hourly(spark, sf)
    events = signals.breakout_levels(b, 12, 1.5, width=mq.WIDE)
    return exits.range_exit_trades(events, b, 8, 1.0, 5.0, 200.0, mq.WIDE)


@query("m11_settlement_trades", f"""SELECT *, {PRICED} FROM (SELECT {PRICES} FROM (SELECT c.* FROM chosen
    JOIN c ON c.symbol = chosen.symbol AND c.i = chosen.i WHERE c.exit_ts IS NOT NULL))""",
       TRADE_KEEP, TRADE_R6,
       hist="""SELECT symbol, ts_ns, rate, list(rate) OVER (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN
       12 PRECEDING AND 1 PRECEDING) AS past FROM funding""",
       ev="""SELECT symbol, ts_ns FROM hist WHERE len(past) >= 6 AND rate >= list_aggregate(past,
       'quantile_cont', 0.7) AND rate > list_aggregate(past, 'median')""",
       nb="""SELECT symbol, ts_ns, open, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS rn
       FROM bars_1h""",
       c=f"""SELECT e.symbol, e.ts_ns, 1 AS direction, a.ts_ns AS entry_ts, a.open AS entry_open, x.ts_ns AS exit_ts,
       x.open AS exit_open, row_number() OVER (PARTITION BY e.symbol ORDER BY e.ts_ns) AS i FROM (
       SELECT e.symbol, e.ts_ns, min(b.rn) AS at FROM ev e JOIN nb b ON b.symbol = e.symbol
         AND b.ts_ns + {H} >= e.ts_ns + 150000000 GROUP BY ALL) e
       JOIN nb a ON a.symbol = e.symbol AND a.rn = e.at
       LEFT JOIN nb x ON x.symbol = e.symbol AND x.rn = e.at + 21""",
       nxt=f"""SELECT a.symbol, a.i, min(b.i) AS j FROM c a LEFT JOIN c b ON a.symbol = b.symbol
       AND b.ts_ns > a.exit_ts + {H} GROUP BY 1, 2""",
       chosen="""SELECT symbol, 1::BIGINT AS i FROM c WHERE i = 1 UNION ALL SELECT n.symbol, n.j
       FROM chosen c JOIN nxt n ON n.symbol = c.symbol AND n.i = c.i WHERE n.j IS NOT NULL""")
def _(spark, sf):
    """Settlements at or above the 70th percentile of the past twelve, held for twenty hours."""
    events = signals.funding_percentile(v.funding(spark, sf), 12, 70.0)
    return exits.settlement_hold_trades(events, mq.hourly(spark, sf), 20, H, 150_000_000, 1.0, 5.0, mq.WIDE)


@query("m11_flow_trades", f"""SELECT *, {PRICED} FROM (SELECT {PRICES} FROM (SELECT symbol, was AS direction,
    lag(fill_at) OVER w AS entry_ts, lag(px) OVER w AS entry_open, fill_at AS exit_ts, px AS exit_open, position
    FROM turns WHERE position <> was WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns))
    WHERE position = 0 AND exit_ts IS NOT NULL)""", TRADE_KEEP, TRADE_R6,
       fl="""SELECT symbol, ts_ns, open, row_number() OVER w AS rn, lead(ts_ns) OVER w AS fill_at,
       lead(open) OVER w AS px, CASE WHEN count(*) OVER f = 12 AND sum(volume) OVER f > 0 THEN
       2 * sum(taker_buy_volume) OVER f / sum(volume) OVER f - 1 END AS x FROM bars_1h WINDOW w AS (
       PARTITION BY symbol ORDER BY ts_ns), f AS (PARTITION BY symbol ORDER BY ts_ns ROWS 11 PRECEDING)""",
       states="""SELECT symbol, 0::BIGINT AS rn, 0 AS position, 0 AS was FROM fl WHERE rn = 1 UNION ALL
       SELECT f.symbol, f.rn, CASE WHEN position = 1 THEN CASE WHEN x < 0 THEN 0 ELSE 1 END
       WHEN position = -1 THEN CASE WHEN x > 0 THEN 0 ELSE -1 END
       WHEN x >= 0.1 THEN 1 WHEN x <= -0.1 THEN -1 ELSE 0 END, position FROM states s JOIN fl f
       ON f.symbol = s.symbol AND f.rn = s.rn + 1""",
       turns="SELECT * FROM states JOIN fl USING (symbol, rn)")
def _(spark, sf):
    b = mq.hourly(spark, sf)
    x = features.flow_imbalance(b, 12, width=mq.WIDE)
    held = settle(trades.flow_positions(x.select("symbol", "ts_ns", "flow"), "flow", 0.1, width=mq.WIDE,
                                        block_rows=128), "positions")
    return trades.position_trades(held, b, 1.0, 5.0, width=mq.WIDE)


STRESS_SQL = ", ".join(f"('{n}', {f}::DOUBLE, {s}::DOUBLE, {ms})" for n, (f, s, ms) in trades.STRESS.items())
ORDER_LATENCY = 150_000_000


@query("m13_stress", f"""SELECT symbol, scenario, count(*) AS n_trades, sum(n) AS net_total,
    avg(n) / avg(e) * 1e4 AS expectancy_bps, avg(n) / avg(e) * 1e4 > 0 AS survives FROM (
    SELECT *, direction * (x - e) - (e + x) * f * 5 / 1e4 - (a + b) * s / 1e4 AS n
    FROM (SELECT symbol, scenario, direction, a, b, f, s, a * (1 + direction * s / 1e4) AS e,
    b * (1 - direction * s / 1e4) AS x FROM timed)) GROUP BY 1, 2""", "symbol scenario n_trades survives",
       "net_total expectancy_bps", timed=f"""SELECT t.symbol, t.scenario, t.direction, t.f, t.s, i.price AS a,
       o.price AS b FROM (SELECT *, entry_ts + {ORDER_LATENCY} + ms * 1000000 AS ia, exit_ts + {ORDER_LATENCY}
         + ms * 1000000 AS oa FROM trade_list CROSS JOIN (VALUES {STRESS_SQL}) g(scenario, f, s, ms)) t
       ASOF JOIN ticks i ON i.symbol = t.symbol AND t.ia <= i.ts_ns
       ASOF JOIN ticks o ON o.symbol = t.symbol AND t.oa <= o.ts_ns""", **BAND)
def _(spark, sf):
    return trades.stress_table(band_trades(spark, sf), settle(v.ticks(spark, sf), "ticks"), ORDER_LATENCY,
                               1.0, 5.0, width=mq.WIDE)


FOLDS = """SELECT symbol, ts_ns, (rn - 1) // 150 AS fold, CASE WHEN (rn - 1) % 150 < 100 THEN 'train'
    ELSE 'test' END AS role FROM (SELECT symbol, ts_ns, row_number() OVER (PARTITION BY symbol
    ORDER BY ts_ns) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars_1h)
    WHERE ((rn - 1) // 150 + 1) * 150 <= n"""


@query("w25_folds", "SELECT * FROM folds", "symbol ts_ns fold role", folds=FOLDS)
def _(spark, sf):
    return trades.assign_folds(mq.hourly(spark, sf), 100, 50, width=mq.WIDE)


GRID_W, GRID_Z = [12, 24], [1.0, 1.5, 9.0]  # nothing reaches the last threshold: cells without trades


def cells_sql(bars: str) -> dict[str, str]:
    """Trades of all cells over the series (k) of a table with k, ts_ns, open, close."""
    return {
        "cells": f"""SELECT * FROM (SELECT unnest({GRID_W}) AS width) CROSS JOIN (SELECT
          unnest({GRID_Z})::DOUBLE AS entry_z)""",
        "cb": f"""SELECT k || '|' || width || '|' || entry_z AS key, k, width, entry_z, ts_ns, open, row_number()
          OVER (PARTITION BY k, width, entry_z ORDER BY ts_ns) AS rn, CASE WHEN width = 12 THEN z12 ELSE z24 END
          AS z FROM (SELECT *, {", ".join(f"""CASE WHEN count(*) OVER w{n} = {n} AND stddev_pop(close) OVER w{n} > 0
          THEN (close - avg(close) OVER w{n}) / stddev_pop(close) OVER w{n} END AS z{n}""" for n in GRID_W)}
          FROM {bars} WINDOW {", ".join(f"w{n} AS (PARTITION BY k ORDER BY ts_ns ROWS {n - 1} PRECEDING)"
                                        for n in GRID_W)}) CROSS JOIN cells""",
        "cs": """SELECT key, 0::BIGINT AS rn, 0 AS position, 0 AS was FROM cb WHERE rn = 1
          UNION ALL SELECT b.key, b.rn, CASE WHEN z IS NULL THEN position
          WHEN position = 1 THEN CASE WHEN z >= -0.5 THEN 0 ELSE 1 END
          WHEN position = -1 THEN CASE WHEN z <= 0.5 THEN 0 ELSE -1 END
          WHEN z <= -entry_z THEN 1 WHEN z >= entry_z THEN -1 ELSE 0 END, position
          FROM cs JOIN cb b ON b.key = cs.key AND b.rn = cs.rn + 1""",
        "cm": """SELECT b.k, b.width, b.entry_z, b.ts_ns, s.position, s.was, lead(b.open) OVER w AS px
          FROM cs s JOIN cb b USING (key, rn) WINDOW w AS (PARTITION BY b.key ORDER BY b.rn)""",
        "ct": """SELECT *, direction * (xp - ep) AS gross, (ep + xp) * 5 / 1e4 AS fees, direction * (xp - ep)
          - (ep + xp) * 5 / 1e4 - (e + x) / 1e4 AS net FROM (SELECT *, e * (1 + direction * 1.0::DOUBLE / 1e4) AS ep,
          x * (1 - direction * 1.0::DOUBLE / 1e4) AS xp FROM (SELECT k, width, entry_z, was AS direction, position,
          lag(px) OVER w AS e, px AS x FROM cm WHERE position <> was WINDOW w AS (PARTITION BY k, width, entry_z
          ORDER BY ts_ns)) WHERE position = 0 AND x IS NOT NULL)""",
        "scored": """SELECT k, width, entry_z, count(net) AS n_trades, coalesce(sum(net), 0) AS net_total,
          coalesce(sum(gross), 0) AS gross_total, coalesce(sum(fees), 0) AS fees_total,
          avg(net) / avg(ep) * 1e4 AS expectancy_bps FROM (SELECT DISTINCT k FROM cb) CROSS JOIN cells
          LEFT JOIN ct USING (k, width, entry_z) GROUP BY ALL""",
    }


WALK = cells_sql("fb") | {
    "folds": FOLDS,
    "fb": """SELECT f.symbol || '#' || fold || '#' || role AS k, b.ts_ns, b.open, b.close FROM folds f
      JOIN bars_1h b USING (symbol, ts_ns)""",
    "roles": """SELECT *, split_part(k, '#', 1) AS symbol, split_part(k, '#', 2)::BIGINT AS fold,
      split_part(k, '#', 3) AS role FROM scored""",
    "wf": """SELECT b.symbol, b.fold, b.width, b.entry_z, b.expectancy_bps AS train_score, t.n_trades,
      t.net_total, t.gross_total, t.fees_total, t.expectancy_bps FROM (SELECT *, row_number() OVER (
      PARTITION BY symbol, fold ORDER BY expectancy_bps DESC NULLS LAST, width, entry_z) AS rn FROM roles
      WHERE role = 'train') b JOIN roles t ON t.symbol = b.symbol AND t.fold = b.fold AND t.width = b.width
      AND t.entry_z = b.entry_z AND t.role = 'test' WHERE b.rn = 1""",
}


def with_cells(series):
    """Each row with every cell of the constant grid."""
    grid = F.array(*[F.struct(F.lit(n).alias("width"), F.lit(float(z)).alias("entry_z"))
                     for n in GRID_W for z in GRID_Z])
    return series.select("*", F.inline(grid))


def walk(spark, sf):
    """Every stretch is a run of its own: indicators and positions start anew in it."""
    folds = settle(trades.assign_folds(mq.hourly(spark, sf), 100, 50, width=mq.WIDE), "stretches")
    by = ["symbol", "fold", "role"]
    found = settle(trades.band_cells(folds, GRID_W, GRID_Z, 0.5, 1.0, 5.0, by, mq.WIDE), "trades")
    scored = trades.scored_cells(found, with_cells(folds.select(*by).distinct()), [*by, "width", "entry_z"])
    return settle(trades.walk_forward(settle(scored, "scored"), ["width", "entry_z"]), "folds")


@query("m12_walk_forward", "SELECT * FROM wf", "symbol fold width entry_z n_trades",
       "train_score net_total gross_total fees_total expectancy_bps", **WALK)
def _(spark, sf):
    return walk(spark, sf)


@query("a23_out_of_sample", """SELECT symbol, sum(n_trades)::BIGINT AS n_trades, sum(net_total)
    AS net_total, sum(gross_total) AS gross_total, sum(fees_total) AS fees_total, CASE WHEN sum(n_trades) > 0
    THEN sum(net_total) / sum(n_trades) ELSE 0 END
    AS expectancy_quote, avg((net_total > 0)::INT::DOUBLE) AS pct_positive_folds FROM wf GROUP BY 1""",
       "symbol n_trades", "net_total gross_total fees_total expectancy_quote pct_positive_folds", **WALK)
def _(spark, sf):
    return trades.out_of_sample(walk(spark, sf), ["symbol"])


@query("m14_sweep_ranking", """SELECT width, entry_z, n_trades, net_total, expectancy_bps, row_number() OVER (
    ORDER BY expectancy_bps DESC NULLS LAST, width, entry_z) AS rank, n_trades < 30 AS few_trades FROM (
    SELECT width, entry_z, count(net) AS n_trades, coalesce(sum(net), 0) AS net_total, avg(net) / avg(ep) * 1e4
    AS expectancy_bps FROM cells LEFT JOIN ct USING (width, entry_z) GROUP BY 1, 2)""",
       "width entry_z n_trades rank few_trades", "net_total expectancy_bps",
       **cells_sql("(SELECT symbol AS k, ts_ns, open, close FROM bars_1h)"))
def _(spark, sf):
    found = trades.band_cells(mq.hourly(spark, sf), GRID_W, GRID_Z, 0.5, 1.0, 5.0, width=mq.WIDE)
    one = spark.range(1).select()
    cells = trades.scored_cells(settle(found, "trades"), with_cells(one), ["width", "entry_z"])
    return trades.rank_cells(cells, "expectancy_bps", ["width", "entry_z"], 30)


ACCOUNT = {
    "mk": """SELECT symbol AS run_id, ts_ns, close, lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns) AS before
      FROM bars_1h""",
    "st": """SELECT f.symbol AS run_id, f.ts_ns, f.rate, t.price AS mark FROM funding f ASOF LEFT JOIN ticks t
      ON t.symbol = f.symbol AND f.ts_ns >= t.ts_ns""",
    "ev": f"""SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts_ns, kind, oid) AS rn FROM (
      SELECT run_id, ts_ns, 0 AS kind, 0 AS oid, 0::DOUBLE AS q, 0::DOUBLE AS c, rate, mark AS px, 0::DOUBLE AS y FROM st
      UNION ALL SELECT run_id, ts_ns, 1, 0, 0, 0, 0, 0, coalesce(ts_ns - before, 0) / {365 * D}.0::DOUBLE FROM mk
      UNION ALL SELECT run_id, ts_ns, 2, order_id, CASE WHEN side = 'buy' THEN qty ELSE -qty END,
        CASE WHEN side = 'buy' THEN -qty ELSE qty END * price - fee, 0, 0, 0 FROM fills
      UNION ALL SELECT run_id, ts_ns, 3, 0, 0, 0, 0, close, 0 FROM mk)""",
    "ac": """SELECT run_id, 0::BIGINT AS rn, 0::DOUBLE AS pos, 500::DOUBLE AS cash, 0::DOUBLE AS paid, 0::DOUBLE AS fee
      FROM ev WHERE rn = 1 UNION ALL SELECT e.run_id, e.rn, round(pos + q, 6), cash + c - coalesce(e.rate * px, 0) * pos
      + least(cash, 0) * 0.3 * y, paid + coalesce(e.rate * px, 0) * pos, fee - least(cash, 0) * 0.3 * y
      FROM ac JOIN ev e ON e.run_id = ac.run_id AND e.rn = ac.rn + 1""",
}


@query("x10_account", """SELECT run_id, ts_ns, pos AS position, cash, greatest(0, -cash) AS debt, paid AS funding,
    fee AS interest, cash + pos * px AS equity FROM ac JOIN ev USING (run_id, rn) WHERE kind = 3""",
       "run_id ts_ns", "position", "cash debt funding interest equity", **ACCOUNT)
def _(spark, sf):
    """Runs on borrowed money, with funding settlements at the last price."""
    from barlake.operators.asof import asof_join
    from barlake.operators.tca import equity_account

    ticks = settle(v.ticks(spark, sf), "ticks")
    marks = mq.hourly(spark, sf).select(F.col("symbol").alias("run_id"), "ts_ns", "close")
    due = asof_join(v.funding(spark, sf), ticks, values=["price"], width=8 * D, tie=["agg_id"])
    due = due.select(F.col("symbol").alias("run_id"), "ts_ns", "rate", F.col("price").alias("mark"))
    return equity_account(fills(spark, sf), marks, 500.0, due, 0.3, width=8 * D)


@query("a32_bootstrap_trades", f"""SELECT run_id, count(*) AS n_sims, max(n) AS n_trades,
    quantile_cont(final, 0.05) AS p5, median(final) AS p50, quantile_cont(final, 0.95) AS p95,
    avg(final) AS mean, avg((dd > 50)::INT::DOUBLE) AS prob_dd_over FROM (SELECT run_id, sim,
    arg_max(cum, step) AS final, max(pk - cum) AS dd, count(*) AS n FROM (SELECT *, max(cum) OVER (
    PARTITION BY run_id, sim ORDER BY step) AS pk FROM (SELECT run_id, sim, step, sum(net) OVER (
    PARTITION BY run_id, sim ORDER BY step) AS cum FROM draws JOIN nums USING (run_id, i)))
    GROUP BY 1, 2) GROUP BY 1""", "run_id n_sims n_trades", "p5 p50 p95 mean prob_dd_over",
       trips=TRIPS,
       nums="""SELECT run_id, net, row_number() OVER (PARTITION BY run_id ORDER BY entry_ts) - 1 AS i,
       count(*) OVER (PARTITION BY run_id) AS n FROM trips""",
       draws=f"""SELECT run_id, sim, i AS step, {draw_sql('n', "'11'", 'sim::VARCHAR', 'i::VARCHAR')}
       AS i FROM nums CROSS JOIN (SELECT unnest(range(50)) AS sim)""")
def _(spark, sf):
    return resampling.bootstrap_trades(trips(spark, sf), 50, 11, 50.0, ts="entry_ts", width=8 * D)
