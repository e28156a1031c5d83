"""Queries over bars, features, signals and event studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import assets, bars, edge, features, signals
from barlake.operators.asof import asof_join
from barlake.plans import views as v
from barlake.plans.registry import query
from barlake.plans.views import D, H
from barlake.session import settle

OHLCV = "open high low close volume quote_volume taker_buy_volume taker_buy_quote_volume"
WIDE = 16 * D  # slices for hourly bars


def hourly(spark, sf):
    """Hourly bars as the stored table that studies read."""
    return settle(v.bars_1h(spark, sf), "bars")


def quarter_hourly(spark, sf):
    return settle(v.bars_15m(spark, sf), "bars")


@query("a1_bars_from_trades", "SELECT * FROM bars_1h", "symbol ts_ns n_trades", OHLCV)
def _(spark, sf):
    return v.bars_1h(spark, sf)


@query("a2_resample", f"""SELECT symbol, b AS ts_ns, open, high, low, close, volume, quote_volume,
    n_trades, taker_buy_volume, taker_buy_quote_volume FROM (
    SELECT symbol, ts_ns - ts_ns % {4 * H} AS b, min(ts_ns) AS f, max(ts_ns) AS l,
    arg_min(open, ts_ns) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts_ns) AS close, sum(volume) AS volume, sum(quote_volume) AS quote_volume,
    sum(n_trades)::BIGINT AS n_trades, sum(taker_buy_volume) AS taker_buy_volume,
    sum(taker_buy_quote_volume) AS taker_buy_quote_volume FROM bars_1h GROUP BY 1, 2)
    JOIN src USING (symbol) WHERE f = b AND l + interval_ns = b + {4 * H}""",
       "symbol ts_ns n_trades", OHLCV,
       src="""SELECT symbol, min(d) FILTER (d > 0) AS interval_ns FROM (SELECT symbol,
       ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns) AS d FROM bars_1h) GROUP BY 1""")
def _(spark, sf):
    return bars.resample_bars(hourly(spark, sf), 4 * H, width=WIDE)


@query("a3_source_interval", """SELECT symbol, min(d) FILTER (d > 0) AS interval_ns FROM (
    SELECT symbol, ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY ts_ns) AS d
    FROM bars_1h) GROUP BY 1""", "symbol interval_ns")
def _(spark, sf):
    return bars.source_interval(hourly(spark, sf), width=WIDE)


@query("a7_last_per_bucket", f"""SELECT symbol, ts_ns - ts_ns % {H} AS ts_ns,
    arg_max(close, ts_ns) AS close FROM bars_15m GROUP BY ALL""", "symbol ts_ns", "close")
def _(spark, sf):
    return bars.last_per_bucket(v.bars_15m(spark, sf), H)


@query("p16_daily_marks", f"SELECT symbol, ts_ns, close FROM bars_1h WHERE ts_ns % {D} = 0",
       "symbol ts_ns", "close")
def _(spark, sf):
    return bars.daily_marks(v.bars_1h(spark, sf))


# -- rolling features ---------------------------------------------------------------------

@query("w1_ema", "SELECT symbol, ts_ns, ema FROM ema_rows", "symbol ts_ns", "ema",
       numbered="""SELECT symbol, ts_ns, close, row_number() OVER (
       PARTITION BY symbol ORDER BY ts_ns) AS rn FROM bars_1h""",
       ema_rows="""SELECT symbol, ts_ns, rn, close AS ema FROM numbered WHERE rn = 1 UNION ALL
       SELECT n.symbol, n.ts_ns, n.rn, n.close * (2.0::DOUBLE / 21) + (1 - 2.0::DOUBLE / 21) * e.ema
       FROM ema_rows e JOIN numbered n ON n.symbol = e.symbol AND n.rn = e.rn + 1""")
def _(spark, sf):
    return features.ema(hourly(spark, sf), 20, block_rows=256, width=WIDE)


Z_SQL = """SELECT symbol, ts_ns, close, CASE WHEN n = 24 AND sd > 0 THEN (close - m) / sd END AS z
    FROM (SELECT symbol, ts_ns, close, count(*) OVER w AS n, avg(close) OVER w AS m,
    stddev_pop(close) OVER w AS sd FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns
    ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query("w2_zscore", "SELECT * FROM zs", "symbol ts_ns", "z", zs=Z_SQL)
def _(spark, sf):
    return features.zscore(hourly(spark, sf), 24, width=WIDE)


@query("w3_session_vwap", f"""SELECT symbol, ts_ns, CASE WHEN vol <> 0 THEN pv / vol END AS vwap
    FROM (SELECT symbol, ts_ns, sum(close * volume) OVER w AS pv, sum(volume) OVER w AS vol
    FROM bars_1h WINDOW w AS (PARTITION BY symbol, ts_ns // {D} ORDER BY ts_ns
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "symbol ts_ns", "vwap")
def _(spark, sf):
    return features.session_vwap(hourly(spark, sf))


VOL_SQL = """SELECT symbol, ts_ns, close, CASE WHEN count(r) OVER w = 24
    THEN stddev_pop(r) OVER w END AS vol FROM (SELECT *, close / lag(close) OVER (
    PARTITION BY symbol ORDER BY ts_ns) - 1 AS r FROM bars_1h) WINDOW w AS (PARTITION BY symbol
    ORDER BY ts_ns ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


@query("w4_realized_vol", "SELECT * FROM vols", "symbol ts_ns", "vol", vols=VOL_SQL)
def _(spark, sf):
    return features.realized_vol(hourly(spark, sf), 24, width=WIDE)


FLOW_SQL = """SELECT symbol, ts_ns, CASE WHEN n = 12 AND vol <> 0 THEN 2.0::DOUBLE * buy / vol - 1
    END AS flow FROM (SELECT symbol, ts_ns, count(*) OVER w AS n, sum(volume) OVER w AS vol,
    sum(taker_buy_volume) OVER w AS buy FROM bars_1h WINDOW w AS (PARTITION BY symbol
    ORDER BY ts_ns ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("w5_flow_imbalance", "SELECT * FROM flows", "symbol ts_ns", "flow", flows=FLOW_SQL)
def _(spark, sf):
    return features.flow_imbalance(hourly(spark, sf), 12, width=WIDE)


@query("w16_vol_regime", """SELECT symbol, ts_ns, coalesce(last_value(l IGNORE NULLS) OVER (
    PARTITION BY symbol ORDER BY ts_ns), 'low') AS regime FROM (SELECT symbol, ts_ns,
    CASE WHEN vol > m THEN 'high' WHEN vol IS NOT NULL THEN 'low' END AS l
    FROM vols JOIN (SELECT symbol, median(vol) AS m FROM vols GROUP BY 1) USING (symbol))""",
       "symbol ts_ns regime", vols=VOL_SQL)
def _(spark, sf):
    return features.vol_regime(hourly(spark, sf), 24, width=WIDE)


@query("a8_return_volatility", """SELECT symbol, coalesce(stddev_pop(r), 0) * 1e4 AS vol_bps FROM (
    SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS r
    FROM bars_1h) GROUP BY 1""", "symbol", "vol_bps")
def _(spark, sf):
    return features.return_volatility(hourly(spark, sf), width=WIDE)


# -- signals ------------------------------------------------------------------------------

def crossing_sql(source: str, value: str, limit: float, below: str, above: str, name: str) -> str:
    return f"""SELECT symbol, '{name}' AS signal, ts_ns,
    CASE WHEN zone < 0 THEN '{below}' ELSE '{above}' END AS direction FROM (
    SELECT *, coalesce(lag(zone) OVER (PARTITION BY symbol ORDER BY ts_ns), 0) AS was FROM (
    SELECT *, CASE WHEN {value} <= -{limit} THEN -1 WHEN {value} >= {limit} THEN 1 ELSE 0 END
    AS zone FROM {source})) WHERE zone <> 0 AND zone <> was"""


MEANREV_SQL = crossing_sql("zs", "z", 1.5, "buy", "sell", "meanrev")
BREAKOUT_SQL = """SELECT symbol, 'breakout' AS signal, ts_ns, direction FROM (
    SELECT symbol, ts_ns, CASE WHEN count(*) OVER w = 12 AND volume > 1.5 * avg(volume) OVER w THEN
      CASE WHEN close > max(high) OVER w THEN 'buy' WHEN close < min(low) OVER w THEN 'sell' END
    END AS direction FROM bars_1h WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns
    ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) WHERE direction IS NOT NULL"""
FLOWSIG_SQL = crossing_sql("flows", "flow", 0.3, "sell", "buy", "flow")
EVENTS = "symbol signal ts_ns direction"


def meanrev(bars_1h):
    return signals.meanrev(bars_1h, 24, 1.5, width=WIDE)


@query("w6_w7_meanrev_signal", MEANREV_SQL, EVENTS, zs=Z_SQL)
def _(spark, sf):
    return meanrev(hourly(spark, sf))


@query("w8_breakout_signal", BREAKOUT_SQL, EVENTS)
def _(spark, sf):
    return signals.breakout(hourly(spark, sf), 12, 1.5, width=WIDE)


@query("w9_flow_signal", FLOWSIG_SQL, EVENTS, flows=FLOW_SQL)
def _(spark, sf):
    return signals.flow(hourly(spark, sf), 12, 0.3, width=WIDE)


@query("w10_momentum_signal", crossing_sql("moms", "r", 0.02, "sell", "buy", "momentum"), EVENTS,
       moms="""SELECT symbol, ts_ns, close / lag(close, 24) OVER (PARTITION BY symbol
       ORDER BY ts_ns) - 1 AS r FROM bars_1h""")
def _(spark, sf):
    return signals.momentum(hourly(spark, sf), 24, 0.02, width=WIDE)


@query("w11_basis_signal", crossing_sql("bz", "z", 1.5, "buy", "sell", "basis"), EVENTS,
       bz="""SELECT symbol, ts_ns, CASE WHEN n = 24 AND sd > 1e-12 THEN (b - m) / sd END AS z FROM (
       SELECT symbol, ts_ns, b, count(b) OVER w AS n, avg(b) OVER w AS m, stddev_pop(b) OVER w AS sd
       FROM (SELECT pair AS symbol, ts_ns, perp / spot - 1 AS b FROM legs) WINDOW w AS (
       PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""")
def _(spark, sf):
    legs = v.legs(spark, sf).withColumnRenamed("pair", "symbol")
    return signals.basis(legs, 24, 1.5, width=1024 * D)


@query("w13_funding_extreme", """SELECT symbol, 'funding_extreme' AS signal, ts_ns,
    CASE WHEN rate >= 4e-4 THEN 'sell' ELSE 'buy' END AS direction FROM funding
    WHERE abs(rate) >= 4e-4""", EVENTS)
def _(spark, sf):
    return signals.funding_extreme(v.funding(spark, sf), 4e-4)


@query("w23_funding_percentile", """SELECT symbol, 'funding_percentile' AS signal, ts_ns,
    'buy' AS direction FROM (SELECT symbol, ts_ns, rate, count(*) OVER w AS n,
    quantile_cont(rate, 0.9) OVER w AS q, median(rate) OVER w AS m FROM funding
    WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
    WHERE n >= 15 AND rate >= q AND rate > m""", EVENTS)
def _(spark, sf):
    return signals.funding_percentile(v.funding(spark, sf), 30, 90.0)


@query("f1_scan_signals", f"""{MEANREV_SQL} UNION ALL {BREAKOUT_SQL} UNION ALL {FLOWSIG_SQL}""",
       EVENTS, zs=Z_SQL, flows=FLOW_SQL)
def _(spark, sf):
    return scan_events(hourly(spark, sf))


def scan_events(bars_1h):
    return signals.scan_signals(bars_1h, 12, 1.5, 24, 1.5, 12, 0.3, width=WIDE)


# -- event outcomes -----------------------------------------------------------------------

HORIZONS = [H, 2 * H, 6 * H]


def outcome_sql(events: str, source: str = "bars_1h", horizons=HORIZONS) -> str:
    hs = ", ".join(f"({h})" for h in horizons)
    return f"""SELECT e.*, h.h AS horizon_ns,
      CASE WHEN x.ts_ns > b.ts_ns THEN (x.close / b.close - 1) * 1e4 *
        CASE WHEN e.direction = 'buy' THEN 1 ELSE -1 END END AS ret_bps,
      CASE WHEN x.ts_ns > b.ts_ns THEN CASE WHEN e.direction = 'buy' THEN (
        SELECT max(close) FROM {source} q WHERE q.symbol = e.symbol AND q.ts_ns BETWEEN b.ts_ns
        AND e.ts_ns + h.h) / b.close - 1 ELSE 1 - (SELECT min(close) FROM {source} q WHERE
        q.symbol = e.symbol AND q.ts_ns BETWEEN b.ts_ns AND e.ts_ns + h.h) / b.close END * 1e4
        END AS mfe_bps,
      CASE WHEN x.ts_ns > b.ts_ns THEN CASE WHEN e.direction = 'buy' THEN (
        SELECT min(close) FROM {source} q WHERE q.symbol = e.symbol AND q.ts_ns BETWEEN b.ts_ns
        AND e.ts_ns + h.h) / b.close - 1 ELSE 1 - (SELECT max(close) FROM {source} q WHERE
        q.symbol = e.symbol AND q.ts_ns BETWEEN b.ts_ns AND e.ts_ns + h.h) / b.close END * 1e4
        END AS mae_bps
    FROM ({events}) e CROSS JOIN (VALUES {hs}) h(h)
    ASOF LEFT JOIN {source} b ON e.symbol = b.symbol AND e.ts_ns >= b.ts_ns
    ASOF LEFT JOIN {source} x ON e.symbol = x.symbol AND e.ts_ns + h.h >= x.ts_ns"""


TABLE_COLS = """count(*) AS n_events, count(ret_bps) AS n_defined, avg(ret_bps) AS mean_bps,
    median(ret_bps) AS median_bps, avg(CASE WHEN ret_bps > 0 THEN 1.0::DOUBLE
    WHEN ret_bps IS NOT NULL THEN 0.0::DOUBLE END) AS hit_rate, avg(mfe_bps) AS mfe_bps,
    avg(mae_bps) AS mae_bps"""
STATS = "mean_bps median_bps hit_rate mfe_bps mae_bps"


@query("j1_j2_w12_outcomes", outcome_sql("SELECT * FROM evs"),
       "symbol ts_ns direction horizon_ns", "ret_bps mfe_bps mae_bps", evs=MEANREV_SQL, zs=Z_SQL)
def _(spark, sf):
    b = hourly(spark, sf)
    return edge.forward_outcomes(meanrev(b), b, HORIZONS)


@query("j1_asof_ticks_to_bars", f"""SELECT t.symbol, t.ts_ns, t.agg_id, coalesce(b.ts_ns, -1) AS bar_ts,
    b.close AS bar_close FROM ticks t ASOF LEFT JOIN bars_1h b ON t.symbol = b.symbol
    AND t.ts_ns - {H} >= b.ts_ns""", "symbol ts_ns agg_id bar_ts", "bar_close")
def _(spark, sf):
    t = v.ticks(spark, sf).withColumn("_at", F.col("ts_ns") - H)
    b = v.bars_1h(spark, sf).withColumnRenamed("ts_ns", "ts")
    return asof_join(t, b, left_ts="_at", right_ts="ts", values=["ts", "close"],
                     prefix="bar_").withColumn(
        "bar_ts", F.coalesce("bar_ts", F.lit(-1)))


@query("a10_edge_table", f"""SELECT symbol, horizon_ns, {TABLE_COLS} FROM (
    {outcome_sql("SELECT * FROM evs")}) GROUP BY 1, 2""",
       "symbol horizon_ns n_events n_defined", STATS, evs=MEANREV_SQL, zs=Z_SQL)
def edge_by_symbol(spark, sf):
    b = hourly(spark, sf)
    return edge.edge_table(edge.forward_outcomes(meanrev(b), b, HORIZONS), ["symbol"])


COSTS = {"maker_maker": 4.0, "maker_taker": 7.0, "taker_taker": 10.0}
COST_SQL = ", ".join(f"('{k}', {c}::DOUBLE)" for k, c in COSTS.items())


@query("m1_edge_study", f"""SELECT *, mean_bps - round_trip_bps AS edge_bps FROM (
    SELECT signal, horizon_ns, {TABLE_COLS} FROM ({outcome_sql("SELECT * FROM evs")})
    GROUP BY 1, 2) CROSS JOIN (VALUES {COST_SQL}) c(cost, round_trip_bps)""",
       "signal horizon_ns n_events n_defined cost", STATS + " round_trip_bps edge_bps",
       evs=f"{MEANREV_SQL} UNION ALL {BREAKOUT_SQL} UNION ALL {FLOWSIG_SQL}",
       zs=Z_SQL, flows=FLOW_SQL)
def _(spark, sf):
    b = hourly(spark, sf)
    return edge.edge_table(edge.forward_outcomes(scan_events(b), b, HORIZONS), ["signal"], COSTS)


@query("a11_edge_by_session", f"""SELECT CASE WHEN ts_ns // {H} % 24 < 8 THEN '0-8'
    WHEN ts_ns // {H} % 24 < 16 THEN '8-16' ELSE '16-24' END AS label, horizon_ns, {TABLE_COLS}
    FROM ({outcome_sql("SELECT * FROM evs")}) GROUP BY 1, 2""",
       "label horizon_ns n_events n_defined", STATS, evs=MEANREV_SQL, zs=Z_SQL)
def _(spark, sf):
    b = hourly(spark, sf)
    return edge.edge_by_label(meanrev(b), b, HORIZONS, edge.session_label())


@query("p13_session_label", f"""SELECT symbol, agg_id, CASE WHEN ts_ns // {H} % 24 < 8 THEN '0-8'
    WHEN ts_ns // {H} % 24 < 16 THEN '8-16' ELSE '16-24' END AS session FROM ticks""",
       "symbol agg_id session")
def _(spark, sf):
    return v.ticks(spark, sf).withColumn("session", edge.session_label())


@query("a39_every_bar_edge", f"""SELECT symbol, count(ret_bps) AS n_defined,
    CASE WHEN count(ret_bps) >= 5 THEN avg(ret_bps) END AS mean_bps FROM (
    {outcome_sql("SELECT symbol, ts_ns, 'buy' AS direction FROM bars_1h", horizons=[2 * H])})
    GROUP BY 1""", "symbol n_defined", "mean_bps")
def _(spark, sf):
    return edge.every_bar_edge(hourly(spark, sf), 2 * H)


ASSET_EDGE_SQL = """SELECT symbol, score_bps, score_bps - 4 AS edge_net_bps, best_signal,
    coalesce(n, 0) AS n_events, coalesce(n, 0) < 30 AS few_events
    FROM (SELECT DISTINCT symbol FROM bars_1h) LEFT JOIN (SELECT symbol, max(m) AS score_bps,
    arg_max(signal, (m, -o)) FILTER (m IS NOT NULL) AS best_signal, max(n) AS n FROM (
    SELECT symbol, signal, CASE signal WHEN 'breakout' THEN 1 WHEN 'meanrev' THEN 2 ELSE 3 END AS o,
    count(*) AS n, avg(ret_bps) AS m FROM outs GROUP BY 1, 2) GROUP BY 1) USING (symbol)"""
SCAN_CTES = {
    "zs": Z_SQL, "flows": FLOW_SQL,
    "evs": f"{MEANREV_SQL} UNION ALL {BREAKOUT_SQL} UNION ALL {FLOWSIG_SQL}",
    "outs": outcome_sql("SELECT * FROM evs", horizons=[2 * H]),
}


def asset_edges(spark, sf):
    b = hourly(spark, sf)
    return edge.asset_edge(scan_events(b), b, 2 * H)


@query("a12_asset_edge", ASSET_EDGE_SQL, "symbol best_signal n_events few_events",
       "score_bps edge_net_bps", **SCAN_CTES)
def _(spark, sf):
    return asset_edges(spark, sf)


@query("a6_mean_of_daily_sums", f"""SELECT symbol, avg(quote_volume) AS quote_volume_daily,
    avg(n_trades) AS n_trades_daily FROM (SELECT symbol, ts_ns // {D} AS d,
    sum(quote_volume) AS quote_volume, sum(n_trades) AS n_trades FROM bars_1h GROUP BY 1, 2)
    GROUP BY 1""", "symbol", "quote_volume_daily n_trades_daily")
def _(spark, sf):
    return assets.mean_of_daily_sums(v.bars_1h(spark, sf), "quote_volume", "n_trades")


METRICS_SQL = f"""SELECT symbol, n_bars, vol_bps_1m, vol_bps_1h, quote_volume_daily, n_trades_daily,
    coalesce(hits, 0) / greatest(1.0::DOUBLE, n_bars / 1440.0::DOUBLE) AS breakout_freq,
    funding_mean_bps, funding_p95_bps,
    quote_volume_daily < 1000 OR span / {D}.0::DOUBLE < 20 AS dead
    FROM (SELECT symbol, count(*) AS n_bars, max(ts_ns) - min(ts_ns) AS span FROM bars_15m GROUP BY 1)
    JOIN (SELECT symbol, coalesce(stddev_pop(r), 0) * 1e4 AS vol_bps_1m FROM (SELECT symbol,
      close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_ns) - 1 AS r FROM bars_15m)
      GROUP BY 1) USING (symbol)
    JOIN (SELECT symbol, coalesce(stddev_pop(r), 0) * 1e4 AS vol_bps_1h FROM (SELECT symbol,
      close / lag(close) OVER (PARTITION BY symbol ORDER BY h) - 1 AS r FROM (SELECT symbol,
      ts_ns // {H} AS h, arg_max(close, ts_ns) AS close FROM bars_15m GROUP BY 1, 2))
      GROUP BY 1) USING (symbol)
    JOIN (SELECT symbol, avg(q) AS quote_volume_daily, avg(n) AS n_trades_daily FROM (
      SELECT symbol, ts_ns // {D} AS d, sum(quote_volume) AS q, sum(n_trades) AS n
      FROM bars_15m GROUP BY 1, 2) GROUP BY 1) USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) FILTER (hit) AS hits FROM (SELECT symbol,
      count(*) OVER w = 30 AND volume > 2.0 * avg(volume) OVER w AND
      (close > max(high) OVER w OR close < min(low) OVER w) AS hit FROM bars_15m
      WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
      GROUP BY 1) USING (symbol)
    LEFT JOIN (SELECT symbol, avg(rate) * 1e4 AS funding_mean_bps,
      quantile_cont(rate, 0.95) * 1e4 AS funding_p95_bps FROM funding GROUP BY 1) USING (symbol)"""
METRIC_COLS = ("vol_bps_1m vol_bps_1h quote_volume_daily n_trades_daily breakout_freq "
               "funding_mean_bps funding_p95_bps")


def metrics(spark, sf):
    return assets.asset_metrics(quarter_hourly(spark, sf), v.funding(spark, sf), 1000.0, width=4 * D)


@query("a9_asset_metrics", METRICS_SQL, "symbol n_bars dead", METRIC_COLS)
def _(spark, sf):
    return metrics(spark, sf)


@query("m3_universe_scan", """SELECT *, row_number() OVER (ORDER BY edge_net_bps DESC NULLS LAST,
    symbol) AS rank, coalesce(NOT dead AND edge_net_bps > 0 AND NOT few_events, false) AS candidate
    FROM ms JOIN es USING (symbol)""", "symbol n_bars dead rank candidate best_signal few_events",
       METRIC_COLS + " score_bps edge_net_bps", ms=METRICS_SQL, es=ASSET_EDGE_SQL, **SCAN_CTES)
def _(spark, sf):
    return edge.universe_scan(metrics(spark, sf), asset_edges(spark, sf))


SWEEP_W, SWEEP_Z = [12, 24, 48], [1.0, 1.5, 2.0, 9.0]


def _sweep_events() -> str:
    parts = []
    for w in SWEEP_W:
        for z in SWEEP_Z:
            src = f"""(SELECT symbol, ts_ns, CASE WHEN count(*) OVER w = {w} AND
              stddev_pop(close) OVER w > 0 THEN (close - avg(close) OVER w)
              / stddev_pop(close) OVER w END AS z FROM bars_1h WINDOW w AS (PARTITION BY symbol
              ORDER BY ts_ns ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"""
            parts.append(f"SELECT *, {w} AS w, {z}::DOUBLE AS z FROM ("
                         f"{crossing_sql(src, 'z', z, 'buy', 'sell', 'meanrev')})")
    return " UNION ALL ".join(parts)


SWEEP_GRID = ", ".join(f"({w}, {z}::DOUBLE)" for w in SWEEP_W for z in SWEEP_Z)


@query("m2_t1_edge_sweep", f"""SELECT w AS width, z AS entry_z, m AS score_bps, n_events,
    n_events < 100 AS few_events, row_number() OVER (ORDER BY m DESC NULLS LAST, w, z) AS rank
    FROM (SELECT w, z, m, coalesce(n, 0) AS n_events FROM (VALUES {SWEEP_GRID}) g(w, z)
    LEFT JOIN (SELECT w, z, count(*) AS n, avg(ret_bps) AS m FROM outs GROUP BY 1, 2)
    USING (w, z))""", 'width entry_z n_events few_events rank', "score_bps",
       evs=_sweep_events(), outs=outcome_sql("SELECT * FROM evs", horizons=[2 * H]))
def _(spark, sf):
    b = hourly(spark, sf)
    events = signals.meanrev_grid(b, SWEEP_W, SWEEP_Z, width=WIDE)
    grid = spark.createDataFrame([(w, z) for w in SWEEP_W for z in SWEEP_Z],
                                 "width int, entry_z double")
    return edge.edge_sweep(events, b, grid, 2 * H)


@query("m3_skipped_symbols", """SELECT symbol, count(*) AS n_bars, count(*) < 3 AS skipped FROM (
    SELECT 'S' || l_suppkey || '-' || l_linenumber AS symbol FROM lineitem)
    GROUP BY 1""", "symbol n_bars skipped")
def _(spark, sf):
    symbol = F.concat_ws("-", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")),
                         F.col("l_linenumber").cast("string"))
    rows = v.table(spark, sf, "lineitem").select(symbol.alias("symbol"))
    kept, skipped = assets.split_scannable(rows, 3)
    counted = kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    return counted.withColumn("skipped", F.lit(False)).unionByName(
        skipped.withColumn("skipped", F.lit(True)))
