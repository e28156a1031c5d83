"""Queries over cross-section, daily models, performance and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import crosssection as cs
from barlake.operators import flows, lookups, models, performance, resampling
from barlake.operators.quality import rank_in_day
from barlake.plans import table_queries as tq
from barlake.plans import views as v
from barlake.plans.registry import query
from barlake.plans.views import D
from barlake.session import settle

# -- cross-section ------------------------------------------------------------------------

LIQUID = """SELECT symbol, ts_ns, close FROM med JOIN (SELECT ts_ns, list_sort(list(m)
    FILTER (m IS NOT NULL)) AS a FROM med GROUP BY 1) USING (ts_ns)
    WHERE m >= a[(ceil(0.2::DOUBLE * (len(a) - 1)) + 1)::BIGINT]"""
MED = """SELECT symbol, ts_ns, close, CASE WHEN count(*) OVER w >= 7 THEN median(quote_volume) OVER w
    END AS m FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns ROWS BETWEEN 29 PRECEDING
    AND CURRENT ROW)"""


def panel(spark, sf):
    return settle(v.daily(spark, sf), "daily")


@query("w17_liquidity_filter", LIQUID, "symbol ts_ns", "close", med=MED)
def _(spark, sf):
    return cs.liquid(panel(spark, sf))


CELLS = [(7, 1), (14, 7), (30, 7)]
CELL_SQL = ", ".join(f"({a}, {h})" for a, h in CELLS)
CS = {
    "med": MED, "liq": LIQUID,
    "ix": "SELECT *, dense_rank() OVER (ORDER BY ts_ns) AS t FROM liq",
    "want": f"""SELECT symbol, ts_ns, close, lookback, horizon, t - lookback AS tp, t + horizon AS tf
      FROM ix CROSS JOIN (VALUES {CELL_SQL}) c(lookback, horizon)""",
    "rets": """SELECT d.symbol, d.ts_ns, lookback, horizon, d.close / p.close - 1 AS past,
      f.close / d.close - 1 AS forward FROM want d JOIN ix p ON p.symbol = d.symbol AND p.t = d.tp
      JOIN ix f ON f.symbol = d.symbol AND f.t = d.tf""",
    "buckets": """SELECT ts_ns, lookback, horizon, avg(forward) FILTER (n - up < k) * 1e4 AS top_bps,
      avg(forward) FILTER (up <= k) * 1e4 AS bottom_bps,
      avg(forward) FILTER (n - up < kf) * 1e4 AS top_fraction_bps, avg(forward) * 1e4
      AS universe_bps, max(a) AS n_assets FROM (SELECT *, row_number() OVER (PARTITION BY ts_ns,
      lookback, horizon ORDER BY past, symbol) AS up, count(*) OVER (PARTITION BY ts_ns, lookback,
      horizon) AS n, (SELECT count(DISTINCT symbol) FROM liq) AS a,
      greatest(1, floor((SELECT count(DISTINCT symbol) FROM liq) / 5)) AS k,
      greatest(1, floor((SELECT count(DISTINCT symbol) FROM liq) * 0.2::DOUBLE)) AS kf FROM rets)
      WHERE n >= 2 GROUP BY 1, 2, 3""",
}


def nw_sql(source: str, keys: str, value: str = "net", lag: str = "20") -> str:
    """Newey-West t per key, by self-join of the demeaned series."""
    using = ", ".join(keys.split())
    eq = " AND ".join(f"a.{k} = b.{k}" for k in keys.split())
    grp = ", ".join(f"a.{k}" for k in keys.split())
    return f"""SELECT {using}, CASE WHEN n >= lag + 2 AND (g0 + coalesce(g, 0)) / n > 0
      THEN m / sqrt((g0 + coalesce(g, 0)) / n / n) END AS t FROM (
      SELECT {using}, count(*) AS n, avg(x) AS m, sum(d * d) AS g0, max(lag) AS lag FROM
        (SELECT *, x - avg(x) OVER (PARTITION BY {using}) AS d FROM (SELECT {using},
         {value} AS x, {lag} AS lag FROM {source})) GROUP BY {using})
      LEFT JOIN (SELECT {grp}, sum(2 * (1 - (a.i - b.i) / (a.lag + 1.0::DOUBLE)) * a.d * b.d) AS g
        FROM dev_{source} a JOIN dev_{source} b ON {eq} AND a.i > b.i AND a.i - b.i <= a.lag
        GROUP BY {grp}) USING ({using})"""


def dev_sql(source: str, keys: str, value: str = "net", lag: str = "20") -> str:
    using = ", ".join(keys.split())
    return f"""SELECT {using}, {lag} AS lag, {value} - avg({value}) OVER (PARTITION BY {using}) AS d,
      row_number() OVER (PARTITION BY {using} ORDER BY ts_ns) AS i FROM {source}"""


SPREADS = """SELECT *, {gross} - cost_bps AS spread FROM buckets
    CROSS JOIN (VALUES (0.0::DOUBLE), (20.0::DOUBLE)) c(cost_bps)"""
SPREAD_STATS = """SELECT lookback, horizon, cost_bps, count(*) AS n_dates, max(n_assets) AS n_assets,
    avg(top_bps) AS top_mean_bps, avg(bottom_bps) AS bottom_mean_bps, avg(top_fraction_bps)
    AS top_fraction_mean_bps, avg(universe_bps) AS universe_mean_bps, avg(spread)
    AS spread_mean_bps, median(spread) AS spread_median_bps, avg((spread > 0)::INT::DOUBLE)
    AS hit_rate FROM spreads GROUP BY 1, 2, 3"""
SPREAD_COLS = ("cost_bps top_mean_bps bottom_mean_bps top_fraction_mean_bps universe_mean_bps "
               "spread_mean_bps spread_median_bps hit_rate")
LAGS = "greatest(1, horizon - 1)"
KEYS3 = "lookback horizon cost_bps"


def _cs(gross: str) -> dict[str, str]:
    return {**CS, "spreads": SPREADS.format(gross=gross), "stats": SPREAD_STATS,
            "dev_spreads": dev_sql("spreads", KEYS3, "spread", LAGS),
            "nw": nw_sql("spreads", KEYS3, "spread", LAGS)}


@query("a29_w18_j7_bucket_returns", "SELECT * FROM buckets", "ts_ns lookback horizon n_assets",
       "top_bps bottom_bps top_fraction_bps universe_bps", **CS)
def _(spark, sf):
    return cs.bucket_returns(cs.liquid(panel(spark, sf)), CELLS)


@query("m4_a24_a29_cross_section_study", f"""SELECT s.*, nw.t AS t_stat FROM stats s JOIN nw
    USING ({KEYS3.replace(' ', ', ')})""", "lookback horizon n_dates n_assets", SPREAD_COLS,
       "t_stat", **_cs("top_bps - bottom_bps"))
def _(spark, sf):
    return cs.cross_section_study(panel(spark, sf), CELLS, [0.0, 20.0])


@query("a30_top_minus_universe", f"""SELECT s.*, nw.t AS t_stat FROM stats s JOIN nw
    USING ({KEYS3.replace(' ', ', ')})""", "lookback horizon n_dates n_assets", SPREAD_COLS,
       "t_stat", **_cs("top_fraction_bps - universe_bps"))
def _(spark, sf):
    return cs.cross_section_study(panel(spark, sf), CELLS, [0.0, 20.0], kind="top")


@query("w18_rank_in_day", """SELECT symbol, ts_ns, row_number() OVER (PARTITION BY ts_ns
    ORDER BY close, symbol) AS rank FROM daily""", "symbol ts_ns rank")
def _(spark, sf):
    return rank_in_day(v.daily(spark, sf), "close")


# -- trend --------------------------------------------------------------------------------

TREND = [models.TrendCell(f"{m}_{n}", n, m, 7.0) for m in ("long_short", "long_flat")
         for n in (20, 60)] + [models.TrendCell("buy_hold", 1, "buy_hold", 7.0)]


def trend(spark, sf):
    legs = settle(v.legs(spark, sf), "legs")
    closes = legs.select(F.lit("SPOT").alias("symbol"), "ts_ns", F.col("spot").alias("close")
                         ).unionByName(legs.select(F.lit("PERP").alias("symbol"), "ts_ns",
                                                   F.col("perp").alias("close")))
    perp = closes.where("symbol = 'PERP'").withColumn("open", F.col("close"))
    marked = lookups.funding_marks(v.leg_funding(spark, sf).withColumn("symbol", F.lit("PERP")), perp, D).select(
        "symbol", "ts_ns", (F.col("rate") * F.col("mark")).alias("amount"))
    return settle(models.trend_model(closes, marked, TREND), "trend")


TREND_SQL = {
    "closes": """SELECT 'SPOT' AS symbol, ts_ns, spot AS close FROM legs
      UNION ALL SELECT 'PERP', ts_ns, perp FROM legs""",
    "cells": "SELECT * FROM (VALUES " + ", ".join(
        f"('{c.name}', {c.lookback}, '{c.mode}')" for c in TREND) + ") c(cell, lookback, mode)",
    "base": f"""SELECT c.*, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS rn,
      lead(close) OVER (PARTITION BY symbol ORDER BY ts_ns) AS nxt, coalesce((SELECT
      sum(amount) FROM owed f WHERE c.symbol = 'PERP' AND f.ts_ns > c.ts_ns
      + {D} AND f.ts_ns <= c.ts_ns + {2 * D}), 0) AS paid FROM closes c""",
    "owed": f"""SELECT f.ts_ns, rate * coalesce(b.perp, a.perp) AS amount FROM leg_funding f
      LEFT JOIN legs a ON a.ts_ns = f.ts_ns // {D} * {D} LEFT JOIN legs b ON b.ts_ns = a.ts_ns - {D}""",
    "pos": """SELECT b.symbol, cell, b.rn, b.ts_ns, b.nxt / b.close - 1 AS m, b.paid / b.close AS fr,
      CASE WHEN mode = 'buy_hold' THEN 1.0::DOUBLE WHEN p.close IS NULL THEN 0.0::DOUBLE
      WHEN mode = 'long_short' THEN sign(b.close / p.close - 1)::DOUBLE
      WHEN b.close / p.close - 1 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p
      FROM base b CROSS JOIN cells LEFT JOIN base p ON p.symbol = b.symbol
      AND p.rn = b.rn - lookback WHERE b.nxt IS NOT NULL""",
    "trend": """SELECT symbol, cell, rn, ts_ns, m, p, -p * fr AS funding, abs(p) AS turnover,
      p * m - p * fr - abs(p) * 7e-4::DOUBLE AS net FROM pos WHERE rn = 1 UNION ALL
      SELECT q.symbol, q.cell, q.rn, q.ts_ns, q.m, q.p, -q.p * q.fr,
      abs(q.p - t.p * (1 + t.m) / (1 + t.net)), q.p * q.m - q.p * q.fr
      - abs(q.p - t.p * (1 + t.m) / (1 + t.net)) * 7e-4::DOUBLE
      FROM trend t JOIN pos q ON q.symbol = t.symbol AND q.cell = t.cell AND q.rn = t.rn + 1""",
    "trend_days": """SELECT symbol, cell, ts_ns, net, abs(p) AS exposure, turnover, p * m AS gross,
      turnover * 7e-4::DOUBLE AS fee, funding FROM trend""",
}
PARTS = "net exposure turnover gross fee funding"


@query("m5_j5_trend_model", "SELECT * FROM trend_days", "symbol cell ts_ns", PARTS, **TREND_SQL)
def _(spark, sf):
    return trend(spark, sf)


def summary_sql(source: str, keys: str) -> str:
    k = ", ".join(keys.split())
    return f"""SELECT *, t AS t_stat_nw FROM (SELECT {k}, count(*) AS n_days,
      exp(sum(ln(1 + net))) - 1 AS total_return, exp(sum(ln(1 + net))) ^ (365.0::DOUBLE / count(*)) - 1
      AS cagr, coalesce(stddev_samp(net), 0) * sqrt(365.0::DOUBLE) AS volatility,
      CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(365.0::DOUBLE) END
      AS sharpe, greatest(0, max(dd)) AS max_drawdown, avg(exposure) AS average_exposure,
      avg((exposure > 0)::INT::DOUBLE) AS fraction_exposed, sum(turnover) AS turnover_units,
      sum(turnover) / (count(*) / 365.0::DOUBLE) AS annual_turnover_units, sum(gross) * 1e4
      AS gross_bps, sum(fee) * 1e4 AS fees_bps, sum(funding) * 1e4 AS funding_bps FROM (
      SELECT *, 1 - g / greatest(1, max(g) OVER (PARTITION BY {k} ORDER BY ts_ns)) AS dd FROM (
      SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY {k} ORDER BY ts_ns)) AS g FROM {source}))
      GROUP BY {k}) JOIN ({nw_sql(source, keys)}) USING ({k})"""


SUMMARY = ("total_return cagr volatility max_drawdown average_exposure fraction_exposed "
           "turnover_units annual_turnover_units gross_bps fees_bps funding_bps")


@query("a25_w15_daily_summary", summary_sql("trend_days", "symbol cell"), "symbol cell n_days",
       SUMMARY, "sharpe t_stat_nw", dev_trend_days=dev_sql("trend_days", "symbol cell"),
       **TREND_SQL)
def _(spark, sf):
    return performance.daily_summary(trend(spark, sf), ["symbol", "cell"])


EQUAL = """SELECT cell, ts_ns, avg(net) AS net, avg(exposure) AS exposure, avg(turnover) AS turnover,
    avg(gross) AS gross, avg(fee) AS fee, avg(funding) AS funding FROM trend_days GROUP BY 1, 2"""


@query("a27_equal_weight", summary_sql("equal", "cell"), "cell n_days", SUMMARY,
       "sharpe t_stat_nw", equal=EQUAL, dev_equal=dev_sql("equal", "cell"), **TREND_SQL)
def _(spark, sf):
    days = settle(performance.equal_weight(trend(spark, sf), ["cell"]), "portfolio")
    return performance.daily_summary(days, ["cell"])


SPLIT = tq.CUT
PERIOD = f"CASE WHEN ts_ns < {SPLIT} THEN 'IS' ELSE 'OOS' END"


@query("m6_t3_trend_study", """SELECT s.*, s.cell = b.cell AS selected FROM summary s JOIN (
    SELECT arg_min(cell, cell) AS cell FROM summary WHERE period = 'IS' AND sharpe = (
    SELECT max(sharpe) FROM summary WHERE period = 'IS')) b ON true""",
       "cell period n_days selected", SUMMARY, "sharpe t_stat_nw", **TREND_SQL, equal=EQUAL,
       by_period=f"SELECT *, {PERIOD} AS period FROM equal",
       dev_by_period=dev_sql("by_period", "cell period"),
       summary=summary_sql("by_period", "cell period"))
def _(spark, sf):
    period = F.when(F.col("ts_ns") < SPLIT, "IS").otherwise("OOS")
    days = performance.equal_weight(trend(spark, sf), ["cell"]).withColumn("period", period)
    table = settle(performance.daily_summary(settle(days, "days"), ["cell", "period"]), "summary")
    best = models.best_per_group(table.where("period = 'IS'"), ["period"], "sharpe", ["cell"])
    chosen = best.select(F.col("cell").alias("_best"))
    return table.crossJoin(F.broadcast(chosen)).withColumn(
        "selected", F.col("cell") == F.col("_best"))


@query("w24_turnover", """SELECT symbol, cell, ts_ns, abs(p - coalesce(lag(p) OVER (
    PARTITION BY symbol, cell ORDER BY ts_ns), 0)) AS change FROM trend""", "symbol cell ts_ns",
       "change", **TREND_SQL)
def _(spark, sf):
    from pyspark.sql import Window as W

    from barlake.operators.features import turnover

    w = W.partitionBy("symbol", "cell").orderBy("ts_ns")
    return trend(spark, sf).withColumn("change", turnover("position", w))


# -- cash and carry -----------------------------------------------------------------------

CARRY = [
    models.CarryCell("week", 7, 3.3e-4, -3.3e-4, -1e-4, -2.2e-3, 10.0, 5.0),
    models.CarryCell("month", 30, 1.03e-3, -1.03e-3, -6e-4, -2.2e-3, 10.0, 5.0),
    models.CarryCell("always", 7, 0.0, 0.0, 0.0, 0.0, 10.0, 5.0, "always"),
]


def carry(spark, sf):
    legs = settle(v.legs(spark, sf), "legs")
    return settle(models.carry_model(legs, v.leg_funding(spark, sf), CARRY), "carry")


CARRY_SQL = {
    "cells": "SELECT * FROM (VALUES " + ", ".join(
        f"('{c.name}', {c.lookback}, {c.entry_funding}::DOUBLE, {c.exit_funding}::DOUBLE, "
        f"{c.entry_basis}::DOUBLE, {c.exit_basis}::DOUBLE, '{c.mode}')" for c in CARRY)
    + ") c(cell, lb, ef, xf, eb, xb, mode)",
    "paid": f"""SELECT (ts_ns - 1) // {D} * {D} AS ts_ns, sum(rate) AS r FROM leg_funding GROUP BY 1""",
    "ld": """SELECT l.*, coalesce(r, 0) AS r, row_number() OVER (ORDER BY l.ts_ns) AS rn
      FROM legs l LEFT JOIN paid USING (ts_ns)""",
    "inp": """SELECT a.rn, a.ts_ns, cell, a.spot, a.perp, b.spot AS ns, b.perp AS np, b.r AS nr,
      a.rn < lb AS warm, (SELECT sum(r) FROM ld x WHERE x.rn > a.rn - lb AND x.rn <= a.rn) AS tr,
      a.perp / a.spot - 1 AS basis, ef, xf, eb, xb, mode
      FROM ld a JOIN ld b ON b.rn = a.rn + 1 CROSS JOIN cells""",
    "walk": """SELECT 0::BIGINT AS rn, 0::BIGINT AS ts_ns, cell, 0.0::DOUBLE AS q, false AS held,
      1.0::DOUBLE AS eq, 1.0::DOUBLE AS eq0, 0.0::DOUBLE AS pr, 0.0::DOUBLE AS fu, 0.0::DOUBLE AS fe
      FROM cells UNION ALL
      SELECT rn, ts_ns, cell, q, target, eq - fe + pr + fu, eq, pr, fu, fe FROM (
        SELECT *, CASE WHEN target THEN q * ((ns - spot) - (np - perp)) ELSE 0 END AS pr,
          CASE WHEN target THEN q * perp * nr ELSE 0 END AS fu,
          CASE WHEN target <> held THEN q * (spot * 10 + perp * 5) / 1e4 ELSE 0 END AS fe FROM (
          SELECT *, CASE WHEN target AND NOT held THEN eq / (spot + perp) ELSE q0 END AS q FROM (
            SELECT i.*, w.held, w.eq, w.q AS q0, CASE WHEN warm THEN false
              WHEN mode = 'always' THEN true
              WHEN w.held THEN NOT (tr <= xf OR basis <= xb)
              ELSE tr >= ef AND basis >= eb END AS target
            FROM walk w JOIN inp i ON i.cell = w.cell AND i.rn = w.rn + 1)))""",
    "carry_days": f"""SELECT cell, ts_ns + {D} AS ts_ns, held::INT::DOUBLE AS exposure,
      (fe <> 0)::INT::DOUBLE AS turnover, pr / eq0 AS gross, fu / eq0 AS funding, fe / eq0 AS fee,
      eq / eq0 - 1 AS net FROM walk WHERE rn > 0""",
}


@query("m7_w21_w22_carry_model", "SELECT * FROM carry_days", "cell ts_ns", PARTS, **CARRY_SQL)
def _(spark, sf):
    return carry(spark, sf)


@query("m8_carry_study", summary_sql("by_period", "cell period"), "cell period n_days", SUMMARY,
       "sharpe t_stat_nw", by_period=f"SELECT *, {PERIOD} AS period FROM carry_days",
       dev_by_period=dev_sql("by_period", "cell period"), **CARRY_SQL)
def _(spark, sf):
    period = F.when(F.col("ts_ns") < SPLIT, "IS").otherwise("OOS")
    days = carry(spark, sf).withColumn("period", period)
    return performance.daily_summary(days, ["cell", "period"])


# -- flow screen --------------------------------------------------------------------------

NET_SQL = {
    "degrees": tq.DEGREES, "hubs": tq.HUBS, "daily_flows": tq.FLOWS,
    "kept": f"""SELECT f.*, l.ts_ns, l.spot AS close FROM daily_flows f JOIN legs l
      ON epoch_ns(f.day::TIMESTAMP) = l.ts_ns WHERE l.ts_ns + {D} IN (SELECT ts_ns FROM legs)""",
    "cal": f"""SELECT quantile_cont(deposit - withdraw, 0.9) AS entry, quantile_cont(deposit
      - withdraw, 0.25) AS exit FROM kept WHERE ts_ns < {SPLIT} AND deposit - withdraw > 0""",
    "netted": """SELECT *, CASE WHEN count(*) OVER w = 3 THEN sum(deposit) OVER w - sum(withdraw) OVER w
      END AS nf, row_number() OVER (ORDER BY ts_ns) AS rn, lead(close) OVER (ORDER BY ts_ns) AS nx
      FROM kept CROSS JOIN cal WINDOW w AS (ORDER BY ts_ns ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "state": """SELECT 0::BIGINT AS rn, false AS held, false AS was UNION ALL SELECT n.rn, CASE
      WHEN nf IS NULL THEN false WHEN held AND abs(nf) <= n.exit THEN false WHEN NOT held AND
      nf >= n.entry THEN true ELSE held END, held FROM state s JOIN netted n ON n.rn = s.rn + 1""",
    "screen": """SELECT 'hubs' AS "set", ts_ns, coalesce(nf, 0) AS net_flow, CASE WHEN held THEN
      -1.0::DOUBLE ELSE 0.0::DOUBLE END AS position, held::INT::DOUBLE AS exposure,
      (held <> was)::INT::DOUBLE AS turnover, CASE WHEN held THEN -1 ELSE 0 END
      * coalesce(nx / close - 1, 0) AS gross, CASE WHEN held <> was THEN 10 / 1e4 ELSE 0 END AS fee,
      0.0::DOUBLE AS funding, CASE WHEN held THEN -1 ELSE 0 END * coalesce(nx / close - 1, 0)
      - CASE WHEN held <> was THEN 10 / 1e4 ELSE 0 END AS net FROM netted JOIN state USING (rn)""",
}


def flow_days(spark, sf):
    f = flows.daily_flows(v.transfers(spark, sf), tq.hubs(spark, sf), tq.FROM, tq.TO)
    day = F.unix_date("day").cast("bigint") * D
    legs = settle(v.legs(spark, sf), "legs")
    rows = lookups.present_today_and_tomorrow(f.withColumn("ts_ns", day), legs)
    kept = settle(rows.join(legs.select("ts_ns", F.col("spot").alias("close")), "ts_ns"), "flows")
    cal = flows.calibrate_entry(kept.where(F.col("ts_ns") < SPLIT).withColumn(
        "_net", F.col("deposit") - F.col("withdraw")), "_net", 0.9)
    return models.flow_screen(kept.crossJoin(F.broadcast(cal)).withColumn("set", F.lit("hubs")),
                              3, 10.0)


@query("m9_flow_screen", "SELECT * FROM screen", "ts_ns position", "net_flow " + PARTS, **NET_SQL)
def _(spark, sf):
    return flow_days(spark, sf)


@query("m10_flow_study", summary_sql("by_period", "period"), "period n_days", SUMMARY,
       "sharpe t_stat_nw", by_period=f"SELECT *, {PERIOD} AS period FROM screen",
       dev_by_period=dev_sql("by_period", "period"), **NET_SQL)
def _(spark, sf):
    period = F.when(F.col("ts_ns") < SPLIT, "IS").otherwise("OOS")
    days = settle(flow_days(spark, sf).withColumn("period", period).select(
        "period", "ts_ns", *PARTS.split()), "screen")
    return performance.daily_summary(days, ["period"])


# -- resampling ---------------------------------------------------------------------------

def draw_sql(n: str, *parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % ({n}))"


@query("a33_block_bootstrap", """SELECT cell, quantile_cont(final, 0.01) AS p01,
    quantile_cont(final, 0.05) AS p05, quantile_cont(final, 0.25) AS p25, median(final) AS median,
    quantile_cont(final, 0.75) AS p75, quantile_cont(final, 0.95) AS p95,
    avg((final < 0)::INT::DOUBLE) AS prob_final_negative,
    avg((dd > 0.02)::INT::DOUBLE) AS prob_dd_over_2pct,
    avg((dd > 0.05)::INT::DOUBLE) AS prob_dd_over_5pct FROM (SELECT cell, sim,
    arg_max(g, step) - 1 AS final, max(1 - g / greatest(1, pk)) AS dd FROM (SELECT *, max(g) OVER (
    PARTITION BY cell, sim ORDER BY step) AS pk FROM (SELECT cell, sim, step, exp(sum(ln(1 + net))
    OVER (PARTITION BY cell, sim ORDER BY step)) AS g FROM draws JOIN nums USING (cell, i)))
    GROUP BY 1, 2) GROUP BY 1""", "cell",
       "p01 p05 p25 median p75 p95 prob_final_negative prob_dd_over_2pct prob_dd_over_5pct",
       nums="""SELECT cell, net, row_number() OVER (PARTITION BY cell ORDER BY ts_ns) - 1 AS i
       FROM carry_days""",
       draws=f"""SELECT cell, sim, step, {draw_sql('n - 19', "'7'", 'sim::VARCHAR',
                                                   '(step // 20)::VARCHAR')} + step % 20 AS i
       FROM (SELECT cell, count(*) AS n FROM carry_days GROUP BY 1)
       CROSS JOIN (SELECT unnest(range(100)) AS sim) CROSS JOIN (SELECT unnest(range(90)) AS step)""",
       **CARRY_SQL)
def _(spark, sf):
    return resampling.block_bootstrap(carry(spark, sf), 100, 90, 7)
