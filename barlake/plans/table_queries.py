"""Queries over scalars, quality checks, lookups and transfer networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.functions import scalars as fn
from barlake.operators import flows, lookups, quality
from barlake.operators.asof import asof_join
from barlake.plans import views as v
from barlake.plans.registry import query
from barlake.plans.views import D, H

# -- scalars ------------------------------------------------------------------------------

MIXED = """SELECT agg_id, CASE agg_id % 5 WHEN 0 THEN ts_ns WHEN 1 THEN ts_ns // 1000
    WHEN 2 THEN ts_ns // 1000000 WHEN 3 THEN ts_ns // 1000000000 ELSE -1 END AS raw FROM ticks"""
SCALE = """CASE WHEN raw >= 1000000000000000000 THEN 1 WHEN raw >= 1000000000000000 THEN 1000
    WHEN raw >= 1000000000000 THEN 1000000 END"""


@query("p1_normalize_ts", f"""SELECT agg_id, coalesce(raw * {SCALE}, -1) AS ts_ns
    FROM mixed""", "agg_id ts_ns",
       mixed=MIXED)
def _(spark, sf):
    k, ts = F.col("agg_id") % 5, F.col("ts_ns")
    raw = (F.when(k == 0, ts).when(k == 1, F.call_function("div", ts, F.lit(1000)))
           .when(k == 2, F.call_function("div", ts, F.lit(1000000)))
           .when(k == 3, F.call_function("div", ts, F.lit(1000000000))).otherwise(-1))
    return v.ticks(spark, sf).select("agg_id", F.coalesce(
        fn.normalize_ts(raw), F.lit(-1)).alias("ts_ns"))


@query("p2_normalize_ts_per_file", """SELECT agg_id, ts * CASE WHEN max(ts) OVER (PARTITION BY f)
    >= 1000000000000000000 THEN 1 WHEN max(ts) OVER (PARTITION BY f) >= 1000000000000000 THEN 1000
    ELSE 1000000 END AS ts FROM (SELECT agg_id, symbol AS f, CASE WHEN symbol IN ('view', 'click')
    THEN ts_ns // 1000 WHEN symbol = 'error' THEN ts_ns // 1000000 ELSE ts_ns END AS ts
    FROM ticks)""", "agg_id ts")
def _(spark, sf):
    s = F.col("symbol")
    ts = (F.when(s.isin("view", "click"), F.call_function("div", F.col("ts_ns"), F.lit(1000)))
          .when(s == "error", F.call_function("div", F.col("ts_ns"), F.lit(1000000)))
          .otherwise(F.col("ts_ns")))
    rows = v.ticks(spark, sf).select("agg_id", s.alias("f"), ts.alias("ts"))
    return fn.normalize_ts_per_file(rows, "ts", "f")


@query("p3_p4_interval_bucket", """SELECT agg_id, n, ts_ns - ts_ns % n AS start FROM (
    SELECT agg_id, ts_ns, CASE agg_id % 3 WHEN 0 THEN 1000000000::BIGINT * 5
    WHEN 1 THEN 60000000000::BIGINT * 15 ELSE 3600000000000::BIGINT END AS n FROM ticks)""",
       "agg_id n start")
def _(spark, sf):
    k = F.col("agg_id") % 3
    text = F.when(k == 0, "5s").when(k == 1, "15m").otherwise("1h")
    t = v.ticks(spark, sf).withColumn("n", fn.interval_ns(text))
    return t.withColumn("start", F.col("ts_ns") - F.col("ts_ns") % F.col("n"))


@query("p5_day_hour_number", f"SELECT agg_id, ts_ns // {D} AS day, ts_ns // {H} AS hour FROM ticks",
       "agg_id day hour")
def _(spark, sf):
    return v.ticks(spark, sf).select("agg_id", fn.day_number("ts_ns").alias("day"),
                                     fn.hour_number("ts_ns").alias("hour"))


@query("p6_period_filter", """SELECT symbol, ts_ns, close FROM bars_1h WHERE ts_ns BETWEEN
    epoch_ns(TIMESTAMP '2024-01-05') AND epoch_ns(TIMESTAMP '2024-01-11') - 1""",
       "symbol ts_ns", "close")
def _(spark, sf):
    return v.bars_1h(spark, sf).where(fn.in_period("ts_ns", "2024-01-05", "2024-01-10"))


DOWN_P = "(round(price * 100000)::BIGINT // 1000) / 100.0::DOUBLE"
DOWN_Q = "(round(qty * 1000)::BIGINT // 500) * 500 / 1000.0::DOUBLE"


@query("p7_round_down", f"SELECT agg_id, {DOWN_Q} AS qty, {DOWN_P} AS price FROM ticks",
       "agg_id", "qty price")
def _(spark, sf):
    return v.ticks(spark, sf).select("agg_id", fn.round_down("qty", 0.5).alias("qty"),
                                     fn.round_down("price", 0.01).alias("price"))


@query("p8_order_filters", f"""SELECT agg_id, CASE WHEN q <= 0 THEN 'qty must be positive'
    WHEN dq <= 0 THEN 'qty rounds to zero' WHEN dq * dp < 300 THEN 'notional below min' END
    AS reason FROM (SELECT agg_id, qty - 1.2 AS q, price, (round((qty - 1.2) * 1000)::BIGINT // 500)
    * 500 / 1000.0::DOUBLE AS dq, {DOWN_P} AS dp FROM ticks)""", "agg_id reason")
def _(spark, sf):
    t = v.ticks(spark, sf)
    return t.select("agg_id", fn.order_filter_reason(
        F.round(F.col("qty") - 1.2, 6), "price", 0.5, 0.01, 300.0).alias("reason"))


@query("p9_order_rows", """SELECT order_id, CASE WHEN q <= 0 THEN 'qty must be positive'
    WHEN type = 'limit' AND limit_price IS NULL THEN 'limit order without limit price'
    WHEN type = 'market' AND lp IS NOT NULL THEN 'market order with limit price'
    WHEN type = 'stop' AND sp IS NULL THEN 'stop order without stop price'
    WHEN order_id % 7 = 0 AND type <> 'limit' THEN 'post-only needs a limit order' END AS reason
    FROM (SELECT *, qty - 6 AS q, CASE WHEN order_id % 11 = 0 THEN 1.0 ELSE limit_price END AS lp,
    CASE WHEN order_id % 4 = 0 THEN NULL ELSE stop_price END AS sp FROM order_book_orders)""",
       "order_id reason")
def _(spark, sf):
    o = v.order_book_orders(spark, sf).withColumns({
        "qty": F.col("qty") - 6, "post_only": F.col("order_id") % 7 == 0,
        "limit_price": F.when(F.col("order_id") % 11 == 0, 1.0).otherwise(F.col("limit_price")),
        "stop_price": F.when(F.col("order_id") % 4 != 0, F.col("stop_price"))})
    return o.select("order_id", fn.order_row_reason().alias("reason"))


@query("p10_p11_p12_costs", """SELECT agg_id, price * qty * CASE WHEN buyer_is_maker THEN 2.0::DOUBLE
    ELSE 5.0::DOUBLE END / 1e4::DOUBLE AS fee, CASE WHEN buyer_is_maker THEN 7.0::DOUBLE
    ELSE 10.0::DOUBLE END AS round_trip, price * (1 + CASE WHEN agg_id % 2 = 0 THEN 1 ELSE -1 END
    * 1.5::DOUBLE / 1e4::DOUBLE) AS slipped FROM ticks""", "agg_id", "fee round_trip slipped")
def _(spark, sf):
    role = F.when(F.col("buyer_is_maker"), "maker").otherwise("taker")
    side = F.when(F.col("agg_id") % 2 == 0, "buy").otherwise("sell")
    return v.ticks(spark, sf).select(
        "agg_id", fn.fee(role, F.col("price") * F.col("qty"), 2.0, 5.0).alias("fee"),
        fn.round_trip_bps(role, F.lit("taker"), 2.0, 5.0).alias("round_trip"),
        fn.slipped("price", side, 1.5).alias("slipped"))


@query("p14_p15_quantities", """SELECT ts_ns, 10000 * 0.4::DOUBLE / (spot + perp) AS hedge,
    10000 * 0.4::DOUBLE / (spot + perp) * 2.5 AS scaled FROM legs""", "ts_ns", "hedge scaled")
def _(spark, sf):
    legs = v.legs(spark, sf).withColumn("hedge", fn.hedge_qty(0.4, F.lit(10000.0), "spot", "perp"))
    return legs.withColumn("scaled", fn.scaled_qty("hedge", 2.5))


@query("p17_p21_names", """SELECT o_orderkey, regexp_full_match(upper(o_orderpriority),
    '[A-Z0-9]{4,20}') AS symbol_ok, regexp_full_match(strftime(o_orderdate, '%Y-%m'),
    '\\d{4}-\\d{2}') AS month_ok, strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
       "o_orderkey symbol_ok month_ok month")
def _(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM")
    path = F.concat(F.lit("/data/um/klines/"), F.col("o_orderpriority"), F.lit("-1m-"), month,
                    F.lit(".parquet"))
    return v.table(spark, sf, "orders").select(
        "o_orderkey", fn.is_symbol(F.upper("o_orderpriority")).alias("symbol_ok"),
        fn.is_month(month).alias("month_ok"), fn.month_of_stem(path).alias("month"))


@query("p18_checksum_token", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN
    sha256(o_orderkey::VARCHAR) END AS token FROM orders""", "o_orderkey token")
def _(spark, sf):
    digest = F.upper(F.sha2(F.col("o_orderkey").cast("string"), 256))
    text = F.when(F.col("o_orderkey") % 3 > 0, F.concat(digest, F.lit("  BTC-1m.zip"))).otherwise(
        F.concat(F.substring(digest, 1, 60), F.lit(" BTC-1m.zip")))
    return v.table(spark, sf, "orders").select("o_orderkey", fn.checksum_token(text).alias("token"))


@query("p19_time_texts", """SELECT agg_id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M')
    AS text, make_timestamp(ts_ns // 1000)::DATE AS day,
    (make_timestamp(ts_ns // 1000)::DATE + 1)::DATE AS next_day FROM ticks""",
       "agg_id text day next_day")
def _(spark, sf):
    return v.ticks(spark, sf).select("agg_id", fn.ts_text("ts_ns").alias("text"),
                                     fn.ts_date("ts_ns").alias("day"),
                                     fn.next_day("ts_ns").alias("next_day"))


@query("p20_fingerprint", """SELECT o_orderkey, sha256('{"capital":"' || o_custkey || '","legs":"'
    || o_orderstatus || '","symbol":"' || o_orderpriority || '"}') AS fingerprint FROM orders""",
       "o_orderkey fingerprint")
def _(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", fn.fingerprint({
        "symbol": F.col("o_orderpriority"), "capital": F.col("o_custkey").cast("string"),
        "legs": F.col("o_orderstatus")}).alias("fingerprint"))


@query("p22_p23_margin", """SELECT agg_id, CASE WHEN p > 0 THEN (q * e - b) / (q * 0.995)
    WHEN p < 0 THEN (b + q * e) / (q * 1.005) END AS liquidation_price, b + (price - e) * p
    AS equity, p <> 0 AND b + (price - e) * p <= 0.005 * q * price AS liquidated
    FROM (SELECT *, abs(p) AS q FROM (SELECT agg_id, price, CASE WHEN agg_id % 9 = 0 THEN 0.0::DOUBLE
    WHEN buyer_is_maker THEN -qty ELSE qty END AS p, 103.0::DOUBLE AS e, qty * 3.0::DOUBLE AS b
    FROM ticks))""", "agg_id liquidated", "liquidation_price equity")
def _(spark, sf):
    p = F.when(F.col("agg_id") % 9 == 0, 0.0).when(F.col("buyer_is_maker"), -F.col("qty")).otherwise(
        F.col("qty"))
    t = v.ticks(spark, sf).withColumns({"p": p, "e": F.lit(103.0), "b": F.col("qty") * 3.0})
    return t.select("agg_id", fn.liquidation_price("p", "e", "b", 0.005).alias("liquidation_price"),
                    fn.margin_equity("p", "e", "b", "price").alias("equity"),
                    fn.is_liquidated("p", "e", "b", "price", 0.005).alias("liquidated"))


# -- quality ------------------------------------------------------------------------------

STORED = f"""SELECT symbol, ts_ns, ts_ns + CASE WHEN n_trades = 4 THEN {2 * H // 4} + 2 ELSE 0 END
    AS pos, CASE WHEN n_trades % 7 = 0 THEN low - 1 ELSE high END AS high, low, close FROM bars_15m
    UNION ALL SELECT symbol, ts_ns, ts_ns + 1, high, low, close FROM bars_15m WHERE n_trades = 2"""


def stored_bars(spark, sf):
    """Quarter-hour bars as a faulty file would hold them: repeats, swaps, bad highs."""
    b = v.bars_15m(spark, sf).select("symbol", "ts_ns", "high", "low", "close", "n_trades")
    late = F.when(F.col("n_trades") == 4, 2 * H // 4 + 2).otherwise(0)
    main = b.withColumn("pos", F.col("ts_ns") + late).withColumn("high", F.when(
        F.col("n_trades") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")))
    again = b.where("n_trades = 2").withColumn("pos", F.col("ts_ns") + 1)
    return main.unionByName(again).drop("n_trades")


SEQ_SQL = f"""SELECT symbol, CASE WHEN d = 0 THEN 'duplicate_ts' WHEN d < 0 THEN 'non_monotonic'
    ELSE 'gap' END AS kind, ts_ns, CASE WHEN d = 0 THEN 'duplicate timestamp' WHEN d < 0 THEN
    'timestamps not sorted' ELSE (d // {H // 4} - 1) || ' missing bars' END AS detail FROM (
    SELECT *, ts_ns - lag(ts_ns) OVER (PARTITION BY symbol ORDER BY pos) AS d FROM stored)
    WHERE d <= 0 OR d > {H // 4}"""


@query("w19_sequence_anomalies", SEQ_SQL, "symbol kind ts_ns detail", stored=STORED)
def _(spark, sf):
    return quality.sequence_anomalies(stored_bars(spark, sf), H // 4, "pos", 4 * D)


@query("a5_j6_price_outliers", f"""SELECT symbol, 'price_outlier' AS kind, ts_ns FROM stored JOIN (
    SELECT symbol, ts_ns // {D} AS d, median(close) AS m FROM stored GROUP BY 1, 2) USING (symbol)
    WHERE ts_ns // {D} = d AND (close > m * 1.03 OR close < m / 1.03)""", "symbol kind ts_ns",
       stored=STORED)
def _(spark, sf):
    return quality.price_outliers(stored_bars(spark, sf), 1.03)


@query("a4_u1_quality_report", f"""SELECT kind, count(*) AS n, min(ts_ns) AS first, max(ts_ns) AS last
    FROM (SELECT symbol, kind, ts_ns FROM ({SEQ_SQL}) UNION ALL SELECT symbol, 'high_lt_low', ts_ns
    FROM stored WHERE high < low UNION ALL SELECT symbol, 'price_outlier', ts_ns FROM stored JOIN (
    SELECT symbol, ts_ns // {D} AS d, median(close) AS m FROM stored GROUP BY 1, 2) USING (symbol)
    WHERE ts_ns // {D} = d AND (close > m * 1.03 OR close < m / 1.03)) GROUP BY 1""",
       "kind n first last", stored=STORED)
def _(spark, sf):
    found = quality.check_bars(stored_bars(spark, sf), H // 4, 1.03, "pos", 4 * D)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first"),
                                     F.max("ts_ns").alias("last"))


@query("a40_duplicate_guard", """SELECT symbol, count(*) AS n_rows, count(DISTINCT ts_ns) AS n_times,
    count(*) = count(DISTINCT ts_ns) AS "unique" FROM stored GROUP BY 1""",
       "symbol n_rows n_times", stored=STORED)
def _(spark, sf):
    return quality.duplicate_guard(stored_bars(spark, sf), ["symbol"])


@query("u2_keyed_dedup", """SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate::DATE AS day
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate,
    l_suppkey, l_partkey) AS rn FROM lineitem) WHERE rn = 1""",
       "l_orderkey l_linenumber l_suppkey day")
def _(spark, sf):
    li = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey",
                                               "l_shipdate", "l_partkey")
    return quality.keep_one(li, ["l_orderkey", "l_linenumber"],
                            ["l_shipdate", "l_suppkey", "l_partkey"]).withColumn(
        "day", F.to_date("l_shipdate"))


# -- lookups ------------------------------------------------------------------------------

CUT = 883612800 * 10**9  # 1998-01-01


@query("j3_t5_close_before", f"""SELECT symbol, max(ts_ns) AS ts_ns, arg_max(close, ts_ns) AS close
    FROM daily WHERE ts_ns < {CUT} GROUP BY 1""", "symbol ts_ns", "close")
def _(spark, sf):
    return lookups.close_before(v.daily(spark, sf), CUT)


@query("j4_funding_marks", f"""SELECT f.symbol, f.ts_ns, rate, coalesce(a.close, b.open) AS mark
    FROM funding f LEFT JOIN bars_15m a ON a.symbol = f.symbol AND a.ts_ns = f.ts_ns
    - f.ts_ns % {H // 4} - {H // 4} LEFT JOIN bars_15m b ON b.symbol = f.symbol
    AND b.ts_ns = f.ts_ns - f.ts_ns % {H // 4}""", "symbol ts_ns", "rate mark")
def _(spark, sf):
    return lookups.funding_marks(v.funding(spark, sf), v.bars_15m(spark, sf), H // 4)


@query("j5_sum_between", f"""SELECT a.symbol, a.ts_ns, sum(f.rate) AS total FROM (SELECT symbol, ts_ns
    FROM bars_1h) a LEFT JOIN funding f ON f.symbol = a.symbol AND f.ts_ns > a.ts_ns - {D}
    AND f.ts_ns <= a.ts_ns GROUP BY 1, 2""".replace("sum(f.rate)", "coalesce(sum(f.rate), 0)"),
       "symbol ts_ns", "total")
def _(spark, sf):
    spans = v.bars_1h(spark, sf).select("symbol", "ts_ns", (F.col("ts_ns") - D).alias("_from"))
    return lookups.sum_between(spans, v.funding(spark, sf), "rate", "_from", "ts_ns", width=4 * D)


@query("j5_daily_grid_sum", f"""SELECT pair, (ts_ns - 1) // {D} * {D} AS ts_ns, sum(rate) AS total
    FROM leg_funding GROUP BY 1, 2""", "pair ts_ns", "total")
def _(spark, sf):
    return lookups.sum_per_interval(v.leg_funding(spark, sf), "rate", ["pair"], D, "total")


@query("j7_date_offset_join", """SELECT d.symbol, d.ts_ns, d.close, p.close AS past, f.close AS ahead
    FROM ix d LEFT JOIN ix p ON p.symbol = d.symbol AND p.t = d.t - 7
    LEFT JOIN ix f ON f.symbol = d.symbol AND f.t = d.t + 3""", "symbol ts_ns", "close past ahead",
       ix="SELECT *, dense_rank() OVER (ORDER BY ts_ns) AS t FROM daily")
def _(spark, sf):
    return lookups.offset_join(v.daily(spark, sf), {"past": -7, "ahead": 3})


NUMBER = "substr(symbol, 2)::BIGINT"  # symbols are S0 to S19; each is paired with the next
PAIRS = {"first_leg": f"SELECT {NUMBER} AS pair, ts_ns, close FROM daily",
         "other_leg": f"SELECT ({NUMBER} + 19) % 20 AS pair, ts_ns, close FROM daily"}


def pairs(spark, sf):
    """Every symbol as the first leg of a pair, and as the second leg of the pair before."""
    number = F.substring("symbol", 2, 9).cast("bigint")
    d = v.daily(spark, sf)
    return d.withColumn("pair", number), d.withColumn("pair", (number + 19) % 20)


@query("j8_alignment", """SELECT count(*) FILTER (a.ts_ns IS NOT NULL AND b.ts_ns IS NOT NULL) AS matched,
    count(*) FILTER (b.ts_ns IS NULL) AS left_only, count(*) FILTER (a.ts_ns IS NULL) AS right_only
    FROM first_leg a FULL OUTER JOIN other_leg b USING (pair, ts_ns)""", "matched left_only right_only",
       **PAIRS)
def _(spark, sf):
    return lookups.alignment(*pairs(spark, sf), ["pair", "ts_ns"])


@query("j9_presence_filter", f"""SELECT t.ts_ns, count(*) AS n FROM transfers t
    WHERE ts_ns IN (SELECT ts_ns FROM c) AND ts_ns + {D} IN (SELECT ts_ns FROM c) GROUP BY 1""",
       "ts_ns n", c="SELECT DISTINCT ts_ns FROM daily")
def _(spark, sf):
    kept = lookups.present_today_and_tomorrow(v.transfers(spark, sf), v.daily(spark, sf))
    return kept.groupBy("ts_ns").agg(F.count(F.lit(1)).alias("n"))


@query("j12_cross_join", """SELECT t.event_type AS symbol, h, count(*) AS n FROM events t CROSS JOIN
    (VALUES (60), (3600), (86400)) g(h) GROUP BY 1, 2""", "symbol h n")
def _(spark, sf):
    grid = spark.createDataFrame([(60,), (3600,), (86400,)], "h int")
    return v.ticks(spark, sf).crossJoin(F.broadcast(grid)).groupBy("symbol", "h").agg(
        F.count(F.lit(1)).alias("n"))


@query("j13_leg_basis", """SELECT pair, ts_ns, a.close AS spot, b.close AS perp,
    b.close / a.close - 1 AS basis FROM first_leg a JOIN other_leg b USING (pair, ts_ns)""", "pair ts_ns",
       "spot perp basis", **PAIRS)
def _(spark, sf):
    return lookups.leg_basis(*pairs(spark, sf), ["pair"])


@query("j15_funding_payments", """SELECT f.run_id, f.ts_ns, f.rate * t.price * p.pos AS paid FROM
    (SELECT symbol AS run_id, ts_ns, rate FROM funding) f
    ASOF LEFT JOIN pos p ON p.run_id = f.run_id AND f.ts_ns >= p.ts_ns
    ASOF LEFT JOIN ticks t ON t.symbol = f.run_id AND f.ts_ns >= t.ts_ns""", "run_id ts_ns", "paid",
       pos="""SELECT run_id, ts_ns, sum(CASE WHEN side = 'buy' THEN qty ELSE -qty END) OVER (
       PARTITION BY run_id ORDER BY ts_ns) AS pos FROM fills""")
def _(spark, sf):
    from barlake.operators.trades import funding_payments

    settlements = v.funding(spark, sf).withColumnRenamed("symbol", "run_id")
    marks = v.ticks(spark, sf).select(F.col("symbol").alias("run_id"), "ts_ns", "price")
    return funding_payments(v.fills(spark, sf), settlements, marks)


@query("j1_asof_strict", """SELECT o.order_id, coalesce(t.agg_id, -1) AS agg_id FROM order_book_orders o ASOF LEFT JOIN ticks t
    ON t.symbol = o.symbol AND o.submitted_ns > t.ts_ns""", "order_id agg_id")
def _(spark, sf):
    return asof_join(v.order_book_orders(spark, sf), v.ticks(spark, sf), left_ts="submitted_ns",
                     values=["agg_id"], strict=True).withColumn(
        "agg_id", F.coalesce("agg_id", F.lit(-1)))


# -- transfer networks --------------------------------------------------------------------

FROM, TO = 788918400 * 10**9, 1009843200 * 10**9  # 1995-01-01, 2002-01-01
DEGREES = f"""SELECT to_address AS address, count(DISTINCT from_address) AS in_deg, 0 AS out_deg,
    sum(value) AS volume FROM transfers WHERE ts_ns >= {FROM} AND ts_ns < {TO} GROUP BY 1 UNION ALL
    SELECT from_address, 0, count(DISTINCT to_address), sum(value) FROM transfers
    WHERE ts_ns >= {FROM} AND ts_ns < {TO} GROUP BY 1"""
HUBS = """SELECT * FROM (SELECT address, sum(in_deg)::BIGINT AS in_deg, sum(out_deg)::BIGINT
    AS out_deg, sum(volume) AS volume, (sum(in_deg) * sum(out_deg))::BIGINT AS score FROM degrees
    GROUP BY 1) WHERE in_deg >= 5 AND out_deg >= 5 AND volume >= 1000
    ORDER BY score DESC, address LIMIT 30"""


@query("a13_hub_degrees", "SELECT * FROM degrees", "address in_deg out_deg", "volume",
       degrees=DEGREES)
def _(spark, sf):
    return flows.hub_degrees(v.transfers(spark, sf), FROM, TO)


def hubs(spark, sf):
    degrees = flows.hub_degrees(v.transfers(spark, sf), FROM, TO)
    return flows.select_hubs(degrees, 5, 5, 1000.0, 30)


@query("a14_t4_hub_selection", "SELECT * FROM hubs", "address in_deg out_deg score", "volume",
       degrees=DEGREES, hubs=HUBS)
def _(spark, sf):
    return hubs(spark, sf)


FLOWS = f"""SELECT make_timestamp(ts_ns // 1000)::DATE AS day,
    sum(CASE WHEN to_address IN (SELECT address FROM hubs) THEN value ELSE 0 END) AS deposit,
    sum(CASE WHEN from_address IN (SELECT address FROM hubs) THEN value ELSE 0 END) AS withdraw,
    count(DISTINCT CASE WHEN to_address IN (SELECT address FROM hubs) THEN from_address END)
      AS deposit_clients,
    count(DISTINCT CASE WHEN from_address IN (SELECT address FROM hubs) THEN to_address END)
      AS withdraw_clients FROM transfers WHERE ts_ns >= {FROM} AND ts_ns < {TO} GROUP BY 1"""


@query("a15_j10_daily_flows", "SELECT * FROM daily_flows",
       "day deposit_clients withdraw_clients", "deposit withdraw",
       degrees=DEGREES, hubs=HUBS, daily_flows=FLOWS)
def _(spark, sf):
    return flows.daily_flows(v.transfers(spark, sf), hubs(spark, sf), FROM, TO)


@query("a16_top_receivers", f"""SELECT address, sum(value) AS received, count(DISTINCT tx_id)
    AS funding_txs FROM (SELECT tx_id, value, unnest(addresses) AS address FROM outputs
    WHERE ts_ns >= {FROM} AND ts_ns < {CUT}) GROUP BY 1 HAVING count(DISTINCT tx_id) >= 20
    ORDER BY received DESC, address LIMIT 25""", "address funding_txs", "received")
def _(spark, sf):
    return flows.top_receivers(v.outputs(spark, sf), FROM, CUT, 20, 25)


INPUTS = """SELECT o_orderkey AS tx_id, [(o_custkey % 100)::VARCHAR] AS addresses, o_totalprice
    AS value, epoch_ns(o_orderdate) AS ts_ns FROM orders"""
SET = ", ".join(f"'{i}'" for i in range(0, 40, 3))


@query("a17_two_sided_flows", f"""SELECT day, in_amount, out_amount, coalesce(in_txs, 0) AS in_txs,
    coalesce(out_txs, 0) AS out_txs FROM (SELECT make_timestamp(ts_ns // 1000)::DATE AS day,
    sum(value) AS in_amount, count(DISTINCT tx_id) AS in_txs FROM (SELECT tx_id, value, ts_ns,
    unnest(addresses) AS a FROM outputs) WHERE a IN ({SET}) AND ts_ns >= {FROM} AND ts_ns < {TO}
    GROUP BY 1) FULL OUTER JOIN (SELECT make_timestamp(ts_ns // 1000)::DATE AS day, sum(value)
    AS out_amount, count(DISTINCT tx_id) AS out_txs FROM (SELECT tx_id, value, ts_ns,
    unnest(addresses) AS a FROM inputs) WHERE a IN ({SET}) AND ts_ns >= {FROM} AND ts_ns < {TO}
    GROUP BY 1) USING (day)""", "day in_txs out_txs", "in_amount out_amount", inputs=INPUTS)
def _(spark, sf):
    o = v.table(spark, sf, "orders")
    inputs = o.select(
        F.col("o_orderkey").alias("tx_id"),
        F.array((F.col("o_custkey") % 100).cast("string")).alias("addresses"),
        F.col("o_totalprice").alias("value"), v.day_ns("o_orderdate").alias("ts_ns"))
    members = spark.createDataFrame([(str(i),) for i in range(0, 40, 3)], "address string")
    both = flows.two_sided_flows(v.outputs(spark, sf), inputs, members, FROM, TO)
    return both.fillna(0, ["in_txs", "out_txs"])


@query("a31_calibration", """SELECT count(*) AS n_positive, quantile_cont(net, 0.9) AS entry,
    quantile_cont(net, 0.25) AS exit FROM (SELECT deposit - withdraw AS net FROM daily_flows
    WHERE day < DATE '1998-01-01') WHERE net > 0""", "n_positive", "entry exit",
       degrees=DEGREES, hubs=HUBS, daily_flows=FLOWS)
def _(spark, sf):
    f = flows.daily_flows(v.transfers(spark, sf), hubs(spark, sf), FROM, CUT)
    return flows.calibrate_entry(f.withColumn("net", F.col("deposit") - F.col("withdraw")),
                                 "net", 0.9)
