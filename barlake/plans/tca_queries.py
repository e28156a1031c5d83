"""Queries over order tables priced on the tape and on bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import tca
from barlake.plans import market_queries as mq
from barlake.plans import views as v
from barlake.plans.registry import query
from barlake.plans.views import D, H
from barlake.session import settle

LATENCY = 250_000_000
ARR = {"arr": f"SELECT *, submitted_ns + {LATENCY} AS arrive_ns FROM order_book_orders"}


def orders(spark, sf, kind=None):
    o = tca.arrival(v.order_book_orders(spark, sf), LATENCY)
    return o if kind is None else o.where(F.col("type") == kind)


def tape(spark, sf):
    return settle(v.ticks(spark, sf), "ticks")


def filled(df):
    return df.withColumn("fill_ts", F.coalesce("fill_ts", F.lit(-1)))


@query("x1_arrival", f"""SELECT order_id, submitted_ns + {LATENCY} + CAST('0x' || substr(md5('3|' ||
    order_id), 1, 8) AS BIGINT) % 1000000 AS arrive_ns FROM order_book_orders""",
       "order_id arrive_ns")
def _(spark, sf):
    return tca.arrival(v.order_book_orders(spark, sf), LATENCY, 1_000_000, 3)


@query("x2_market_fills", """SELECT order_id, CASE WHEN max(q1) >= want THEN
    max(ts_ns) FILTER (q0 < want) ELSE -1 END AS fill_ts, CASE WHEN max(q1) >= want THEN sum(price * greatest(0, least(q1, want) - q0))
    / any_value(oq) END AS fill_price FROM (SELECT o.order_id, o.qty AS oq, t.ts_ns, t.price,
    t.q - t.qty - coalesce(b.q, 0) AS q0, t.q - coalesce(b.q, 0) AS q1,
    o.qty::DECIMAL(20, 9) AS want
    FROM (SELECT * FROM arr WHERE type = 'market') o
    ASOF LEFT JOIN cum b ON b.symbol = o.symbol AND b.side = o.side AND o.arrive_ns > b.ts_ns
    LEFT JOIN cum t ON t.symbol = o.symbol AND t.side = o.side AND t.ts_ns >= o.arrive_ns)
    GROUP BY order_id, want""", "order_id fill_ts", "fill_price",
       cum="""SELECT symbol, CASE WHEN buyer_is_maker THEN 'sell' ELSE 'buy' END AS side, ts_ns, price,
       qty::DECIMAL(20, 9) AS qty, sum(qty::DECIMAL(20, 9)) OVER (PARTITION BY symbol, buyer_is_maker ORDER BY ts_ns) AS q FROM ticks""",
       **ARR)
def _(spark, sf):
    return filled(tca.market_fills(orders(spark, sf, "market"), tape(spark, sf), 4 * D))


@query("x3_j14_limit_fills", """SELECT order_id, coalesce(min(t.ts_ns), -1) AS fill_ts,
    CASE WHEN min(t.ts_ns) IS NOT NULL THEN any_value(limit_price) END AS fill_price
    FROM (SELECT * FROM arr WHERE type = 'limit') o LEFT JOIN ticks t ON t.symbol = o.symbol
    AND t.ts_ns >= o.arrive_ns AND CASE WHEN o.side = 'buy' THEN t.price < limit_price
    ELSE t.price > limit_price END GROUP BY 1""", "order_id fill_ts", "fill_price", **ARR)
def _(spark, sf):
    return filled(tca.limit_fills(orders(spark, sf, "limit"), tape(spark, sf), width=D))


@query("x4_stop_fills", """SELECT order_id, coalesce(min(t.ts_ns), -1) AS fill_ts,
    arg_min(t.price, t.ts_ns) AS fill_price FROM (SELECT * FROM arr WHERE type = 'stop') o
    LEFT JOIN ticks t ON t.symbol = o.symbol AND t.ts_ns >= o.arrive_ns AND CASE WHEN o.side = 'buy'
    THEN t.price >= stop_price ELSE t.price <= stop_price END GROUP BY 1""",
       "order_id fill_ts", "fill_price", **ARR)
def _(spark, sf):
    return filled(tca.stop_fills(orders(spark, sf, "stop"), tape(spark, sf), width=D))


@query("x5_bar_market_fills", f"""SELECT order_id, coalesce(b.c, -1) AS fill_ts, b.open * (1 + CASE WHEN
    side = 'buy' THEN 1 ELSE -1 END * 2.0::DOUBLE / 1e4) AS fill_price FROM (SELECT * FROM arr
    WHERE type = 'market') o ASOF LEFT JOIN (SELECT *, ts_ns + {H} AS c FROM bars_1h) b
    ON b.symbol = o.symbol AND o.arrive_ns <= b.c""", "order_id fill_ts", "fill_price", **ARR)
def _(spark, sf):
    return filled(tca.bar_market_fills(orders(spark, sf, "market"), mq.hourly(spark, sf), H, 2.0,
                                       mq.WIDE))


def bar_sql(kind: str, cond_buy: str, cond_sell: str, price: str) -> str:
    return f"""SELECT order_id, coalesce(b.c, -1) AS fill_ts, {price} AS fill_price FROM (SELECT *
    FROM arr WHERE type = '{kind}') o LEFT JOIN (SELECT o.order_id, min(b.ts_ns) AS at FROM arr o
    JOIN bars_1h b ON b.symbol = o.symbol AND b.ts_ns + {H} >= o.arrive_ns AND CASE WHEN
    o.side = 'buy' THEN {cond_buy} ELSE {cond_sell} END WHERE o.type = '{kind}' GROUP BY 1) f
    USING (order_id) LEFT JOIN (SELECT *, ts_ns + {H} AS c FROM bars_1h) b ON b.symbol = o.symbol
    AND b.ts_ns = f.at"""


@query("x6_bar_limit_fills", bar_sql("limit", "b.low < limit_price", "b.high > limit_price",
                                     "CASE WHEN b.c IS NOT NULL THEN limit_price END"),
       "order_id fill_ts", "fill_price", **ARR)
def _(spark, sf):
    return filled(tca.bar_limit_fills(orders(spark, sf, "limit"), mq.hourly(spark, sf), H))


@query("x7_bar_stop_fills", bar_sql(
    "stop", "b.high >= stop_price", "b.low <= stop_price",
    """CASE WHEN b.c IS NOT NULL THEN CASE WHEN side = 'buy' THEN greatest(b.open, stop_price)
    * 1.0002::DOUBLE ELSE least(b.open, stop_price) * 0.9998::DOUBLE END END"""),
       "order_id fill_ts", "fill_price", **ARR)
def _(spark, sf):
    return filled(tca.bar_stop_fills(orders(spark, sf, "stop"), mq.hourly(spark, sf), H, 2.0))


@query("x8_post_only", """SELECT order_id, coalesce(CASE WHEN side = 'buy' THEN t.price <= limit_price
    ELSE t.price >= limit_price END, false) AS crosses FROM (SELECT * FROM arr WHERE type = 'limit') o
    ASOF LEFT JOIN ticks t ON t.symbol = o.symbol AND o.arrive_ns >= t.ts_ns""",
       "order_id crosses", **ARR)
def _(spark, sf):
    return tca.would_cross(orders(spark, sf, "limit"), v.ticks(spark, sf))


@query("x9_p12_slippage_cost", """SELECT order_id, coalesce((t.price * (1 + CASE WHEN side = 'buy'
    THEN 1 ELSE -1 END * 2.0::DOUBLE / 1e4) - t.price) * o.qty * CASE WHEN side = 'buy' THEN 1 ELSE -1
    END, 0) AS cost FROM arr o ASOF LEFT JOIN ticks t ON t.symbol = o.symbol
    AND o.arrive_ns >= t.ts_ns""", "order_id", "cost", **ARR)
def _(spark, sf):
    from barlake.functions.scalars import slipped
    from barlake.operators.asof import asof_join

    seen = asof_join(orders(spark, sf), v.ticks(spark, sf), left_ts="arrive_ns", values=["price"],
                     tie=["agg_id"])
    return seen.withColumn("cost", tca.slippage_cost("price", slipped("price", "side", 2.0)))
