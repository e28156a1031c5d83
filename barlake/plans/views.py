"""Market-shaped views over the driver's tables, for Spark and as SQL text.

Each view exists twice with one meaning: a DataFrame builder ``(spark, dir)`` and the SQL
used on the comparison side. ``sql`` prefixes a statement with the views it names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.bars import bars_from_trades
from barlake.schemas import NS_DAY, NS_HOUR

H, D = NS_HOUR, NS_DAY


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def wall_clock_ns(ts: str) -> Column:
    """Nanoseconds of a zone-less timestamp, whatever the session time zone is."""
    return F.expr(
        f"(unix_date(CAST({ts} AS DATE)) * 86400000000L + hour({ts}) * 3600000000L"
        f" + minute({ts}) * 60000000L + CAST(extract(SECOND FROM {ts}) * 1000000 AS BIGINT))"
        " * 1000")


def day_ns(ts: str) -> Column:
    """Nanoseconds of a zone-less timestamp that is a midnight."""
    return F.expr(f"CAST(unix_date(CAST({ts} AS DATE)) AS BIGINT) * {D}")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), wall_clock_ns("ts").alias("ts_ns"),
        (F.lit(100.0) + k / 10.0 + F.col("value") / 1000.0).alias("price"),
        (F.lit(1.0) + F.col("value") / 10.0).alias("qty"), F.col("event_id").alias("agg_id"),
        (F.col("user_id") % 2 == 0).alias("buyer_is_maker"),
    )


def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_trades(ticks(spark, sf), H)


def bars_15m(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_trades(ticks(spark, sf), H // 4)


def funding(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), wall_clock_ns("ts").alias("t"), "value")
    bucket = F.col("t") - F.col("t") % (8 * H)
    return e.groupBy("symbol", bucket.alias("_b")).agg(
        F.min_by("value", "t").alias("_v")
    ).select("symbol", (F.col("_b") + 8 * H).alias("ts_ns"),
             F.lit(8).cast("int").alias("interval_hours"),
             ((F.col("_v") - 50.0) / 1e5).alias("rate"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    symbol = F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string"))
    return li.groupBy(symbol.alias("symbol"), day_ns("l_shipdate").alias("ts_ns")).agg(
        (F.lit(100.0) + F.percentile("l_quantity", 0.5)
         + F.lit(10.0) * F.percentile("l_discount", 0.5)).alias("close"),
        F.sum("l_extendedprice").alias("quote_volume"))


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Every day from the first shipping day to the last."""
    ends = table(spark, sf, "lineitem").agg(
        F.min(day_ns("l_shipdate")).alias("a"), F.max(day_ns("l_shipdate")).alias("b"))
    return ends.where("a IS NOT NULL").select(
        F.explode(F.sequence("a", "b", F.lit(D))).alias("ts_ns"))


def legs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per calendar day, so a plain window fills the gaps."""
    li = table(spark, sf, "lineitem")
    per_day = li.groupBy(day_ns("l_shipdate").alias("ts_ns")).agg(
        (F.lit(1000.0) + F.percentile("l_quantity", 0.5)).alias("_s"),
        ((F.percentile("l_discount", 0.5) - 0.05) / 10.0).alias("_b"))
    cal = calendar(spark, sf).withColumn("pair", F.lit("P"))
    fill = W.partitionBy("pair").orderBy("ts_ns").rowsBetween(W.unboundedPreceding, 0)
    spot = F.last("_s", ignorenulls=True).over(fill)
    basis = F.last("_b", ignorenulls=True).over(fill)
    return cal.join(per_day, "ts_ns", "left").select(
        "pair", "ts_ns", spot.alias("spot"), (spot * (F.lit(1.0) + basis)).alias("perp"))


def leg_funding(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    shift = F.when(F.col("l_returnflag") == "A", 0).when(
        F.col("l_returnflag") == "N", 8 * H).otherwise(16 * H)
    return li.groupBy(day_ns("l_shipdate").alias("d"), "l_returnflag").agg(
        ((F.percentile("l_tax", 0.5) - 0.04) / 100.0).alias("rate")
    ).select(
        F.lit("P").alias("pair"), (F.col("d") + shift).alias("ts_ns"),
        F.lit(8).cast("int").alias("interval_hours"), "rate")


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("from_address"),
        F.col("l_suppkey").cast("string").alias("to_address"),
        F.col("l_extendedprice").alias("value"), day_ns("o_orderdate").alias("ts_ns"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("tx_id"),
        F.array(F.col("l_suppkey").cast("string"),
                (F.col("l_partkey") % 50).cast("string")).alias("addresses"),
        F.col("l_extendedprice").alias("value"), day_ns("o_orderdate").alias("ts_ns"))


def order_book_orders(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    price = F.lit(100.0) + k.cast("double") / 10.0 + F.col("value") / 1000.0
    kind = F.element_at(F.array(F.lit("market"), F.lit("limit"), F.lit("stop")),
                        (F.col("event_id") % 3 + 1).cast("int"))
    buy = F.col("user_id") % 2 == 0
    side = F.when(buy, "buy").otherwise("sell")
    offset = F.when(buy, -0.5).otherwise(0.5)
    return e.select(
        F.col("event_id").alias("order_id"), F.col("event_type").alias("symbol"),
        side.alias("side"), kind.alias("type"), (F.lit(5.0) + F.col("value") / 10.0).alias("qty"),
        F.when(kind == "limit", price + offset).alias("limit_price"),
        F.when(kind == "stop", price - offset).alias("stop_price"),
        wall_clock_ns("ts").alias("submitted_ns"))


def fills(spark: SparkSession, sf: str, tie: Sequence[str] = ()) -> DataFrame:
    """Of each three ticks of a symbol two buy, in thousandths, and the third sells all of it. Ticks of
    one time come in ``tie`` order."""
    from barlake.operators.series import core_rows, in_blocks

    blocks, w = in_blocks(ticks(spark, sf), before=2, tie=tie)
    own = F.round(F.col("qty"), 3)
    sells = F.col("_idx") % 3 == 2
    qty = F.when(sells, F.round(F.lag(own, 1).over(w) + F.lag(own, 2).over(w), 3)).otherwise(own)
    rows = blocks.withColumn("_q", qty).withColumn("side", F.when(sells, "sell").otherwise("buy"))
    return core_rows(rows).select(
        F.col("symbol").alias("run_id"), F.col("agg_id").alias("order_id"), "ts_ns", "side",
        "price", F.col("_q").alias("qty"), (F.col("price") * F.col("_q") * 5.0 / 1e4).alias("fee"))


def _bars_sql(n: int) -> str:
    return f"""SELECT symbol, ts_ns - ts_ns % {n} AS ts_ns, arg_min(price, ts_ns) AS open,
        max(price) AS high, min(price) AS low, arg_max(price, ts_ns) AS close,
        sum(qty) AS volume, sum(price * qty) AS quote_volume, count(*) AS n_trades,
        coalesce(sum(qty) FILTER (NOT buyer_is_maker), 0) AS taker_buy_volume,
        coalesce(sum(price * qty) FILTER (NOT buyer_is_maker), 0) AS taker_buy_quote_volume
        FROM ticks GROUP BY 1, 2"""


VIEW_SQL = {
    "ticks": """SELECT event_type AS symbol, epoch_ns(ts) AS ts_ns,
        100.0::DOUBLE + CAST(json_extract(props, '$.k') AS DOUBLE) / 10.0::DOUBLE
          + value / 1000.0::DOUBLE AS price,
        1.0::DOUBLE + value / 10.0::DOUBLE AS qty, event_id AS agg_id,
        user_id % 2 = 0 AS buyer_is_maker FROM events""",
    "bars_1h": _bars_sql(H),
    "bars_15m": _bars_sql(H // 4),
    "funding": f"""SELECT event_type AS symbol,
        epoch_ns(ts) - epoch_ns(ts) % {8 * H} + {8 * H} AS ts_ns, 8 AS interval_hours,
        (arg_min(value, ts) - 50.0::DOUBLE) / 1e5::DOUBLE AS rate FROM events GROUP BY 1, 2""",
    "daily": """SELECT 'S' || (l_suppkey % 20) AS symbol, epoch_ns(l_shipdate) AS ts_ns,
        100.0::DOUBLE + median(l_quantity) + 10.0::DOUBLE * median(l_discount) AS close,
        sum(l_extendedprice) AS quote_volume FROM lineitem GROUP BY 1, 2""",
    "calendar": f"""SELECT unnest(generate_series(min(epoch_ns(l_shipdate)),
        max(epoch_ns(l_shipdate)), {D})) AS ts_ns FROM lineitem""",
    "legs": """SELECT 'P' AS pair, ts_ns, s AS spot, s * (1.0::DOUBLE + b) AS perp FROM (
        SELECT c.ts_ns, last_value(p.s IGNORE NULLS) OVER w AS s,
          last_value(p.b IGNORE NULLS) OVER w AS b
        FROM calendar c LEFT JOIN (SELECT epoch_ns(l_shipdate) AS ts_ns,
            1000.0::DOUBLE + median(l_quantity) AS s,
            (median(l_discount) - 0.05::DOUBLE) / 10.0::DOUBLE AS b
          FROM lineitem GROUP BY 1) p USING (ts_ns)
        WINDOW w AS (ORDER BY c.ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "leg_funding": f"""SELECT 'P' AS pair, d + CASE l_returnflag WHEN 'A' THEN 0
        WHEN 'N' THEN {8 * H} ELSE {16 * H} END AS ts_ns, 8 AS interval_hours, rate FROM (
        SELECT epoch_ns(l_shipdate) AS d, l_returnflag,
          (median(l_tax) - 0.04::DOUBLE) / 100.0::DOUBLE AS rate FROM lineitem GROUP BY 1, 2)""",
    "transfers": """SELECT o_custkey::VARCHAR AS from_address, l_suppkey::VARCHAR AS to_address,
        l_extendedprice AS value, epoch_ns(o_orderdate) AS ts_ns
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "outputs": """SELECT o_orderkey AS tx_id, [l_suppkey::VARCHAR, (l_partkey % 50)::VARCHAR]
        AS addresses, l_extendedprice AS value, epoch_ns(o_orderdate) AS ts_ns
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "order_book_orders": """SELECT order_id, symbol, side, type, qty,
        CASE WHEN type = 'limit' THEN price + o END AS limit_price,
        CASE WHEN type = 'stop' THEN price - o END AS stop_price, submitted_ns
        FROM (SELECT event_id AS order_id, event_type AS symbol,
          CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
          CASE event_id % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS type,
          5.0::DOUBLE + value / 10.0::DOUBLE AS qty,
          CASE WHEN user_id % 2 = 0 THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS o,
          100.0::DOUBLE + CAST(json_extract(props, '$.k') AS DOUBLE) / 10.0::DOUBLE
            + value / 1000.0::DOUBLE AS price,
          epoch_ns(ts) AS submitted_ns FROM events)""",
    "fills": """SELECT symbol AS run_id, agg_id AS order_id, ts_ns,
        CASE WHEN rn % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, price, q AS qty,
        price * q * 5.0::DOUBLE / 1e4::DOUBLE AS fee FROM (SELECT *, CASE WHEN rn % 3 = 0
          THEN round(lag(own) OVER w + lag(own, 2) OVER w, 3) ELSE own END AS q FROM (SELECT *,
          round(qty, 3) AS own, row_number() OVER (PARTITION BY symbol ORDER BY ts_ns) AS rn FROM ticks)
          WINDOW w AS (PARTITION BY symbol ORDER BY ts_ns))""",
}


def sql(body: str, **ctes: str) -> str:
    """Prefix ``body`` with the common tables it names, in dependency order."""
    known = {**VIEW_SQL, **ctes}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                if known[name] is text:
                    continue
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    def cte(name: str) -> str:
        own = re.search(rf"\bFROM {name}\b", known[name])  # a recursive one
        return f"{name} AS {'' if own else 'MATERIALIZED '}({known[name]})"

    return "WITH RECURSIVE " + ",\n".join(map(cte, order)) + "\n" + body
