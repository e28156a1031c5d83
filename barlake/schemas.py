"""Schemas of the stored tables. Times are UTC nanoseconds in BIGINT."""

from pyspark.sql import types as T

NS_SECOND = 1_000_000_000
NS_MINUTE = 60 * NS_SECOND
NS_HOUR = 60 * NS_MINUTE
NS_DAY = 24 * NS_HOUR


def _schema(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(),
             "i": T.IntegerType(), "b": T.BooleanType()}
    return T.StructType([T.StructField(k, kinds[v], True) for k, v in fields.items()])


BARS = _schema(symbol="s", ts_ns="l", open="d", high="d", low="d", close="d", volume="d",
               quote_volume="d", n_trades="l", taker_buy_volume="d",
               taker_buy_quote_volume="d")
TICKS = _schema(symbol="s", ts_ns="l", price="d", qty="d", agg_id="l", buyer_is_maker="b")
FUNDING = _schema(symbol="s", ts_ns="l", interval_hours="i", rate="d")
ORDERS = _schema(order_id="l", symbol="s", side="s", type="s", qty="d", limit_price="d",
                 stop_price="d", submitted_ns="l")
EVENTS = _schema(symbol="s", signal="s", ts_ns="l", direction="s")
