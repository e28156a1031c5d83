"""Instrument rules out of exchange-information JSON, and universe snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCHANGE_INFO = (
    "struct<symbols: array<struct<symbol: string, contractType: string, status: string, "
    "quoteAsset: string, filters: array<struct<filterType: string, tickSize: string, "
    "stepSize: string, notional: string>>>>>")
UNIVERSE = "symbol string, tick_size double, step_size double, min_notional double"


def _filter_value(kind: str, field: str) -> Column:
    found = F.filter("s.filters", lambda f: f["filterType"] == kind)
    return F.try_element_at(found, F.lit(1))[field].try_cast("double")


def instrument_rules(info: DataFrame, column: str = "body") -> DataFrame:
    """Tick, step and minimum notional of trading USDT perpetuals."""
    symbols = info.select(F.explode(F.from_json(column, EXCHANGE_INFO)["symbols"]).alias("s"))
    kept = symbols.where((F.col("s.contractType") == "PERPETUAL") & (F.col("s.status") == "TRADING")
                         & (F.col("s.quoteAsset") == "USDT"))
    return kept.select(
        "s.symbol", _filter_value("PRICE_FILTER", "tickSize").alias("tick_size"),
        _filter_value("LOT_SIZE", "stepSize").alias("step_size"),
        _filter_value("MIN_NOTIONAL", "notional").alias("min_notional"))


def save_universe(rules: DataFrame, path: str) -> None:
    rules.orderBy("symbol").write.mode("overwrite").json(path)


def load_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNIVERSE).json(path)
