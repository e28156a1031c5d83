"""Exchange archive files: klines, aggregate trades and funding as CSV, also zipped.

Files are read as lines with their path, so parsing is plain column work on all executors
and a bad line is a row in a rejects table that names its file, not a failed job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.scalars import normalize_ts

# Column layouts of the archive files (fixed values).
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time",
                 "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore")
TRADE_COLUMNS = ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id",
                 "transact_time", "is_buyer_maker")  # the spot layout has one more, is_best_match
FUNDING_COLUMNS = ("calc_time", "funding_interval_hours", "last_funding_rate")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain CSV files with their file path."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                        F.col("value").alias("line"))


def zipped_lines(files: DataFrame) -> DataFrame:
    """Lines of single-member zip archives given as (path, content).

    An archive cannot be split, so one is one task's work; its lines stream out in batches.
    """
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = archive.namelist()
                    if len(members) != 1:
                        raise ValueError(f"{path}: expected one member, found {len(members)}")
                    with archive.open(members[0]) as raw:
                        lines = io.TextIOWrapper(raw, encoding="utf-8")
                        while chunk := lines.readlines(1 << 22):
                            yield pd.DataFrame({"file": path,
                                                "line": [x.rstrip("\r\n") for x in chunk]})

    return files.select("path", "content").mapInPandas(unpack, "file string, line string")


def read_zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    return zipped_lines(spark.read.format("binaryFile").load(path))


def _parse(lines: DataFrame, header: str, sizes: tuple[int, ...],
           fields: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Typed rows and rejects; header lines and blank lines are skipped."""
    body = lines.where((F.trim("line") != "") & ~F.startswith(F.trim("line"), F.lit(header)))
    cut = body.withColumn("_f", F.split(F.trim("line"), ","))
    typed = cut.select("file", "line", F.size("_f").alias("_n"),
                       *[c.alias(name) for name, c in fields.items()])
    counted = F.col("_n").isin(*sizes)
    complete = counted
    for name in fields:
        complete = complete & F.col(name).isNotNull()
    good = typed.where(complete).select("file", *fields)
    reason = F.when(~counted, "field count")
    for name in fields:
        reason = reason.when(F.col(name).isNull(), f"bad {name}")
    bad = typed.where(~complete).select("file", "line", reason.alias("reason"))
    return good, bad


def _at(columns: tuple[str, ...], name: str, kind: str) -> Column:
    text = F.trim(F.get(F.col("_f"), F.lit(columns.index(name))))
    value = text.try_cast(kind)
    return F.when(~F.isnan(value), value) if kind == "double" else value


def parse_klines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars (with their file) and rejected lines."""
    def c(name: str, kind: str = "double") -> Column:
        return _at(KLINE_COLUMNS, name, kind)
    return _parse(lines, "open_time", (12,), {
        "ts_ns": normalize_ts(c("open_time", "bigint")), "open": c("open"), "high": c("high"),
        "low": c("low"), "close": c("close"), "volume": c("volume"),
        "quote_volume": c("quote_volume"), "n_trades": c("count", "bigint"),
        "taker_buy_volume": c("taker_buy_volume"),
        "taker_buy_quote_volume": c("taker_buy_quote_volume")})


def parse_trades(lines: DataFrame, market: str = "um") -> tuple[DataFrame, DataFrame]:
    """Trades and rejected lines; the maker flag must read true or false in any case."""
    def c(name: str, kind: str) -> Column:
        return _at(TRADE_COLUMNS, name, kind)
    flag = F.lower(c("is_buyer_maker", "string"))
    return _parse(lines, "agg_trade_id", (8,) if market == "spot" else (7,), {
        "agg_id": c("agg_trade_id", "bigint"), "ts_ns": normalize_ts(c("transact_time", "bigint")),
        "price": c("price", "double"), "qty": c("quantity", "double"),
        "buyer_is_maker": F.when(flag == "true", True).when(flag == "false", False)})


def parse_funding(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    def c(name: str, kind: str) -> Column:
        return _at(FUNDING_COLUMNS, name, kind)
    return _parse(lines, "calc_time", (3,), {
        "ts_ns": normalize_ts(c("calc_time", "bigint")),
        "interval_hours": c("funding_interval_hours", "int"),
        "rate": c("last_funding_rate", "double")})
