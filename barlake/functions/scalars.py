"""Scalar rules as Column expressions. What the rules refuse comes out as NULL or a reason."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.schemas import NS_DAY, NS_HOUR, NS_MINUTE, NS_SECOND

UNIT_NS = {"s": NS_SECOND, "m": NS_MINUTE, "h": NS_HOUR}


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def exact_units(x: str | Column, step: str | Column | None = None, places: int = 12) -> Column:
    """Whole number of steps in the decimal text of a quantity, as DECIMAL(28, 0).

    A double stands for the shortest decimal that reads as it, so 0.3 is three tenths and sums of
    units are exact at any size, which a quotient of doubles is not from about 1e7 steps on. ``step``
    is the instrument's own step; without it, units are of ``places`` decimals.
    """
    d = _c(x).cast(f"decimal(28,{places})")
    if step is None:
        return (d * F.lit(10 ** places).cast("decimal(13,0)")).cast("decimal(28,0)")
    return F.round(d / _c(step).cast("decimal(20,12)")).cast("decimal(28,0)")


def ts_scale(ts: str | Column) -> Column:
    """Factor to nanoseconds judged by magnitude; NULL for seconds or negative values."""
    ts = _c(ts)
    return (F.when(ts >= 10**18, 1).when(ts >= 10**15, 1_000)
            .when(ts >= 10**12, 1_000_000)).cast("bigint")


def normalize_ts(ts: str | Column) -> Column:
    return _c(ts) * ts_scale(ts)


def normalize_ts_per_file(df: DataFrame, ts: str, file: str) -> DataFrame:
    """One unit per file, chosen by the file's largest value."""
    units = df.groupBy(file).agg(ts_scale(F.max(ts)).alias("_scale"))
    return df.join(units, file).withColumn(ts, F.col(ts) * F.col("_scale")).drop("_scale")


def interval_ns(text: str | Column) -> Column:
    """``15m`` to nanoseconds; NULL where the text is no interval."""
    m = F.regexp_extract(_c(text), r"^(\d+)([smh])$", 1)
    unit = F.regexp_extract(_c(text), r"^(\d+)([smh])$", 2)
    factor = F.when(unit == "s", NS_SECOND).when(unit == "m", NS_MINUTE).when(unit == "h", NS_HOUR)
    return F.nullif(m, F.lit("")).cast("bigint") * factor


def parse_interval(text: str) -> int:
    m = re.fullmatch(r"(\d+)([smh])", text)
    if not m:
        raise ValueError(f"not an interval: {text!r}")
    return int(m.group(1)) * UNIT_NS[m.group(2)]


def day_number(ts: str | Column) -> Column:
    return F.call_function("div", _c(ts), F.lit(NS_DAY))


def hour_number(ts: str | Column) -> Column:
    return F.call_function("div", _c(ts), F.lit(NS_HOUR))


def in_period(ts: str | Column, start: str, end: str) -> Column:
    """Closed range from the start day's midnight to the end day's last nanosecond."""
    lo = F.expr(f"CAST(unix_date(DATE'{start}') AS BIGINT) * {NS_DAY}")
    hi = F.expr(f"CAST(unix_date(DATE'{end}') AS BIGINT) * {NS_DAY} + {NS_DAY - 1}")
    return _c(ts).between(lo, hi)


def round_down(value: str | Column, step: float | Column) -> Column:
    """Largest multiple of ``step`` not above the value, exact in decimals."""
    v = _c(value).cast("decimal(30,12)")
    s = (step if isinstance(step, Column) else F.lit(str(step))).cast("decimal(30,12)")
    return F.when((v > 0) & (s > 0), (v - v % s).cast("double"))


def order_filter_reason(qty: str | Column, price: str | Column, step: float, tick: float,
                        min_notional: float) -> Column:
    """Why an order fails the exchange filters; NULL if it passes."""
    q, p = _c(qty), _c(price)
    rounded = round_down(q, step)
    return (F.when(q <= 0, "qty must be positive")
            .when(p <= 0, "price must be positive")
            .when(rounded <= 0, "qty rounds to zero")
            .when(rounded * round_down(p, tick) < min_notional, "notional below min"))


def order_row_reason() -> Column:
    """Why an order row (type, qty, limit_price, stop_price, post_only) is malformed."""
    kind, limit, stop = F.col("type"), F.col("limit_price"), F.col("stop_price")
    return (F.when(F.col("qty") <= 0, "qty must be positive")
            .when((kind == "limit") & limit.isNull(), "limit order without limit price")
            .when((kind == "market") & limit.isNotNull(), "market order with limit price")
            .when((kind == "stop") & stop.isNull(), "stop order without stop price")
            .when(F.col("post_only") & (kind != "limit"), "post-only needs a limit order"))


def fee(role: str | Column, notional: str | Column, maker_bps: float, taker_bps: float) -> Column:
    bps = F.when(_c(role) == "maker", F.lit(maker_bps)).otherwise(F.lit(taker_bps))
    return _c(notional) * bps / 1e4


def round_trip_bps(entry: str | Column, leave: str | Column, maker_bps: float,
                   taker_bps: float) -> Column:
    def bps(role: str | Column) -> Column:
        return F.when(_c(role) == "maker", F.lit(maker_bps)).otherwise(F.lit(taker_bps))
    return bps(entry) + bps(leave)


def slipped(price: str | Column, side: str | Column, bps: float) -> Column:
    """Price moved against the side."""
    sign = F.when(_c(side) == "buy", 1.0).otherwise(-1.0)
    return _c(price) * (F.lit(1.0) + sign * bps / 1e4)


def hedge_qty(fraction: float, capital: str | Column, spot: str | Column,
              perp: str | Column) -> Column:
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must be inside (0, 1)")
    ok = (_c(spot) > 0) & (_c(perp) > 0)
    return F.when(ok, _c(capital) * fraction / (_c(spot) + _c(perp)))


def scaled_qty(qty: str | Column, factor: float) -> Column:
    if not 1.0 <= factor <= 6.0:
        raise ValueError("factor must be within [1, 6]")
    return _c(qty) * factor


def is_symbol(text: str | Column) -> Column:
    return _c(text).rlike("^[A-Z0-9]{4,20}$")


def is_month(text: str | Column) -> Column:
    return _c(text).rlike(r"^\d{4}-\d{2}$")


def is_day(text: str | Column) -> Column:
    return _c(text).rlike(r"^\d{4}-\d{2}-\d{2}$")


def checksum_token(text: str | Column) -> Column:
    """First token of a checksum file, lower-cased; NULL unless 64 hex digits."""
    token = F.lower(F.regexp_extract(_c(text), r"^\s*(\S+)", 1))
    return F.when(token.rlike("^[0-9a-f]{64}$"), token)


def month_of_stem(path: str | Column) -> Column:
    """Month in a file name such as ``…-2024-01.parquet``; NULL if there is none."""
    return F.nullif(F.regexp_extract(_c(path), r"(\d{4}-\d{2})[^/]*$", 1), F.lit(""))


def ts_text(ts: str | Column) -> Column:
    return F.date_format(F.timestamp_micros(F.call_function("div", _c(ts), F.lit(1000))),
                         "yyyy-MM-dd HH:mm")


def ts_date(ts: str | Column) -> Column:
    return F.date_from_unix_date(day_number(ts).cast("int"))


def next_day(ts: str | Column) -> Column:
    return F.date_add(ts_date(ts), 1)


def fingerprint(columns: Mapping[str, Column] | list[str]) -> Column:
    """SHA-256 of the frozen columns as JSON with sorted keys."""
    cols = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    return F.sha2(F.to_json(F.struct(*[cols[k].alias(k) for k in sorted(cols)])), 256)


def liquidation_price(position: str | Column, entry: str | Column, balance: str | Column,
                      mmr: float) -> Column:
    """Price at which equity meets maintenance margin; NULL when flat."""
    p, e, b = _c(position), _c(entry), _c(balance)
    q = F.abs(p)
    return (F.when(p > 0, (q * e - b) / (q * (1.0 - mmr)))
            .when(p < 0, (b + q * e) / (q * (1.0 + mmr))))


def margin_equity(position: str | Column, entry: str | Column, balance: str | Column,
                  mark: str | Column) -> Column:
    return _c(balance) + (_c(mark) - _c(entry)) * _c(position)


def is_liquidated(position: str | Column, entry: str | Column, balance: str | Column,
                  mark: str | Column, mmr: float) -> Column:
    held = _c(position) != 0
    return held & (margin_equity(position, entry, balance, mark)
                   <= mmr * F.abs(_c(position)) * _c(mark))


def hashed_draw(n: Column, *parts: Column | str | int) -> Column:
    """Counter-based draw in [0, n): the first 8 hex digits of an MD5, modulo n."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), n)
