"""Structured Streaming over bars, trades and settlements.

Each stream reads a folder of Parquet files that grows, and resumes from its checkpoint.
``once`` drains what is there and stops; without it the query runs until stopped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from barlake.operators.bars import ohlcv
from barlake.schemas import NS_DAY


def stream_table(spark: SparkSession, path: str, schema: StructType,
                 max_files: int | None = None, glob: str = "*.parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a Parquet table, exactly once through the checkpoint."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("parquet").start(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished run dropped because they were behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
               for op in p["stateOperators"])


def event_time(ts: str = "ts_ns"):
    return F.timestamp_micros(F.call_function("div", F.col(ts), F.lit(1000)))


def closed_bars(bars: DataFrame, interval_ns: int, now_ns: int | None = None,
                delay: str = "0 seconds", since_ns: int | None = None) -> DataFrame:
    """Each closed bar once: repeats are dropped, bars behind the watermark are late.

    ``since_ns`` bounds how far back a fresh start reaches.
    """
    close = F.col("ts_ns") + interval_ns
    now = F.lit(now_ns) if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    kept = bars.where(close <= now)
    if since_ns is not None:
        kept = kept.where(F.col("ts_ns") >= since_ns)
    marked = kept.withColumn("_time", event_time()).withWatermark("_time", delay)
    return marked.dropDuplicatesWithinWatermark(["symbol", "ts_ns"]).drop("_time")


def stream_bars(trades: DataFrame, interval: str, delay: str = "0 seconds",
                order: str = "agg_id") -> DataFrame:
    """Bars of a trade stream; a bar is final once the watermark passes its end."""
    timed = trades.withColumn("_time", event_time()).withWatermark("_time", delay)
    bars = timed.groupBy(F.window("_time", interval), "symbol").agg(*ohlcv(order))
    start = (F.unix_micros("window.start") * 1000).alias("ts_ns")
    return bars.select("symbol", start, *[c for c in bars.columns if c not in ("window", "symbol")])


INDICATORS = ("symbol string, ts_ns long, ema double, z double, vwap double, vol double, "
              "flow double")
_STATE = ("last_ts long, ema double, day long, pv double, v double, closes array<double>, "
          "volumes array<double>, buys array<double>")


def _rolling(x: np.ndarray, window: int, out: np.ndarray, fn: Callable) -> None:
    """Fill ``out`` (aligned with the end of ``x``) where a full window exists."""
    if len(x) >= window:
        res = fn(np.lib.stride_tricks.sliding_window_view(x, window))
        n = min(len(res), len(out))
        out[len(out) - n:] = res[len(res) - n:]


def stream_indicators(bars: DataFrame, span: int, window: int, flow_window: int) -> DataFrame:
    """EMA, z-score, session VWAP, realized volatility and flow imbalance per symbol.

    State is the last average, the day's sums and the last window of values. Rows of a
    micro-batch are sorted by time; rows at or before the last one seen are dropped. The
    source's admission limit bounds the rows of one symbol in a micro-batch.
    """
    alpha, keep = 2.0 / (span + 1.0), max(window, flow_window) + 1

    def update(key: tuple, batches: Iterator[pd.DataFrame],
               state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get if state.exists else (-1, None, -1, 0.0, 0.0, [], [], [])
        last_ts, avg, day, pv, v, closes, volumes, buys = seen
        pdf = pd.concat(list(batches)).sort_values("ts_ns").drop_duplicates("ts_ns")
        pdf = pdf[pdf["ts_ns"] > last_ts]
        n = len(pdf)
        if not n:
            return
        close, vol = pdf["close"].to_numpy(float), pdf["volume"].to_numpy(float)
        buy, ts = pdf["taker_buy_volume"].to_numpy(float), pdf["ts_ns"].to_numpy()
        seeded = close if avg is None else np.concatenate([[avg], close])
        ema = pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-n:]
        days = ts // NS_DAY
        part = pd.DataFrame({"d": days, "pv": close * vol, "v": vol})
        sums = part.groupby("d")[["pv", "v"]].cumsum()
        carried = (days == day).astype(float)
        spv, sv = sums["pv"].to_numpy() + carried * pv, sums["v"].to_numpy() + carried * v
        vwap = np.divide(spv, sv, out=np.full(n, np.nan), where=sv != 0)
        c = np.concatenate([closes, close])
        z, rv, flow = (np.full(n, np.nan) for _ in range(3))

        def score(x: np.ndarray) -> np.ndarray:
            sd = x.std(axis=1)
            return np.where(sd > 0, (x[:, -1] - x.mean(axis=1)) / np.where(sd > 0, sd, 1), np.nan)

        _rolling(c, window, z, score)
        _rolling(np.diff(c) / c[:-1], window, rv, lambda x: x.std(axis=1))
        allv, allb = np.concatenate([volumes, vol]), np.concatenate([buys, buy])
        total, bought = np.full(n, np.nan), np.full(n, np.nan)
        _rolling(allv, flow_window, total, lambda x: x.sum(axis=1))
        _rolling(allb, flow_window, bought, lambda x: x.sum(axis=1))
        some = ~np.isnan(total) & (total != 0)
        flow[some] = 2.0 * bought[some] / total[some] - 1.0
        state.update((int(ts[-1]), float(ema[-1]), int(days[-1]), float(spv[-1]), float(sv[-1]),
                      c[-keep:].tolist(), allv[-keep:].tolist(), allb[-keep:].tolist()))
        out = pd.DataFrame({"symbol": key[0], "ts_ns": ts, "ema": ema, "z": z, "vwap": vwap,
                            "vol": rv, "flow": flow})
        yield out.astype(object).where(out.notna(), None)

    narrow = bars.select("symbol", "ts_ns", "close", "volume", "taker_buy_volume")
    return narrow.groupBy("symbol").applyInPandasWithState(
        update, INDICATORS, _STATE, "append", GroupStateTimeout.NoTimeout)


PAYMENTS = "symbol string, ts_ns long, rate double, mark double, late boolean"


_WAITING = ("bar_ts array<long>, bar_close array<double>, wait_ts array<long>, "
            "wait_rate array<double>, done array<long>, floor long")


def stream_settlements(bars: DataFrame, settlements: DataFrame,
                       keep_ns: int = 7 * NS_DAY) -> DataFrame:
    """Each settlement once, marked with the last bar close before it, however the two inputs
    are cut into micro-batches.

    Bars of a symbol arrive in order; ``ts_ns`` is their close time. A settlement waits until
    a bar at or after its time has been seen, so all earlier bars have. State holds the bars
    and settlement times of the last ``keep_ns`` before the newest bar: a settlement that
    arrives later than that is flagged late instead of applied, and repeats are dropped.
    """
    a = bars.select("symbol", "ts_ns", F.lit(1).alias("tag"), F.col("close").alias("x"))
    b = settlements.select("symbol", "ts_ns", F.lit(0).alias("tag"), F.col("rate").alias("x"))

    def update(key: tuple, batches: Iterator[pd.DataFrame],
               state: GroupState) -> Iterator[pd.DataFrame]:
        bar_ts, bar_close, wait_ts, wait_rate, done, floor = (
            state.get if state.exists else ([], [], [], [], [], -1))
        closes = dict(zip(bar_ts, bar_close, strict=True))
        waiting = dict(zip(wait_ts, wait_rate, strict=True))
        applied = set(done)
        out = []
        for pdf in batches:
            for ts, tag, x in zip(pdf["ts_ns"].tolist(), pdf["tag"].tolist(), pdf["x"].tolist(),
                                  strict=True):
                if tag == 1:
                    closes[ts] = x
                elif ts <= floor:
                    out.append((key[0], ts, x, None, True))
                elif ts not in applied:
                    waiting.setdefault(ts, x)
        times = sorted(closes)
        newest = times[-1] if times else -1
        for ts in sorted(t for t in waiting if t <= newest):
            k = bisect_left(times, ts)
            out.append((key[0], ts, waiting.pop(ts), closes[times[k - 1]] if k else None, False))
            applied.add(ts)
        floor = max(floor, newest - keep_ns)
        first = max(bisect_left(times, floor) - 1, 0)  # the bar before the floor still serves
        times = times[first:]
        state.update((times, [closes[t] for t in times], list(waiting), list(waiting.values()),
                      sorted(t for t in applied if t > floor), floor))
        if out:
            yield pd.DataFrame(out, columns=["symbol", "ts_ns", "rate", "mark", "late"])

    return a.unionByName(b).groupBy("symbol").applyInPandasWithState(
        update, PAYMENTS, _WAITING, "append", GroupStateTimeout.NoTimeout)
