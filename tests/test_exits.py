"""Trade lists against bar-by-bar loops and hand-computed cases."""

import numpy as np
import pandas as pd
import pytest

from barlake.operators import chains, exits, features, signals

S = 10 ** 9


def crafted(spark, closes, volumes=None, violent=None):
    """Opens are previous closes; ranges are tight, but for one violently low bar."""
    rows = []
    for i, c in enumerate(closes):
        o = closes[i - 1] if i else c
        low = o - 10.0 if i == violent else min(o, c) - 0.5
        rows.append(("A", i * S, float(o), max(o, c) + 0.5, float(low), float(c),
                     float(volumes[i]) if volumes else 1.0))
    return spark.createDataFrame(
        rows, "symbol string, ts_ns long, open double, high double, low double, close double, volume double")


DIP = [5000.0, 5000.0, 4990.0, 4991.0, 4994.0, 4994.0, 4994.0]


def band(spark, bars, **more):
    z = features.zscore(bars, 3)
    return exits.band_exit_trades(z, bars, "z", 1.0, 0.2, 0.0, 5.0, **more).toPandas().sort_values("entry_ts")


def test_band_exits_by_rule_stop_and_hold(spark):
    t = band(spark, crafted(spark, DIP))
    assert list(t.entry_price)[0] == 4990.0 and t.direction.iloc[0] == 1
    assert t.exit_price.iloc[0] > t.entry_price.iloc[0] and t.reason.iloc[0] == "rule"
    t = band(spark, crafted(spark, [*DIP, 4990.0, 4990.0], violent=4), stop_bps=5.0)
    assert t.reason.iloc[0] == "stop" and t.exit_price.iloc[0] == pytest.approx(4990.0 * (1 - 5e-4))
    assert t.net.iloc[0] < 0 and t.exit_ts.iloc[0] == 4 * S
    t = band(spark, crafted(spark, [5000.0, 5000.0, 4990.0] + [4990.5] * 8), max_hold_bars=4)
    assert len(t) == 1 and t.entry_price.iloc[0] == 4990.0
    with pytest.raises(ValueError, match="beyond"):
        exits.band_exit_trades(None, None, "z", 0.5, 0.5, 0, 0)


def looped(bars, x, enter, leave, stop_bps, hold):
    """One position at a time, bar by bar: pending exits fill at the open, stops inside the bar, then the
    bar's own decision."""
    out, pos, entry, stop, leaving = [], 0, None, None, None
    o, h, lo, c, ts = (bars[k].to_numpy() for k in ("open", "high", "low", "close", "ts_ns"))
    for r in range(len(ts)):
        if pos and leaving:
            out.append((pos, ts[entry + 1], ts[r], o[r], leaving))
            pos = 0
        elif pos and stop is not None and r >= entry + 2 and (lo[r] <= stop if pos > 0 else h[r] >= stop):
            out.append((pos, ts[entry + 1], ts[r], min(o[r], stop) if pos > 0 else max(o[r], stop), "stop"))
            pos = 0
        elif pos:
            if x[r] is not None and (x[r] >= -leave if pos > 0 else x[r] <= leave):
                leaving = "rule"
            elif hold and r - entry >= hold:
                leaving = "hold"
        if not pos:
            leaving = None
            pos = 0 if x[r] is None else 1 if x[r] <= -enter else -1 if x[r] >= enter else 0
            if pos:
                entry = r
                stop = None if stop_bps is None else c[r] * (1 - pos * stop_bps / 1e4)
    return out


@pytest.mark.parametrize(("stop_bps", "hold"), [(None, None), (40.0, None), (40.0, 5), (5.0, 1)])
def test_band_exits_equal_a_bar_loop(spark, stop_bps, hold):
    rng = np.random.default_rng(3)
    frames, want = [], []
    for symbol, n in (("A", 700), ("B", 60), ("C", 3)):
        c = 100 + rng.normal(0, 0.4, n).cumsum()
        o = np.r_[c[0], c[:-1]] + rng.normal(0, 0.1, n)
        f = pd.DataFrame({"symbol": symbol, "ts_ns": np.arange(n) * 10 + (np.arange(n) > n // 2) * 5000,
                          "open": o, "high": np.maximum(o, c) + 0.2, "low": np.minimum(o, c) - 0.2, "close": c})
        f["z"] = np.where(np.arange(n) < 10, None, rng.normal(0, 1, n))
        frames.append(f)
        want += [(symbol, *t) for t in looped(f, f.z.to_numpy(), 1.2, 0.3, stop_bps, hold)]
    bars = spark.createDataFrame(pd.concat(frames).astype({"z": "float64"})).repartition(4)
    bars = bars.selectExpr("* EXCEPT (z)", "nullif(z, double('nan')) AS z")
    got = exits.band_exit_trades(bars, bars, "z", 1.2, 0.3, 0.0, 0.0, stop_bps, hold, width=900).toPandas()
    rows = [(t.symbol, t.direction, t.entry_ts, t.exit_ts, t.exit_open, t.reason) for t in got.itertuples()]
    assert sorted(rows) == sorted(want) and len(rows) > 20


def test_fixed_hold_goldens(spark):
    closes = [5000.0, 5000.0, 5000.0, 5005.0, 5006.0, 5007.0, 5008.0, 5009.0]
    bars = crafted(spark, closes, [10, 10, 10, 200, 10, 10, 10, 10])
    t = exits.fixed_hold_trades(signals.breakout(bars, 3, 2.0), bars, 2, 0.0, 5.0).collect()
    assert [(r.hold_ns, r.entry_price, r.exit_price, r.direction) for r in t] == [(2 * S, 5005.0, 5007.0, 1)]
    down = crafted(spark, [5010.0, 5010.0, 5010.0, 5004.0, 4990.0, 4988.0, 4986.0, 4984.0],
                   [10, 10, 10, 200, 10, 10, 10, 10])
    t = exits.fixed_hold_trades(signals.breakout(down, 3, 2.0), down, 2, 0.0, 5.0).collect()
    assert [(r.direction, r.entry_price, r.exit_price) for r in t] == [(-1, 5004.0, 4988.0)] and t[0].net > 0
    twice = crafted(spark, [5000.0, 5000.0, 5000.0, 5005.0, 5006.0, 5007.0, 5008.0, 5001.0, 5010.0, 5011.0,
                            5012.0, 5013.0, 5014.0], [200 if i in (3, 8) else 10 for i in range(13)])
    assert exits.fixed_hold_trades(signals.breakout(twice, 3, 2.0), twice, 2, 0.0, 5.0).count() == 2
    busy = crafted(spark, closes, [10, 10, 10, 200, 200, 200, 200, 200])
    assert exits.fixed_hold_trades(signals.breakout(busy, 3, 2.0), busy, 5, 0.0, 5.0).count() == 0


def test_a_trade_may_span_an_outage(spark):
    rows = [("A", t * S, 1.0 + i, 1.0, 1.0, 1.0) for i, t in enumerate([0, 1, 2, 10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2])]
    bars = spark.createDataFrame(rows, "symbol string, ts_ns long, open double, high double, low double, close double")
    events = spark.createDataFrame([("A", 0, "buy"), ("A", S, "sell"), ("A", 10 ** 6 * S, "sell")],
                                   "symbol string, ts_ns long, direction string")
    t = exits.fixed_hold_trades(events, bars, 3, 0.0, 0.0).collect()
    assert [(r.entry_ts, r.exit_ts) for r in t] == [(S, (10 ** 6 + 1) * S)]


def test_settlements_hold_goldens(spark):
    bars = spark.createDataFrame([("A", i * S, 5000.0) for i in range(300)],
                                 "symbol string, ts_ns long, open double")

    def trades(at, hold, rates):
        f = spark.createDataFrame([("A", t * S, r) for t, r in zip(at, rates, strict=True)],
                                  "symbol string, ts_ns long, rate double")
        e = signals.funding_percentile(f, 10, 90.0)
        return exits.settlement_hold_trades(e, bars, hold, S, 150_000_000, 0.0, 5.0).collect()

    t = trades(range(1, 8), 30, [1e-4] * 6 + [1e-3])
    assert [(r.entry_ts, r.hold_ns) for r in t] == [(7 * S, 31 * S)]  # the bar from 7 s closes at 8 s
    assert trades([1, 2], 50, [1e-4, 1e-3]) == []
    assert trades(range(1, 13), 30, [1e-4] * 12) == []
    assert len(trades(range(1, 10), 100, [1e-4] * 6 + [1e-3, 5e-4, 1e-3])) == 1


def greedy(s, e):
    free, out = -1, []
    for a, b in zip(s, e, strict=True):
        if a >= free:
            out.append(a)
            free = b
    return out


@pytest.mark.parametrize(("block", "longest"), [(4096, 30), (8, 30), (4, 300)])
def test_non_overlapping_by_levels(spark, monkeypatch, block, longest):
    monkeypatch.setattr(chains, "WIDER", 3)
    rng = np.random.default_rng(8)
    frames, want = [], []
    for key, n in (("A", 600), ("B", 1), ("C", 40)):
        s = np.sort(rng.choice(5000, n, replace=False))
        e = s + rng.integers(1, longest, n)
        frames.append(pd.DataFrame({"symbol": key, "entry_ts": s, "exit_ts": e}))
        want += [(key, a) for a in greedy(s, e)]
    rows = spark.createDataFrame(pd.concat(frames)).repartition(3)
    got = chains.non_overlapping(rows, width=500, block=block).collect()
    assert sorted((r.symbol, r.entry_ts) for r in got) == sorted(want)


def test_non_overlapping_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([("A", 1, 4), ("A", 1, 3), ("A", 3, None), ("A", 9, 10), (None, 1, 2), (None, 2, 3),
                                  ("A", None, 5)], "symbol string, entry_ts long, exit_ts long")
    got = {(r.symbol, r.entry_ts, r.exit_ts) for r in chains.non_overlapping(rows).collect()}
    assert got == {("A", 1, 3), ("A", 3, None), (None, 1, 2), (None, 2, 3)}
    assert chains.non_overlapping(rows.limit(0)).count() == 0
