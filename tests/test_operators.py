"""Hand-computed values of bars, edges, models, fills and verdicts."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import bars, crosssection, edge, models, quality, tca, verdicts
from barlake.schemas import NS_DAY, NS_SECOND

S = NS_SECOND
BAR = ("symbol string, ts_ns long, open double, high double, low double, close double, "
       "volume double, quote_volume double, n_trades long, taker_buy_volume double, "
       "taker_buy_quote_volume double")


def second_bars(spark, n, start=0):
    rows = [("A", (start + i) * S, 100 + 0.1 * i, 100.15 + 0.1 * i, 99.95 + 0.1 * i,
             100.12 + 0.1 * i, i + 1.0, 1.0, i + 1, 0.5, 0.5) for i in range(n)]
    return spark.createDataFrame(rows, BAR)


def test_resample_keeps_whole_buckets(spark):
    got = bars.resample_bars(second_bars(spark, 12), 5 * S).toPandas()
    assert len(got) == 2 and got["volume"].min() == 15 and got["n_trades"].min() == 15
    assert bars.resample_bars(second_bars(spark, 185), 60 * S).count() == 3
    assert bars.resample_bars(second_bars(spark, 180, 5), 60 * S).count() == 2


def test_gap_report(spark):
    df = second_bars(spark, 10).where(F.col("ts_ns") != 4 * S)
    got = quality.check_bars(df, S).toPandas()
    assert got[["kind", "detail"]].values.tolist() == [["gap", "1 missing bars"]]


def test_forward_returns(spark):
    closes = spark.createDataFrame([("A", i * S, 100.0 + i) for i in range(10)],
                                   "symbol string, ts_ns long, close double")
    events = spark.createDataFrame(
        [("A", 0, "buy"), ("A", 0, "sell"), ("A", 6 * S // 10, "buy"), ("A", 9 * S, "buy"),
         ("A", 8 * S, "buy"), ("A", -5 * S, "buy")], "symbol string, ts_ns long, direction string")
    out = edge.forward_outcomes(events, closes, [S, 5 * S], width=3 * S).toPandas()

    def ret(ts, direction, h):
        r = out[(out.ts_ns == ts) & (out.direction == direction) & (out.horizon_ns == h)]
        return r["ret_bps"].iloc[0]

    assert ret(0, "buy", S) == pytest.approx(100)
    assert ret(0, "sell", S) == pytest.approx(-100)
    assert ret(6 * S // 10, "buy", S) == pytest.approx(100)
    assert pd.isna(ret(9 * S, "buy", S))
    assert ret(8 * S, "buy", 5 * S) == pytest.approx(1 / 108 * 1e4)
    assert pd.isna(ret(-5 * S, "buy", S))


def test_edge_table(spark):
    closes = spark.createDataFrame([("A", i * S, 100.0 + i) for i in range(10)],
                                   "symbol string, ts_ns long, close double")
    events = spark.createDataFrame([("A", 0, "buy")], "symbol string, ts_ns long, direction string")
    out = edge.forward_outcomes(events, closes, [S])
    r = edge.edge_table(out, (), {"taker": 50.0}).toPandas().iloc[0]
    assert [r.mean_bps, r.hit_rate, r.mfe_bps, r.mae_bps, r.edge_bps] == pytest.approx(
        [100, 1, 100, 0, 50])


def test_cross_section_spread(spark):
    rows = [(f"S{k}", i * NS_DAY, 100 * g**i, 1.0)
            for k, g in enumerate((1.01, 1.005, 1.0025, 0.99)) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, ts_ns long, close double, quote_volume double")
    got = crosssection.spread_summary(
        crosssection.bucket_returns(df, [(7, 1)]), [0.0]).toPandas().iloc[0]
    assert got.top_mean_bps == pytest.approx(100) and got.bottom_mean_bps == pytest.approx(-100)
    assert got.spread_mean_bps == pytest.approx(200) and got.hit_rate == 1
    two = df.where("symbol in ('S0', 'S1') and ts_ns < 2592000000000000")
    assert crosssection.bucket_returns(two, [(5, 1)]).count() == 24


def test_carry_price_return(spark):
    legs = spark.createDataFrame(
        [("P", 0, 100.0, 110.0), ("P", NS_DAY, 100.0, 100.0), ("P", 2 * NS_DAY, 100.0, 100.0)],
        "pair string, ts_ns long, spot double, perp double")
    none = spark.createDataFrame([], "pair string, ts_ns long, rate double")
    cell = models.CarryCell("c", 1, 0.0, -1.0, 0.0, -1.0, 0.0, 0.0)
    got = models.carry_model(legs, none, [cell]).orderBy("ts_ns").toPandas()
    assert got["position"].tolist() == [1.0, 1.0] and got["gross"].iloc[0] == pytest.approx(10 / 210)
    with pytest.raises(ValueError):
        models.carry_model(legs, none, [models.CarryCell("c", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)])


def test_flow_screen(spark):
    rows = [("x", i * NS_DAY, d, 0.0, 100.0, 500.0, 150.0)
            for i, d in enumerate([100.0, 100.0, 900.0, 100.0])]
    df = spark.createDataFrame(rows, "set string, ts_ns long, deposit double, withdraw double, "
                                     "close double, entry double, exit double")
    got = models.flow_screen(df, 1, 10.0).orderBy("ts_ns").toPandas()
    assert got["position"].tolist() == [0, 0, -1, 0]
    assert (got["fee"] * 1e4).round(9).tolist() == [0, 0, 10, 10]


def test_market_fill_on_the_tape(spark):
    ms = 10**6
    tape = spark.createDataFrame(
        [("A", (i + 1) * 100 * ms, 5000.0 + i / 10, 1.0, i, False) for i in range(5)],
        "symbol string, ts_ns long, price double, qty double, agg_id long, buyer_is_maker boolean")
    orders = spark.createDataFrame(
        [(1, "A", "buy", 0.5, 100 * ms), (2, "A", "buy", 1.5, 250 * ms), (3, "A", "buy", 9.0, 0),
         (4, "A", "sell", 1.0, 0)],
        "order_id long, symbol string, side string, qty double, arrive_ns long")
    got = tca.market_fills(orders, tape, width=150 * ms, qty_width=1.0).toPandas().set_index("order_id")
    assert (got.fill_ts[1], got.fill_price[1]) == (100 * ms, pytest.approx(5000.0))
    assert got.fill_price[2] == pytest.approx((5000.2 + 0.5 * 5000.3) / 1.5)
    assert pd.isna(got.fill_price[3]) and pd.isna(got.fill_price[4])


def test_verdict(spark):
    runs = spark.createDataFrame(
        [("good", 350, 1.5, 2.5, 1.4, 0.10, True, 0.8), ("bad", 350, 1.5, None, 1.4, 0.10, True, 0.8)],
        "run_id string, n_trades long, expectancy_bps double, t_stat double, profit_factor double, "
        "max_drawdown double, stress_ok boolean, pct_positive_folds double")
    table = verdicts.criteria(runs)
    assert table.where("run_id = 'good'").count() == 7
    got = verdicts.verdict(table).toPandas().set_index("run_id")
    assert bool(got.go["good"]) and not bool(got.go["bad"]) and got.n_failed["bad"] == 1


@pytest.mark.parametrize("named", [False, True])
def test_round_trips_close_at_any_size(spark, named):
    """Split fills on each instrument's own step, sizes from 1e-4 to 1e12: every trip is found."""
    from barlake.operators.trades import round_trips

    rows, rng = [], np.random.default_rng(7)
    for k, (size, step) in enumerate(((1e-4, "0.00000001"), (1e6, "0.001"), (1e8, "0.001"), (1e12, "0.01"))):
        for i in range(500):
            whole = int(rng.integers(3, int(size / float(step)) + 4))
            a = int(rng.integers(1, whole - 1))
            c = int(rng.integers(1, whole))
            units = [("buy", a), ("buy", whole - a), ("sell", c), ("sell", whole - c)]
            for j, (side, n) in enumerate(units):
                qty = float(Decimal(n) * Decimal(step))
                rows.append((f"r{k}", i * 4 + j, i * 4 + j, side, 100.0, qty, 0.0, float(step)))
    fills = spark.createDataFrame(rows, "run_id string, order_id long, ts_ns long, side string, "
                                        "price double, qty double, fee double, qty_step double")
    trips = round_trips(fills, step="qty_step" if named else None)
    assert {r.run_id: r["count"] for r in trips.groupBy("run_id").count().collect()} == {
        f"r{k}": 500 for k in range(4)}


def test_newey_west_at_long_lags(spark):
    from barlake.operators.performance import newey_west

    rng = np.random.default_rng(3)
    x = rng.normal(size=400).cumsum() * 0.01 + rng.normal(size=400) + 0.3
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)],
                               "k string, ts_ns long, x double")
    for lag in (0, 1, 20, 89, 200):
        d = x - x.mean()
        var = (d @ d + 2 * sum((1 - k / (lag + 1)) * (d[k:] @ d[:-k]) for k in range(1, lag + 1))
               ) / len(x)
        got = newey_west(df, "x", ["k"], lag, "t").first().t
        want = x.mean() / np.sqrt(var / len(x)) if var > 0 else None
        assert got == (None if want is None else pytest.approx(want, rel=1e-9))


def test_market_fill_price_does_not_depend_on_past_volume(spark):
    from barlake.operators.tca import market_fills

    tape = [("S", 1, 1, 60_000.0, 4e8, False), ("S", 2, 2, 60_000.0, 5e9, False),
            ("S", 10, 3, 60_001.0, 0.001, False), ("S", 11, 4, 60_003.0, 5.0, False)]
    orders = [(1, "S", "buy", 0.002, 5), (2, "S", "buy", 1e12, 5), (3, "S", "sell", 1.0, 5)]
    got = {r.order_id: r for r in market_fills(
        spark.createDataFrame(orders, "order_id long, symbol string, side string, qty double, arrive_ns long"),
        spark.createDataFrame(tape, "symbol string, ts_ns long, agg_id long, price double, qty double, "
                                    "buyer_is_maker boolean")).collect()}
    assert got[1].fill_ts == 11 and got[1].fill_price == pytest.approx(60_002.0, abs=1e-4)
    assert got[2].fill_price is None and got[3].fill_price is None


def test_null_keys_and_times_keep_their_rows(spark):
    from barlake.operators.series import running, with_row_index

    df = spark.createDataFrame([(None, 1, 2.0), ("a", None, 3.0), ("a", 5, 4.0)],
                               "symbol string, ts_ns long, x double")
    assert with_row_index(df).count() == 3
    assert running(df, {"s": ("sum", df.x)}).count() == 3
