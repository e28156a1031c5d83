"""Two-level scans, blocks, as-of and quantiles give what plain computation gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import features, signals, trades
from barlake.operators.asof import asof_join
from barlake.operators.quantiles import grouped_quantiles
from barlake.operators.series import running


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("A", 400), ("B", 37)):  # one symbol holds most rows
        ts = np.sort(rng.choice(np.arange(1, 4000), n, replace=False)) * 10
        frames.append(pd.DataFrame({
            "symbol": symbol, "ts_ns": ts, "close": 100 + rng.normal(size=n).cumsum(),
            "volume": rng.integers(1, 9, n).astype(float)}))
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).cache()


def by_time(df):
    return df.toPandas().sort_values(["symbol", "ts_ns"]).reset_index(drop=True)


def test_running_scans_across_slices(series):
    pdf, df = series
    got = by_time(running(df, {
        "s": ("sum", F.col("close")), "m": ("max", F.col("close")), "p": ("prev", F.col("close")),
        "l": ("last", F.when(F.col("volume") > 7, F.col("close")))}, width=130))
    g = pdf.groupby("symbol")["close"]
    np.testing.assert_allclose(got["s"], g.cumsum())
    np.testing.assert_allclose(got["m"], g.cummax())
    np.testing.assert_allclose(got["p"], g.shift())
    loud = pdf["close"].where(pdf["volume"] > 7)
    np.testing.assert_allclose(got["l"], loud.groupby(pdf["symbol"]).ffill())


def test_asof_reaches_over_empty_slices(series, spark):
    pdf, df = series
    probes = pd.DataFrame({"symbol": ["A", "B"] * 300, "at": np.arange(0, 60000, 100)})
    got = asof_join(spark.createDataFrame(probes), df, left_ts="at", values=["close"],
                    width=70).toPandas().sort_values(["symbol", "at"])
    want = pd.merge_asof(probes.sort_values("at"), pdf.sort_values("ts_ns"), left_on="at",
                         right_on="ts_ns", by="symbol").sort_values(["symbol", "at"])
    np.testing.assert_allclose(got["close"].astype(float), want["close"])


def test_block_size_does_not_matter(series):
    _, df = series
    small = by_time(features.zscore(df, 20, block_rows=7, width=90))
    large = by_time(features.zscore(df, 20, block_rows=4096, width=10**6))
    np.testing.assert_allclose(small["z"].astype(float), large["z"].astype(float))
    e1 = by_time(features.ema(df, 9, block_rows=16, width=90))["ema"]
    want = series[0].groupby("symbol")["close"].transform(
        lambda x: x.ewm(span=9, adjust=False).mean())
    np.testing.assert_allclose(e1, want, rtol=1e-12)


def test_nothing_before_a_cut_changes_when_later_rows_go(series):
    _, df = series
    whole = by_time(features.zscore(df, 20, block_rows=32, width=500))
    cut = by_time(features.zscore(df.where("ts_ns < 20000"), 20, block_rows=32, width=500))
    pd.testing.assert_frame_equal(cut, whole[whole["ts_ns"] < 20000].reset_index(drop=True))


@pytest.mark.parametrize("n", [5, 30000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.lognormal(size=n), 3)
    df = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, "a", "b"),
                                             "x": x}))
    got = grouped_quantiles(df, ["k"], "x", {"q10": 0.1, "med": 0.5, "q95": 0.95}).toPandas()
    for _, r in got.iterrows():
        part = x[np.where(np.arange(n) % 3 == 0, "a", "b") == r["k"]]
        np.testing.assert_allclose(r[["q10", "med", "q95"]].astype(float),
                                   np.quantile(part, [0.1, 0.5, 0.95]))


def test_band_positions_follow_the_bar_by_bar_rule(series):
    _, df = series
    rows = features.zscore(df, 10, width=10**6).where("z is not null").select(
        "symbol", "ts_ns", "z").cache()
    got = by_time(trades.band_positions(rows, "z", 1.2, 0.4, block_rows=13, width=300))
    for _, part in got.groupby("symbol"):
        state, want = 0, []
        for z in part["z"]:
            if state == 1:
                state = 0 if z >= -0.4 else 1
            elif state == -1:
                state = 0 if z <= 0.4 else -1
            else:
                state = 1 if z <= -1.2 else -1 if z >= 1.2 else 0
            want.append(state)
        assert part["position"].tolist() == want


def test_meanrev_goldens(spark):
    def events(closes):
        df = spark.createDataFrame([("A", i * 10**9, float(c)) for i, c in enumerate(closes)],
                                   "symbol string, ts_ns long, close double")
        out = signals.meanrev(df, 3, 1.0).toPandas().sort_values("ts_ns")
        return [(r.ts_ns // 10**9, r.direction) for r in out.itertuples()]

    assert events([5000, 5000, 4990, 4991, 4994, 4994]) == [(2, "buy"), (4, "sell")]
    assert events([5000, 5000, 4990, 4989, 4988, 4994]) == [(2, "buy"), (4, "buy"), (5, "sell")]


def test_null_keys_are_groups_of_quantiles(spark):
    rows = [("a", float(i)) for i in range(101)] + [(None, float(10 * i)) for i in range(101)] + [("b", None)]
    got = grouped_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.25}).collect()
    assert {(r.k, r.n, r.q) for r in got} == {("a", 101, 25.0), (None, 101, 250.0), ("b", 0, None)}


def test_missing_days_and_members_are_refused(spark):
    from barlake.operators.performance import curve_summary, equal_weight
    from barlake.schemas import NS_DAY

    marks = spark.createDataFrame([("A", d * NS_DAY, 1.0 + d) for d in (0, 1, 3)],
                                  "k string, ts_ns long, equity double")
    with pytest.raises(Exception, match="gaps"):
        curve_summary(marks, ["k"]).select("n_days").collect()
    assert curve_summary(marks.where(F.col("ts_ns") < 2 * NS_DAY), ["k"]).first().n_days == 1
    parts = [f"1.0D AS {c}" for c in ("net", "exposure", "turnover", "gross", "fee", "funding")]
    daily = spark.createDataFrame([("c", "A", 0), ("c", "B", 0), ("c", "A", 1)], "cell string, symbol string, ts_ns long")
    with pytest.raises(Exception, match="different days"):
        equal_weight(daily.selectExpr("*", *parts), ["cell"]).select("gross").collect()
