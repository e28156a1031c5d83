"""Statistics of accounts whose value falls below zero."""

import json
import random

import duckdb
import pandas as pd
import pytest

from barlake.operators import performance
from barlake.plans import registry
from barlake.plans import run_queries as rq
from barlake.plans.checks import differences
from barlake.schemas import NS_DAY, NS_HOUR

CURVES = {"a": [10.0, 5.0, -5.0, -2.0, 4.0, 6.0], "b": [-1.0, -2.0, 3.0, 6.0], "c": [1.0, 2.0]}
TRADES = {"a": [3.0, -1.0, 2.0], "b": [1.0, -2.0]}


def curve_rows(spark, unit):
    rows = [(k, i * unit, e) for k, c in CURVES.items() for i, e in enumerate(c)]
    return spark.createDataFrame(rows, "run_id string, ts_ns long, equity double")


def trip_rows(spark):
    rows = [(k, n, 10.0, 1.0, n, 0.1, 0.0, 0.0, 10) for k, t in TRADES.items() for n in t]
    return spark.createDataFrame(rows, "run_id string, net double, entry_price double, qty double, "
                                 "gross double, fees double, slippage double, funding double, hold_ns long")


def from_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows.toPandas())
    return con.sql(sql).df()


def test_run_metrics_follow_their_sql_below_zero(spark):
    equity, trips = curve_rows(spark, NS_HOUR), trip_rows(spark)
    got = performance.run_metrics(equity, trips, NS_HOUR).toPandas()
    got["hold_s"] = got.pop("avg_hold_ns") / 1e9
    want = from_sql(rq.RUN_METRICS, equity=equity, trips=trips)
    assert differences(got, want[list(got.columns)]) == []
    total = got.set_index("run_id").total_return
    assert total["a"] == pytest.approx(-0.4) and total["c"] == 1.0 and total.isna()["b"]


def test_regime_metrics_follow_their_sql_below_zero(spark):
    labels = curve_rows(spark, NS_HOUR).selectExpr("*", "CASE WHEN ts_ns < 3 * 3600000000000L THEN 'low' ELSE 'high' END AS label")
    got = performance.equity_metrics(labels, NS_HOUR, ["run_id", "label"]).toPandas()
    want = from_sql(rq.EQ_METRICS.format(k="run_id, label", a=rq.ANNUAL, src="labels"), labels=labels)
    assert differences(got, want[list(got.columns)]) == []
    assert got.set_index(["run_id", "label"]).total_return.isna()["a", "high"]


def test_runs_without_trades_are_compared(spark):
    equity, trips = curve_rows(spark, NS_HOUR), trip_rows(spark)
    runs = performance.run_metrics(equity, trips, NS_HOUR)
    runs = runs.withColumn("hold_s", runs["avg_hold_ns"] / 1e9).drop("avg_hold_ns")
    got = performance.compare_runs(runs).toPandas()
    want = from_sql(f"""SELECT metric, run_id, value FROM (SELECT run_id, COLUMNS(* EXCLUDE (run_id))::DOUBLE
        FROM ({rq.RUN_METRICS})) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (run_id))))""",
                    equity=equity, trips=trips)
    assert differences(got, want) == []
    assert got[(got.run_id == "c") & (got.metric == "n_trades")].value.tolist() == [0.0]


def test_growth_of_a_curve_that_ends_below_zero_is_null(spark):
    days = {"a": [5.0, 2.0, -3.0], "b": [4.0, 0.0, 9.0], "c": [0.0, 1.0, 2.0], "d": [1.0, 2.0, 0.0], "e": [7.0]}
    marks = spark.createDataFrame([(k, i * NS_DAY, v) for k, c in days.items() for i, v in enumerate(c)],
                                  "run_id string, ts_ns long, equity double")
    got = {r.run_id: r for r in performance.curve_summary(marks, ["run_id"]).collect()}
    assert [got[k].cagr for k in "ace"] == [None, None, None]
    assert got["a"].total_return == pytest.approx(-1.6) and got["d"].cagr == -1.0
    assert got["b"].n_days == 1 and got["c"].total_return is None and got["e"].n_days == 0


def ticks_of(run, n, copies=1, apart=0, step=0.0, zero=()):
    """``n`` hours of ``copies`` ticks each, ``apart`` microseconds and ``step`` of value from each other; prices
    of 0 at ``zero``."""
    draw, rows = random.Random(run), []
    for i in range(n):
        k, value = (-1000, 0.0) if i in zero else (draw.randint(-300, 900), round(draw.random() * 100, 2))
        rows += [(f"{run}{i:05d}{c}", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i, microseconds=c * apart), i % 7,
                  run, value + c * step, f'{{"k": {k}}}') for c in range(copies)]
    return rows


REGIME_TICKS = {
    "short runs": ticks_of("1", 40) + ticks_of("2", 48) + ticks_of("3", 49) + ticks_of("4", 200),
    "repeated times": random.Random(5).sample(ticks_of("1", 60, copies=4, step=7.0), 240),
    "equal windows": ticks_of("1", 400, copies=6, apart=1) + ticks_of("2", 400, copies=6, apart=1),
    "prices of zero": ticks_of("1", 300, zero=(50, 51, 120)) + ticks_of("2", 100),
}


@pytest.mark.parametrize("case", REGIME_TICKS)
def test_regime_query_follows_its_sql(spark, tmp_path, case):
    events = pd.DataFrame(REGIME_TICKS[case], columns="event_id ts user_id event_type value props".split())
    con = duckdb.connect()
    con.register("given", events)
    con.sql("SELECT * REPLACE (event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts) FROM given").write_parquet(
        f"{tmp_path}/events.parquet")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    registry.load_all()
    got = registry.QUERIES["a20_regime_metrics"](spark, str(tmp_path)).toPandas()
    assert differences(got, con.sql(registry.ORACLES["a20_regime_metrics"]).df()) == []
    if case == "short runs":
        labels = got.groupby("run_id").label.apply(set)
        assert labels["1"] == labels["2"] == {"low"} and len(labels["3"]) == len(labels["4"]) == 3


def test_round_trips_take_ticks_of_one_time_by_id(spark, tmp_path):
    rows = random.Random(6).sample(ticks_of("1", 60, copies=5, step=7.0) + ticks_of("2", 41, copies=4, step=3.0), 464)
    events = pd.DataFrame(rows, columns="event_id ts user_id event_type value props".split())
    con = duckdb.connect()
    con.register("given", events)
    con.sql("SELECT * REPLACE (event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts) FROM given").write_parquet(
        f"{tmp_path}/events.parquet")
    want = []
    for run in "12":
        own = sorted((ts, int(i), 100.0 + json.loads(props)["k"] / 10.0 + value / 1000.0, round(1.0 + value / 10.0, 3))
                     for i, ts, _, symbol, value, props in rows if symbol == run)
        for (start, _, p, a), (_, _, q, b), (end, _, r, _) in zip(own[::3], own[1::3], own[2::3], strict=False):
            want.append((run, start.value, end.value, round(a, 6), round(p, 6), round(r, 6),
                         round((a + b) * r - a * p - b * q, 4)))
    registry.load_all()
    got = registry.QUERIES["a21_w20_round_trips"](spark, str(tmp_path)).collect()
    assert {r.side for r in got} == {"buy"}
    assert sorted((r.run_id, r.entry_ts, r.exit_ts, r.qty, r.entry_price, r.exit_price, round(r.gross, 4))
                  for r in got) == [pytest.approx(w) for w in sorted(want)]
