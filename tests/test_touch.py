"""First touch by the pyramid against plain scans."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import tca, touch


def tape_and_orders(seed, n=400, m=120):
    rng = np.random.default_rng(seed)
    ts = np.sort(rng.integers(0, 3 * n, n))  # bursts and equal times
    ts[n // 3:n // 2] = ts[n // 3]
    tape = pd.DataFrame({"symbol": np.where(rng.random(n) < 0.8, "A", "B"), "ts_ns": ts,
                         "price": 100 + np.round(rng.normal(0, 1, n).cumsum(), 1), "agg_id": range(n)})
    at = rng.integers(-5, 3 * n + 5, m)
    orders = pd.DataFrame({"order_id": range(m), "symbol": rng.choice(["A", "B", "C"], m), "arrive_ns": at,
                           "limit_price": 100 + np.round(rng.normal(0, 8, m), 1),
                           "side": rng.choice(["buy", "sell"], m)})
    return tape, orders


def scanned(tape, o, strict):
    rows = tape[(tape.symbol == o.symbol) & (tape.ts_ns >= o.arrive_ns)].sort_values(["ts_ns", "agg_id"])
    p = rows.price
    if o.side == "buy":
        hit = rows[p < o.limit_price] if strict else rows[p <= o.limit_price]
    else:
        hit = rows[p > o.limit_price] if strict else rows[p >= o.limit_price]
    return (int(hit.ts_ns.iloc[0]), hit.price.iloc[0], int(hit.agg_id.iloc[0])) if len(hit) else (None,) * 3


@pytest.mark.parametrize(("fan", "strict"), [(2, True), (3, False), (64, True)])
def test_first_touch_equals_a_scan(spark, fan, strict):
    tape, orders = tape_and_orders(fan)
    hit = touch.first_touch(spark.createDataFrame(orders), spark.createDataFrame(tape).repartition(3),
                            "limit_price", F.col("side") == "buy", strict, values=["price", "agg_id"],
                            tie=["agg_id"], width=50, fan=fan)
    got = {r.order_id: (r.hit_ts_ns, r.hit_price, r.hit_agg_id) for r in hit.collect()}
    assert got == {o.order_id: scanned(tape, o, strict) for o in orders.itertuples()}


def test_first_touch_of_nulls_and_nothing(spark):
    tape = spark.createDataFrame([("A", 1, 10.0), ("A", None, 1.0), (None, 2, 5.0), ("A", 3, None),
                                  ("A", 4, float("nan")), ("A", 5, 12.0)],
                                 "symbol string, ts_ns long, price double")
    orders = spark.createDataFrame(
        [(1, "A", 0, 2.0, True), (2, None, 0, 6.0, True), (3, "A", None, 99.0, True), (4, "A", 0, None, True),
         (5, "A", 2, 11.0, False), (5, "A", 2, 11.0, False), (6, "A", 2, 12.5, False)],
        "order_id int, symbol string, arrive_ns long, limit_price double, down boolean")
    got = touch.first_touch(orders, tape, "limit_price", F.col("down"), True, fan=2)
    assert sorted((r.order_id, r.hit_ts_ns) for r in got.collect() if r.hit_ts_ns) == [
        (2, 2), (5, 5), (5, 5)]
    assert got.count() == 7
    none = touch.first_touch(orders, tape.limit(0), "limit_price", F.col("down"), True)
    assert none.where("hit_ts_ns IS NULL").count() == 7
    assert touch.first_touch(orders.limit(0), tape, "limit_price", F.col("down"), True).count() == 0


def test_a_long_series_is_never_listed(spark):
    """1e5 orders on seven years of hourly rows; every join is on a key, none sees over FAN rows."""
    hours = 7 * 365 * 24
    tape = spark.range(hours).select(
        F.lit("A").alias("symbol"), (F.col("id") * 3600).alias("ts_ns"), F.col("id").alias("agg_id"),
        (100 + 50 * F.sin(F.col("id") / 5000) + F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("price"))
    orders = spark.range(100_000).select(
        F.col("id").alias("order_id"), F.lit("A").alias("symbol"),
        F.pmod(F.xxhash64("id"), F.lit(hours * 3600)).alias("arrive_ns"),
        (50 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 100).alias("limit_price"),
        F.when(F.col("id") % 2 == 0, "buy").otherwise("sell").alias("side"))
    fills = tca.limit_fills(orders, tape, width=3600 * 2000)
    plan = fills._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    got = fills.toPandas().set_index("order_id")
    t, o = tape.toPandas(), orders.toPandas()
    p, sample = t.price.to_numpy(), o.iloc[::997]
    for r in sample.itertuples():
        start = -(-r.arrive_ns // 3600)
        hit = np.flatnonzero(p[start:] < r.limit_price if r.side == "buy" else p[start:] > r.limit_price)
        want = (start + hit[0]) * 3600 if len(hit) else None
        at = got.loc[r.order_id, "fill_ts"]
        assert (None if pd.isna(at) else int(at)) == want
    assert got["fill_ts"].notna().sum() > 50_000
