"""Plans that keep a task's memory and the shuffled rows from growing faster than the input."""

from itertools import accumulate

from pyspark.sql import functions as F

from barlake.operators import flows, resampling, touch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_touch_sorts_no_matches(spark, monkeypatch):
    plans = []
    settle = touch.settle
    monkeypatch.setattr(touch, "settle", lambda df, name: plans.append(plan(df)) or settle(df, name))
    tape = spark.range(500).selectExpr("'A' AS symbol", "id AS ts_ns", "CAST(pmod(id * 37, 101) AS DOUBLE) AS price",
                                       "id AS agg_id")
    orders = spark.range(0, 500, 7).selectExpr("'A' AS symbol", "id AS arrive_ns", "CAST(pmod(id, 90) AS DOUBLE) AS lim")
    hits = touch.first_touch(orders, tape, "lim", F.lit(True), False, tie=["agg_id"], fan=4)
    plans.append(plan(hits))
    assert not [p for p in plans[-3:] if "SortAggregate" in p]
    prices = [(i * 37) % 101 for i in range(500)]
    for r in hits.collect():
        want = next((i for i in range(r.arrive_ns, 500) if prices[i] <= r.lim), None)
        assert r.hit_ts_ns == want and r.hit_price == (None if want is None else prices[want])


def paid_rows(spark):
    rows = [(t, [f"a{t % 3}", f"b{t % 5}", "a0", None], float(t), t) for t in range(60)]
    return spark.createDataFrame(rows, "tx_id long, addresses array<string>, value double, ts_ns long")


def test_top_receivers_deal_pairs_to_enough_tasks(spark):
    def top(**given):
        found = flows.top_receivers(paid_rows(spark), 0, 60, 5, 4, **given)
        return [(r.address, r.received, r.funding_txs) for r in found.collect()]

    assert top(task_rows=16) == top() and top()[0] == ("a0", 1770.0 + 570.0, 60)
    assert "REPARTITION_BY_NUM" in plan(flows.top_receivers(paid_rows(spark), 0, 60, 5, 4, task_rows=16))


def test_two_sided_flows_drop_rows_before_they_are_dealt(spark, tmp_path):
    paid = paid_rows(spark)
    hubs = spark.createDataFrame([("a0",), ("b1",), ("a0",)], "address string")
    both = flows.two_sided_flows(paid, paid.where("tx_id < 2"), hubs, 0, 60)
    assert "LeftSemi" not in plan(both)
    (row,) = both.collect()
    want = sum(t * (1 + (t % 3 == 0) + (t % 5 == 1)) for t in range(60))
    assert (row.in_amount, row.in_txs, row.out_amount, row.out_txs) == (want, 60, 2.0, 2)
    none = flows.two_sided_flows(paid, paid, hubs.where("address = 'x'"), 0, 60)
    assert none.collect() == []


def test_bootstrap_paths_are_dealt_and_scanned_once(spark, monkeypatch):
    seen, plans = {}, {}
    settle = resampling.settle

    def kept(df, name):
        plans[name], seen[name] = plan(df), settle(df, name)
        return seen[name]

    monkeypatch.setattr(resampling, "settle", kept)
    draws = {}
    paths = resampling._paths

    def drawn(*given):
        found = paths(*given)
        for r in found.collect():
            draws.setdefault((r.run_id, r.sim), []).append((r.step, r.value))
        return found

    monkeypatch.setattr(resampling, "_paths", drawn)
    trades = spark.range(20).selectExpr("CASE WHEN id < 14 THEN 'A' ELSE 'B' END AS run_id", "id AS ts_ns",
                                        "CAST(pmod(id * 7, 11) - 5 AS DOUBLE) AS net")
    resampling.bootstrap_trades(trades, 6, 3, 4.0, slice_steps=3)
    ends = {(r.run_id, r.sim): (r.final, r.dd, r._steps) for r in seen["paths"].collect()}
    assert plans["slices"].count("Window") <= 2 and "SortMergeJoin" not in plans["paths"]
    assert len(ends) == 12
    for key, steps in draws.items():
        total = list(accumulate(v for _, v in sorted(steps)))
        want = max(max(total[:i + 1]) - total[i] for i in range(len(total)))
        assert ends[key] == (total[-1], want, len(total))
