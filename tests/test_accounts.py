"""Equity with funding and interest against an event-by-event loop."""

import numpy as np
import pandas as pd
import pytest

from barlake.operators.tca import equity_account
from barlake.schemas import NS_DAY

YEAR = 365 * NS_DAY


def world(seed):
    """One run with most of the fills, in bursts; settlements and fills at mark times."""
    rng = np.random.default_rng(seed)
    fills, marks, funding = [], [], []
    for run, n in (("A", 300), ("B", 25), ("C", 0)):
        times = np.sort(rng.choice(80, n)) * NS_DAY // 2 + np.where(rng.random(n) < 0.3, 0, 7)
        left = 0
        for k, t in enumerate(times):
            buy = left <= 0 or rng.random() < 0.55
            units = int(rng.integers(1, 4000)) if buy else int(rng.integers(1, left + 1))
            left += units if buy else -units
            price = 100 + rng.normal(0, 5)
            fills.append((run, k, int(t), "buy" if buy else "sell", price, units / 1000, price * units * 5e-7))
        for k in range(0, 90):
            marks.append((run, k * NS_DAY // 2, 100 + rng.normal(0, 5)))
        for k in range(0, 45, 3):
            funding.append((run, k * NS_DAY, float(rng.normal(1e-4, 1e-3)), 100 + rng.normal(0, 5)))
    return fills, marks, funding


def looped(fills, marks, funding, cash0, apr):
    out = []
    for run in {m[0] for m in marks}:
        ev = [(t, 2, k, (side, price, qty, fee)) for r, k, t, side, price, qty, fee in fills if r == run]
        ev += [(t, 1, 0, None) for r, t, _ in marks if r == run] + [(t, 3, 0, c) for r, t, c in marks if r == run]
        ev += [(t, 0, 0, (rate, mark)) for r, t, rate, mark in funding if r == run]
        balance, debt, pos, clock, paid, interest = cash0, 0.0, 0, None, 0.0, 0.0
        for t, kind, _, x in sorted(ev, key=lambda e: e[:3]):
            if kind == 0:
                owed = x[0] * x[1] * pos / 1000
                paid += owed
                balance, debt = max(0.0, balance - debt - owed), max(0.0, debt - balance + owed)
            elif kind == 1:
                if clock is not None:
                    more = debt * apr * (t - clock) / YEAR
                    debt, interest = debt + more, interest + more
                clock = t
            elif kind == 2:
                side, price, qty, fee = x
                pos += round(qty * 1000) * (1 if side == "buy" else -1)
                if side == "buy":
                    cost = qty * price + fee
                    used = min(balance, cost)
                    balance, debt = balance - used, debt + cost - used
                else:
                    got = qty * price - fee
                    back = min(max(0.0, got), debt)
                    balance, debt = balance + got - back, debt - back
            else:
                out.append((run, t, pos / 1000, balance - debt, debt, paid, interest, balance - debt + pos / 1000 * x))
    return pd.DataFrame(out, columns=["run_id", "ts_ns", "position", "cash", "debt", "funding", "interest", "equity"])


FILLS = "run_id string, order_id long, ts_ns long, side string, price double, qty double, fee double"


@pytest.mark.parametrize(("apr", "with_funding"), [(0.0, True), (0.6, False), (0.6, True)])
def test_equity_equals_a_loop(spark, apr, with_funding):
    fills, marks, funding = world(4)
    want = looped(fills, marks, funding if with_funding else [], 400.0, apr)
    assert with_funding or (want.debt > 0).any() and (want.cash > 0).any() and want.interest.max() > 1
    got = equity_account(
        spark.createDataFrame(fills, FILLS).repartition(3),
        spark.createDataFrame(marks, "run_id string, ts_ns long, close double"), 400.0,
        spark.createDataFrame(funding, "run_id string, ts_ns long, rate double, mark double")
        if with_funding else None, apr, width=5 * NS_DAY).toPandas()
    both = got.merge(want, on=["run_id", "ts_ns"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(want)
    for c in ("position", "cash", "debt", "funding", "interest", "equity"):
        assert np.allclose(both[c], both[c + "_w"], rtol=1e-9, atol=1e-6), c


def test_accounts_of_nothing(spark):
    fills = spark.createDataFrame([], FILLS)
    marks = spark.createDataFrame([("A", 5, 1.0), ("A", 9, 2.0)], "run_id string, ts_ns long, close double")
    got = equity_account(fills, marks, 10.0, apr=0.1).collect()
    assert {(r.ts_ns, r.position, r.cash, r.equity, r.interest) for r in got} == {(5, 0, 10, 10, 0), (9, 0, 10, 10, 0)}
    assert equity_account(fills, marks.limit(0), 10.0, apr=0.1).collect() == []
