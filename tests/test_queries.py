"""Contract of the registered queries, and a few of them against their SQL."""

import pytest

import __spark_entry__ as entry
from barlake.plans.checks import differences, duck


def test_contract():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert entry.FLAGSHIP in queries and set(sqls) <= set(queries) and len(queries) > 120


@pytest.mark.parametrize("name", [
    "a1_bars_from_trades", "a4_u1_quality_report", "a10_edge_table", "a21_w20_round_trips",
    "a28_combine_legs", "a35_compare_runs", "j1_asof_strict", "j8_alignment", "j13_leg_basis",
    "m3_skipped_symbols", "m4_a24_a29_cross_section_study", "m5_j5_trend_model",
    "m7_w21_w22_carry_model", "p16_daily_marks", "r1_r4_closed_bars", "r2_late_rows",
    "r3_r7_stream_settlements", "r6_stream_bars", "r8_r9_resume", "s8_s9_catalog", "w2_zscore",
    "x2_market_fills", "x3_j14_limit_fills"])
def test_query_matches_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert differences(got, duck(sf).sql(entry.oracle_sql()[name]).df()) == []
