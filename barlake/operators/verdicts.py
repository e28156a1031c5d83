"""Pass/fail verdicts over tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds (fixed values).
THRESHOLDS = {
    "min_trades": 300, "min_t_stat": 2.0, "min_profit_factor": 1.2,
    "min_positive_folds": 0.7, "max_drawdown": 0.25,
}


# Criterion, its input, how it compares, and the limit or the threshold's name.
CRITERIA = [
    ("trades", "n_trades", ">=", "min_trades"),
    ("expectancy", "expectancy_bps", ">", 0.0),
    ("t_stat", "t_stat", ">=", "min_t_stat"),
    ("profit_factor", "profit_factor", ">=", "min_profit_factor"),
    ("drawdown", "max_drawdown", "<=", "max_drawdown"),
    ("stress", "stress_ok", ">=", 1.0),
    ("folds", "pct_positive_folds", ">=", "min_positive_folds"),
]


def criteria(runs: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One row per run and criterion: ok, and detail, the comparison with four decimals. A missing
    input fails.

    ``runs`` has n_trades, expectancy_bps, t_stat, profit_factor, max_drawdown, stress_ok,
    pct_positive_folds per run_id.
    """
    bounds = {**THRESHOLDS, **(limits or {})}
    rows = []
    for name, column, sign, limit in CRITERIA:
        bound = float(bounds.get(limit, limit))
        value = F.col(column).cast("double")
        ok = {">=": value >= bound, ">": value > bound, "<=": value <= bound}[sign]
        shown = F.coalesce(value.cast("decimal(28,4)").cast("string"), F.lit("missing"))
        rows.append(F.struct(F.lit(name).alias("criterion"), F.coalesce(ok, F.lit(False)).alias("ok"),
                             F.concat(F.lit(f"{column} "), shown, F.lit(f" {sign} {bound:.4f}")).alias("detail")))
    return runs.select("run_id", F.inline(F.array(*rows)))


def verdict(table: DataFrame) -> DataFrame:
    """GO only where every criterion of the run holds."""
    return table.groupBy("run_id").agg(
        F.bool_and("ok").alias("go"), F.count(F.when(~F.col("ok"), 1)).alias("n_failed"))


def holdout_checks(table: DataFrame) -> DataFrame:
    """Replication screen: first and second asset up, portfolio beats benchmark, clean exits.

    ``table``: run_id, first_return, second_return, portfolio_return, benchmark_return,
    rejected_exits.
    """
    c = F.col
    out = table.select(
        "run_id", (c("first_return") > 0).alias("first_positive"),
        (c("second_return") > 0).alias("second_positive"),
        (c("portfolio_return") > c("benchmark_return")).alias("beats_benchmark"),
        (c("rejected_exits") == 0).alias("no_rejected_exits"))
    every = (c("first_positive") & c("second_positive") & c("beats_benchmark")
             & c("no_rejected_exits"))
    return out.withColumn("survives", every)


def carry_checks(table: DataFrame, max_drawdown: float = 0.02,
                 min_coverage: float = 0.99) -> DataFrame:
    """Carry month: one fill per leg, no rejects, equal legs, small drawdown, equity up.

    ``table``: run_id, n_fills_spot, n_fills_perp, n_rejected, coverage, drawdown,
    equity_start, equity_end.
    """
    c = F.col
    execution = ((c("n_fills_spot") == 1) & (c("n_fills_perp") == 1) & (c("n_rejected") == 0)
                 & (c("coverage") >= min_coverage))
    out = table.select(
        "run_id", F.coalesce(execution, F.lit(False)).alias("execution_ok"),
        F.coalesce(c("drawdown") <= max_drawdown, F.lit(False)).alias("drawdown_ok"),
        F.coalesce(c("equity_end") > c("equity_start"), F.lit(False)).alias("net_ok"))
    return out.withColumn("survives", c("execution_ok") & c("drawdown_ok") & c("net_ok"))


def holdout_overlaps(runs: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Number of runs whose period touches the locked one."""
    touches = (F.col("start_ns") <= end_ns) & (F.col("end_ns") >= start_ns)
    return runs.agg(F.count(F.when(touches, 1)).alias("attempts"),
                    F.count(F.lit(1)).alias("n_runs"))
