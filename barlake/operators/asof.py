"""As-of lookups: the last row at or before a time, per symbol.

Both sides are unioned and windowed inside (symbol, time slice). Each slice that holds lookups
gets the last row of the nearest earlier slice with data at its head, so a lookup never leaves
its slice and no symbol is sorted in one task. Slices without lookups or data cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.series import SLICE, with_slice
from barlake.schemas import NS_DAY


def slice_seeds(
    right: DataFrame, keys: Sequence[str], ts: str, width: int | float, tie: Sequence[str] = ()
) -> DataFrame:
    """The last row of each slice, placed in every later slice up to the next with data."""
    cols = [c for c in right.columns if c not in keys]
    order = F.col(ts) if not tie else F.struct(ts, *tie)
    last = (
        with_slice(right, ts, width).groupBy(*keys, SLICE)
        .agg(F.max_by(F.struct(*cols), order).alias("_r"))
    )
    after = F.lead(SLICE).over(W.partitionBy(*keys).orderBy(SLICE))
    covered = (
        last.withColumn("_next", after).where(F.col("_next").isNotNull())
        .withColumn(SLICE, F.explode(F.sequence(F.col(SLICE) + 1, F.col("_next"))))
    )
    return covered.select(*keys, SLICE, *[F.col(f"_r.{c}").alias(c) for c in cols])


def asked_seeds(right: DataFrame, asked: DataFrame, keys: Sequence[str], ts: str,
                width: int | float, tie: Sequence[str] = ()) -> DataFrame:
    """For each asked (keys, slice), the last row before that slice. Works on one row per slice
    with data and one per asked slice."""
    cols = [c for c in right.columns if c not in keys]
    order = F.col(ts) if not tie else F.struct(ts, *tie)
    last = with_slice(right, ts, width).groupBy(*keys, SLICE).agg(
        F.max_by(F.struct(*cols), order).alias("_r"))
    marks = last.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    earlier = W.partitionBy(*keys).orderBy(SLICE).rangeBetween(W.unboundedPreceding, -1)
    seeds = marks.withColumn("_r", F.last("_r", ignorenulls=True).over(earlier)).where(
        F.col("_asked") & F.col("_r").isNotNull())
    return seeds.select(*keys, SLICE, *[F.col(f"_r.{c}").alias(c) for c in cols])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("symbol",),
    left_ts: str = "ts_ns",
    right_ts: str = "ts_ns",
    values: Sequence[str] = (),
    prefix: str = "",
    width: int | float = NS_DAY,
    tie: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """Left join each row to the last ``right`` row with ts <= (``strict``: <) its own.

    Adds ``prefix + column`` for each of ``values``. At equal times the right rows come
    first, in ``tie`` order.
    """
    keys, values = list(keys), list(values)
    hit = F.struct(*[F.col(v).alias(v) for v in values])
    base = right.select(*keys, F.col(right_ts).alias("_ts"), *[F.col(t).alias(f"_tie_{t}")
                        for t in tie], hit.alias("_hit")).where(F.col("_ts").isNotNull())
    ties = [f"_tie_{t}" for t in tie]
    probes = left.select(*keys, F.col(left_ts).alias("_ts"), F.struct("*").alias("_row"))
    side = with_slice(base, "_ts", width)
    placed = with_slice(probes, "_ts", width)
    seeds = asked_seeds(base, placed.select(*keys, SLICE).distinct(), keys, "_ts", width, ties)
    tagged = side.unionByName(seeds).withColumn("_tag", F.lit(0)).unionByName(
        placed.withColumn("_tag", F.lit(-1 if strict else 1)), allowMissingColumns=True)
    upto = (
        W.partitionBy(*keys, SLICE).orderBy("_ts", "_tag", *ties)
        .rowsBetween(W.unboundedPreceding, 0)
    )
    found = tagged.withColumn("_found", F.last("_hit", ignorenulls=True).over(upto)).where(
        F.col("_row").isNotNull())
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(prefix + v) for v in values])
