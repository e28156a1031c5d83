"""First row beyond a limit: a pyramid of extremes over equal blocks of rows.

Rows of a series are numbered (exactly, without sorting the series in one task) and put into blocks
of ``FAN`` rows, blocks into blocks of ``FAN`` blocks, and so on; each holds the lowest and the
highest value below it. Blocks are of rows, not of time, so a burst of trades is only more blocks.

An order starts at the row number of its arrival. It meets, in one equi-join, the extremes of its own
block and of the later siblings of that block and of each block above it, at most ``FAN`` on every
level: the lowest level with a passing sibling, and there the first one, holds the first touch unless
the own block does. From there every level is one more equi-join with at most ``FAN`` children,
and at the bottom at most two blocks of rows are opened. No step sees more than ``FAN`` rows per
order, whatever the length and density of the series, and rows of blocks that nobody asked for are
dropped by the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.operators.asof import asof_join
from barlake.operators.series import with_row_index
from barlake.schemas import NS_DAY
from barlake.session import settle

FAN = 64
LEVEL = 1 << 57  # a level and a node in one number: minima of numbers need no sort


def _above(number: Column, fan: int, levels: int = 1) -> Column:
    return F.call_function("div", number, F.lit(fan ** levels).cast("bigint"))


def extremes(indexed: DataFrame, low: str, high: str, fan: int = FAN) -> list[DataFrame]:
    """Blocks of each level: symbol, node, parent, lo, hi; the last level has one parent."""
    last = indexed.agg(F.max("_idx")).first()[0] or 0
    level = indexed.select("symbol", _above(F.col("_idx"), fan).alias("node"),
                           F.col(low).alias("lo"), F.col(high).alias("hi"))
    out, size = [], fan
    while True:
        level = level.groupBy("symbol", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        level = level.withColumn("parent", _above(F.col("node"), fan))
        level = settle(level, "extremes") if not out else level
        out.append(level)
        size *= fan
        if size > last:
            return out
        level = level.select("symbol", F.col("parent").alias("node"), "lo", "hi")


def first_touch(orders: DataFrame, tape: DataFrame, limit: str, down: Column, strict: bool,
                low: str = "price", high: str = "price", values: Sequence[str] = ("price",),
                tie: Sequence[str] = (), width: int = NS_DAY, fan: int = FAN) -> DataFrame:
    """First tape row at or after arrival on the far side of each order's limit, as ``hit_ts_ns``
    and ``hit_`` columns of ``values``; NULL where there is none.

    ``down`` marks orders waiting for ``low`` to fall to the limit (``strict``: below it); the others
    wait for ``high`` to rise. Rows of equal time are taken in ``tie`` order. Orders without an arrival
    or a limit and rows without a time never touch. ``width`` only sets how many tape rows of one
    symbol are numbered at a time.
    """
    values = list(dict.fromkeys(["ts_ns", *values]))
    need = list(dict.fromkeys(["symbol", low, high, *values, *tie]))
    timed = tape.select(need).where("ts_ns IS NOT NULL")
    for c, kind in timed.dtypes:
        if c in (low, high) and kind in ("double", "float"):
            timed = timed.withColumn(c, F.nanvl(c, F.lit(None)))  # NaN sorts above every limit
    rows = settle(with_row_index(timed, ["symbol"], width=width, tie=tie), "tape")
    asks = settle(orders.withColumns({"_down": F.coalesce(down, F.lit(False)),
                                      "_ask": F.monotonically_increasing_id()}), "asks")
    waiting = asks.where(F.col("arrive_ns").isNotNull() & F.col(limit).isNotNull()).select(
        "symbol", "arrive_ns", "_ask", "_down", F.col(limit).alias("_limit"))
    placed = asof_join(waiting, rows.select("symbol", "ts_ns", "_idx"), left_ts="arrive_ns",
                       values=["_idx"], width=width, tie=["_idx"], strict=True)
    placed = placed.select("symbol", "_ask", "_down", "_limit",
                           F.coalesce(F.col("_idx") + 1, F.lit(0)).alias("_from"))

    def passes(lo: str, hi: str) -> Column:
        lim = F.col("_limit")
        below, beyond = (F.col(lo) < lim, F.col(hi) > lim) if strict else (
            F.col(lo) <= lim, F.col(hi) >= lim)
        return F.when(F.col("_down"), below).otherwise(beyond)

    levels = extremes(rows, low, high, fan)
    every = levels[0].withColumn("_level", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        every = every.unionByName(level.withColumn("_level", F.lit(k)))
    every = every.withColumnRenamed("symbol", "_symbol")
    steps = placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1))))
    own = F.element_at(F.array(*[_above(F.col("_from"), fan, k + 1) for k in range(len(levels))]),
                       F.col("_level") + 1)
    steps = steps.withColumn("_own", own).withColumn("_parent", _above(F.col("_own"), fan))
    mine = (F.col("_level") == 0) & (F.col("node") == F.col("_own"))
    met = steps.join(every.withColumnRenamed("_level", "_at"), F.col("symbol").eqNullSafe(F.col("_symbol"))
                     & (F.col("_level") == F.col("_at")) & (F.col("_parent") == F.col("parent"))
                     & ((F.col("node") > F.col("_own")) | mine) & passes("lo", "hi"))
    who = ["symbol", "_ask", "_down", "_limit", "_from"]
    found = settle(met.groupBy(*who).agg(
        F.max(F.when(mine, F.col("node"))).alias("_block"),
        F.min(F.when(~mine, F.col("_level") * F.lit(LEVEL) + F.col("node"))).alias("_next")), "found").select(
        *who, "_block", _above(F.col("_next"), LEVEL).cast("int").alias("_level"),
        (F.col("_next") % F.lit(LEVEL)).alias("_node"))
    for k in range(len(levels) - 1, 0, -1):
        below = levels[k - 1].select(F.col("symbol").alias("_symbol"), F.col("node").alias("_child"),
                                     "parent", "lo", "hi")
        # Orders that are not on this level get keys that no block has, each its own.
        at = F.when(F.col("_level") == k, F.col("_node")).otherwise(-1 - F.col("_ask"))
        down_one = found.withColumn("_at", at).join(
            below, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_at") == F.col("parent"))
            & passes("lo", "hi"), "left")
        found = settle(down_one.groupBy(*who, "_block").agg(
            F.first(F.when(F.col("_level") == k, k - 1).otherwise(F.col("_level"))).alias("_level"),
            F.coalesce(F.min("_child"), F.first("_node")).alias("_node")), "found")
    opened = found.select(*who, F.explode(F.array_compact(F.array("_block", "_node"))).alias("_open"))
    tape_rows = rows.select(F.col("symbol").alias("_symbol"), "_idx", F.col(low).alias("_lo"),
                            F.col(high).alias("_hi"), *[F.col(v).alias(f"_row_{v}") for v in values])
    hits = opened.join(tape_rows, F.col("symbol").eqNullSafe(F.col("_symbol")) & (
        F.col("_open") == _above(F.col("_idx"), fan)) & (F.col("_idx") >= F.col("_from"))
        & passes("_lo", "_hi"))
    first = hits.groupBy("_ask").agg(*[F.min_by(f"_row_{v}", "_idx").alias(f"_hit_{v}") for v in values])
    return asks.join(first, "_ask", "left").select(
        *orders.columns, *[F.col(f"_hit_{v}").alias(f"hit_{v}") for v in values])
