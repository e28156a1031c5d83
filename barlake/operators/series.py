"""Windows over one long series without putting the series into one task.

A symbol may hold a third of all rows, so nothing here sorts a whole symbol in one
place. Three devices replace the plain ``partitionBy(symbol)`` window:

* ``running`` - cumulative functions. Rows are windowed inside (symbol, time slice); one
  small row per slice carries the state over to the later slices.
* ``in_blocks`` - row frames. Rows get their exact row number in the series and are cut
  into blocks of equal length, each with the neighbouring rows its frames reach into.
* ``in_slices`` - time-range frames. As above, cut by time, with a time halo.

The carry tables hold one row per (symbol, slice), so their size is the time span over the
slice width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.schemas import NS_DAY

SLICE = "_slice"
INDEX = "_idx"
BLOCK = "_block"
CORE = "_core"
BLOCK_ROWS = 4096

_UP_TO_HERE = (W.unboundedPreceding, W.currentRow)
_EARLIER = (W.unboundedPreceding, -1)


def slice_of(ts: str | Column, width: int | float) -> Column:
    """Slice number of an axis value; integral for ns (they exceed 2^53)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if isinstance(width, int):
        width = F.lit(width).cast("bigint")
        return F.call_function("div", ts - F.pmod(ts, width), width)
    return F.floor(ts / F.lit(width))


def with_slice(df: DataFrame, ts: str = "ts_ns", width: int | float = NS_DAY) -> DataFrame:
    return df.withColumn(SLICE, slice_of(ts, width).cast("bigint"))


def _order(ts: str, tie: Sequence[str]) -> Column:
    return F.col(ts) if not tie else F.struct(ts, *tie)


def with_row_index(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts_ns",
    width: int | float = NS_DAY,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add the exact 0-based row number of each row in its series."""
    cell = [*keys, SLICE]
    sliced = with_slice(df, ts, width)
    earlier = F.sum("_n").over(W.partitionBy(*keys).orderBy(SLICE).rowsBetween(*_EARLIER))
    offsets = (
        sliced.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        .select(*cell, F.coalesce(earlier, F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(W.partitionBy(*cell).orderBy(ts, *tie))
    return (
        carried(sliced, offsets, cell)
        .withColumn(INDEX, F.col("_before") + local - 1)
        .drop("_before", SLICE)
    )


def carried(rows: DataFrame, carry: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Join one row per cell to the rows of the cell; a NULL key or time is a cell as well."""
    named = carry.select(*[F.col(c).alias(f"_on_{c}") for c in cell],
                         *[c for c in carry.columns if c not in cell])
    same = [rows[c].eqNullSafe(named[f"_on_{c}"]) for c in cell]
    return rows.join(named, same).drop(*[f"_on_{c}" for c in cell])


def in_blocks(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts_ns",
    width: int | float = NS_DAY,
    tie: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, W]:
    """Cut each series into row blocks with ``before``/``after`` rows of overlap.

    Returns the frame and the window to use on it. Frames of at most ``before`` preceding
    and ``after`` following rows are exact on rows marked core; finish with ``core_rows``.
    """
    idx = with_row_index(df, keys, ts, width, tie)
    first = F.greatest(F.lit(0), F.floor((F.col(INDEX) - after) / block_rows))
    last = F.floor((F.col(INDEX) + before) / block_rows)
    blocks = (
        idx.withColumn(BLOCK, F.explode(F.sequence(first, last)))
        .withColumn(CORE, F.col(BLOCK) == F.floor(F.col(INDEX) / block_rows))
    )
    return blocks, W.partitionBy(*keys, BLOCK).orderBy(INDEX)


def in_slices(
    df: DataFrame,
    before_ns: int = 0,
    after_ns: int = 0,
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts_ns",
    width: int = NS_DAY,
) -> tuple[DataFrame, W]:
    """Cut each series into time slices with a time overlap, for range frames."""
    own = slice_of(ts, width).cast("bigint")
    first = slice_of(F.col(ts) - after_ns, width).cast("bigint")
    last = slice_of(F.col(ts) + before_ns, width).cast("bigint")
    sliced = (
        df.withColumn(SLICE, F.explode(F.sequence(first, last)))
        .withColumn(CORE, F.col(SLICE) == own)
    )
    return sliced, W.partitionBy(*keys, SLICE).orderBy(ts)


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the overlap rows and the helper columns."""
    helpers = [c for c in (INDEX, BLOCK, CORE, SLICE) if c in df.columns]
    return df.where(F.col(CORE)).drop(*helpers)


def running(
    df: DataFrame,
    scans: Mapping[str, tuple[str, Column]],
    keys: Sequence[str] = ("symbol",),
    ts: str = "ts_ns",
    width: int | float = NS_DAY,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add cumulative columns over each series: ``{name: (kind, value)}``.

    Kinds, all up to and including the current row: ``sum``, ``count`` (of non-null),
    ``max``, ``min``, ``last`` (non-null); and ``prev``, the previous row's value.
    """
    cell = [*keys, SLICE]
    base = with_slice(df, ts, width)
    for i, (_, value) in enumerate(scans.values()):
        base = base.withColumn(f"_v{i}", value)
    order = _order(ts, tie)
    totals, carries = [], []
    slices = W.partitionBy(*keys).orderBy(SLICE)
    earlier = slices.rowsBetween(*_EARLIER)
    here = W.partitionBy(*cell).orderBy(ts, *tie)
    upto = here.rowsBetween(*_UP_TO_HERE)
    out = {}
    for i, (name, (kind, _)) in enumerate(scans.items()):
        v, t, c = F.col(f"_v{i}"), f"_t{i}", F.col(f"_c{i}")
        if kind in ("sum", "count"):
            fn = F.sum if kind == "sum" else F.count
            totals.append(fn(v).alias(t))
            carries.append(F.sum(t).over(earlier).alias(f"_c{i}"))
            out[name] = F.coalesce(fn(v).over(upto), F.lit(0)) + F.coalesce(c, F.lit(0))
        elif kind in ("max", "min"):
            fn, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            totals.append(fn(v).alias(t))
            carries.append(fn(t).over(earlier).alias(f"_c{i}"))
            out[name] = pick(fn(v).over(upto), c)
        elif kind == "last":
            totals.append(F.max_by(v, F.when(v.isNotNull(), order)).alias(t))
            carries.append(F.last(t, ignorenulls=True).over(earlier).alias(f"_c{i}"))
            out[name] = F.coalesce(F.last(v, ignorenulls=True).over(upto), c)
        elif kind == "prev":
            totals.append(F.max_by(v, order).alias(t))
            carries.append(F.lag(t).over(slices).alias(f"_c{i}"))
            out[name] = F.when(F.row_number().over(here) == 1, c).otherwise(F.lag(v).over(here))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
    carry = base.groupBy(*cell).agg(*totals).select(*cell, *carries)
    helpers = [f"_{p}{i}" for i in range(len(scans)) for p in "vc"]
    return carried(base, carry, cell).withColumns(out).drop(*helpers, SLICE)
