"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one reducer, which is
right for groups of known size (one symbol-day of bars, one date of symbols). For the
others a mergeable sketch brackets each quantile, and only the values inside the narrow
bracket are sorted; everything below it is a count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.operators.series import carried

BINS = 256


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    band: float = 1e-3,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per group: keys, ``n`` and one linearly interpolated quantile per name.

    ``probs`` maps output column to probability. The sketch error is a quarter of ``band``,
    so a bracket always contains its quantile; groups too small for the sketch to be sure
    are bracketed by their minimum and maximum. NULLs are ignored. ``extra`` aggregates
    (aliased) are computed in the same pass and returned beside the quantiles.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    accuracy = int(4 / band)
    edges = []
    for p in probs.values():
        edges += [max(0.0, p - band), min(1.0, p + band)]
    sketch = df.withColumn("_v", F.col(value)).groupBy(*keys).agg(
        F.count("_v").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [float(e) for e in edges], accuracy).alias("_e"),
        F.struct(F.lit(0).alias("_none"), *extra).alias("_x"),
    )
    small = F.col("n") * band < 10
    bands = []
    for i, (name, p) in enumerate(probs.items()):
        lo = F.when(small | F.lit(p - band <= 0), F.col("_min")).otherwise(F.col("_e")[2 * i])
        hi = F.when(small | F.lit(p + band >= 1), F.col("_max")).otherwise(F.col("_e")[2 * i + 1])
        bands.append(F.struct(
            F.lit(name).alias("name"), lo.alias("lo"), hi.alias("hi"),
            (F.lit(p) * (F.col("n") - 1)).alias("rank"),
        ))
    brackets = sketch.select(*keys, "n", F.explode(F.array(*bands)).alias("_b")).select(
        *keys, F.col("_b.name").alias("_name"), F.col("_b.lo").alias("_lo"),
        F.col("_b.hi").alias("_hi"), F.col("_b.rank").alias("_rank"),
    )
    # A NULL key is a group like any other.
    pairs = carried(rows, brackets, keys) if keys else rows.crossJoin(F.broadcast(brackets))
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    span = F.col("_hi") - F.col("_lo")
    step = F.when(span > 0, F.floor((F.col("_v") - F.col("_lo")) / span * BINS)).otherwise(0)
    counted = (
        pairs.where(F.col("_v") <= F.col("_hi"))
        .groupBy(*keys, "_name", "_rank", inside.alias("_x"),
                 F.when(F.col("_v") >= F.col("_lo"), step).otherwise(-1).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # A bracket is cut into bins; only the one or two bins that hold the rank are sorted.
    k, k2 = F.floor("_rank"), F.ceil("_rank")
    cell = [*keys, "_name", "_bin"]
    bins = counted.groupBy(*cell, "_rank").agg(F.sum("_c").alias("_m")).withColumn(
        "_off", F.coalesce(F.sum("_m").over(W.partitionBy(*keys, "_name").orderBy("_bin")
                                            .rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    first, last = F.col("_off"), F.col("_off") + F.col("_m")
    holds = ((first <= k) & (k < last)) | ((first <= k2) & (k2 < last))
    upto = W.partitionBy(*cell).orderBy(F.col("_x").asc_nulls_first())
    ranked = carried(counted, bins.where(holds).select(*cell, "_off"), cell).withColumn(
        "_end", F.col("_off") + F.sum("_c").over(upto.rowsBetween(W.unboundedPreceding, 0)))
    start, end = F.col("_end") - F.col("_c"), F.col("_end")
    low = F.max(F.when((start <= k) & (k < end), F.col("_x")))
    high = F.max(F.when((start <= k2) & (k2 < end), F.col("_x")))
    frac = F.first("_rank") - F.floor(F.first("_rank"))
    missed = F.raise_error(F.lit("quantile bracket missed its rank"))
    picked = ranked.groupBy(*keys, "_name").agg(
        F.when(low.isNull() | high.isNull(), missed.cast("double"))
        .otherwise(low + (high - low) * frac).alias("_q"))
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in probs])
    if not extra:
        sizes = sketch.select(*keys, "n")
    else:
        sizes = sketch.select(*keys, "n", "_x.*").drop("_none")
    if keys:
        named = wide.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *probs)
        out = sizes.join(named, [sizes[k].eqNullSafe(named[f"_on_{k}"]) for k in keys], "left").drop(
            *[f"_on_{k}" for k in keys])
    else:
        out = sizes.crossJoin(F.broadcast(wide))
    some = F.col("n") > 0
    return out.withColumns({name: F.when(some & F.col(name).isNull(), missed.cast("double"))
                            .otherwise(F.col(name)) for name in probs})
