"""Connected components of an edge table by alternating large and small stars.

Each round links every node's neighbours to the smallest of them: first the larger neighbours
(large star), then the smaller ones (small star). Rounds are logarithmic in the component
size. A round holds edges and one minimum for each node, never a component. Minima are
pre-aggregated and stored, so that a join on a hub is between two plain exchanges, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.session import settle

MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = settle(both.groupBy("u").agg(F.min("v").alias("m"))
                 .select("u", F.least("u", "m").alias("m")), "large")
    large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"),
                                                             F.col("m").alias("v")).distinct(),
                   "edges")
    low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "small")
    rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"),
                                                       F.col("m").alias("v"))
    return settle(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")


def roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of its component, for each node of an edge.

    Self-loops and rows with a null end are ignored; an empty table gives an empty one.
    """
    now = settle(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = _fingerprint(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        now = _stars(now)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not closed after {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct())
