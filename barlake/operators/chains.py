"""Greedy choice of intervals: the next one starts at or after the chosen one's end.

The choice is one path through a graph in which every candidate points at the first one that starts at
its end or later. Only the candidates another block points into can be entered from outside, so
a block of numbered candidates is reduced to those and to where the path leaves them. That smaller graph
is reduced again in wider blocks, until a key's rest fits one task; the path through it is walked
there, and every level replays its blocks from the one candidate where the path enters. No task
holds a key's candidates, and lengths are not bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators.asof import asof_join
from barlake.operators.series import with_row_index
from barlake.schemas import NS_DAY
from barlake.session import settle

BLOCK = 4096  # candidates of a first block; each further level is WIDER times as wide
WIDER = 16
NEVER = (1 << 62) - 1  # end of an interval that does not end


def non_overlapping(candidates: DataFrame, keys: Sequence[str] = ("symbol",), start: str = "entry_ts",
                    end: str = "exit_ts", width: int = NS_DAY, block: int = BLOCK) -> DataFrame:
    """The chosen candidates. Starts of a key should be distinct; of equal ones the first by ``end``
    counts. A NULL end never comes: its candidate is chosen if free, and closes the key."""
    keys = list(keys)
    numbered = settle(with_row_index(candidates.where(F.col(start).isNotNull()), keys, ts=start,
                                     width=width, tie=[end]), "candidates")
    asks = numbered.select(*keys, F.col("_idx").alias("i"),
                           F.coalesce(F.col(end).cast("bigint"), F.lit(NEVER)).alias("_end"))
    starts = numbered.select(*keys, F.col(start).alias("_start"), "_idx")
    found = asof_join(asks, starts, keys, left_ts="_end", right_ts="_start", values=["_idx"],
                      width=width, tie=["_idx"], strict=True)
    nodes = settle(found.select(*keys, "i", F.greatest(
        F.coalesce(F.col("_idx"), F.lit(-1)), F.col("i")).alias("_last")).select(
        *keys, "i", (F.col("_last") + 1).alias("j")), "nodes")
    chosen = on_path(nodes, keys, block)
    named = chosen.select(*[F.col(k).alias(f"_on_{k}") for k in keys], F.col("i").alias("_on_i"))
    same = [numbered[k].eqNullSafe(named[f"_on_{k}"]) for k in keys]
    return numbered.join(named, [*same, numbered["_idx"] == named["_on_i"]], "left_semi").select(
        *candidates.columns)


def on_path(nodes: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(keys, i) of the nodes on the path from each key's first: stored ``nodes`` have i and j > i, the
    next node (or a number beyond the last)."""
    keys = list(keys)
    longs = [T.StructField(c, T.LongType()) for c in ("i", "j")]
    key_fields = [nodes.schema[k] for k in keys]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy().copy()
        at = np.searchsorted(i, j)
        for r in range(len(i) - 1, -1, -1):
            if at[r] < len(i) and i[at[r]] == j[r]:
                j[r] = j[at[r]]
        return pdf.assign(j=j)[[*keys, "i", "j"]]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Nodes from the marked one on, while the path stays in the group."""
        pdf = pdf.sort_values("i")
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        at, r, seen = np.searchsorted(i, j), int(np.argmax(pdf["_in"].to_numpy())), []
        while True:
            seen.append(r)
            to = int(at[r])
            if to >= len(i) or i[to] != j[r]:
                break
            r = to
        return pdf.iloc[seen][[*keys, "i"]]

    out = T.StructType([*key_fields, longs[0]])
    longest = nodes.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= block:
        first = nodes.groupBy(*keys).agg(F.min("i").alias("_first"))
        marked = _beside(nodes, first, keys).withColumn("_in", F.col("i") == F.col("_first"))
        return marked.select(*keys, "i", "j", "_in").groupBy(*keys).applyInPandas(walk, out)
    cell = F.call_function("div", F.col("i"), F.lit(block).cast("bigint"))
    left = settle(nodes.withColumn("_b", cell).groupBy(*keys, "_b").applyInPandas(
        exits, T.StructType([*key_fields, *longs])), "exits")
    entered = left.select(*keys, F.col("j").alias("i")).unionByName(
        left.groupBy(*keys).agg(F.min("i").alias("i"))).distinct()
    rest = settle(_beside(left, entered.withColumnRenamed("i", "_i"), keys, F.col("i") == F.col("_i"))
                  .select(*keys, "i", "j"), "entries")
    path = on_path(rest, keys, block * WIDER)
    marks = path.select(*keys, F.col("i").alias("_i"), F.lit(True).alias("_in"))
    inside = nodes.withColumn("_b", cell)
    here = marks.withColumn("_b", F.call_function("div", F.col("_i"), F.lit(block).cast("bigint")))
    joined = _beside(inside, here, [*keys, "_b"]).withColumn("_in", F.col("i") == F.col("_i"))
    return joined.select(*keys, "_b", "i", "j", "_in").groupBy(*keys, "_b").applyInPandas(walk, out)


def _beside(rows: DataFrame, more: DataFrame, keys: Sequence[str], *on) -> DataFrame:
    """Inner join by keys that may be NULL, plus further conditions."""
    named = more.select(*[F.col(k).alias(f"_on_{k}") for k in keys],
                        *[c for c in more.columns if c not in keys])
    same = [rows[k].eqNullSafe(named[f"_on_{k}"]) for k in keys]
    return rows.join(named, [*same, *on]).drop(*[f"_on_{k}" for k in keys])
