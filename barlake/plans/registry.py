"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.plans import views

Query = Callable[[SparkSession, str], DataFrame]
# A little above one half, so decimal data that end in an exact half do not sit on the edge
# between two roundings and depend on the order of a sum.
HALF = 0.500003

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _round(c: str, scale: float) -> Column:
    return F.floor(F.col(c) * F.lit(scale) + F.lit(HALF)) / F.lit(scale)


def query(key: str, body: str | None, keep: str = "", r6: str = "", r4: str = "",
          **ctes: str) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` with its SQL twin.

    Both sides end in the same projection: ``keep`` columns as they are, ``r6``/``r4``
    doubles rounded half up to 6 or 4 decimals with the same arithmetic.
    """
    kept, six, four = keep.split(), r6.split(), r4.split()

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf).select(
                *kept, *[_round(c, 1e6).alias(c) for c in six],
                *[_round(c, 1e4).alias(c) for c in four])

        QUERIES[key] = run
        if body is not None:
            cols = [*kept, *[f"floor({c} * 1e6::DOUBLE + {HALF}::DOUBLE) / 1e6::DOUBLE AS {c}" for c in six],
                    *[f"floor({c} * 1e4::DOUBLE + {HALF}::DOUBLE) / 1e4::DOUBLE AS {c}" for c in four]]
            ORACLES[key] = views.sql(f"SELECT {', '.join(cols)} FROM ({body})", **ctes)
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from barlake.plans import (  # noqa: F401
        market_queries,
        run_queries,
        source_queries,
        study_queries,
        table_queries,
        tca_queries,
    )
