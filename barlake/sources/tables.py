"""Stored tables: partitioned Parquet, file catalog, idempotent ingest, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.functions.scalars import month_of_stem, ts_date
from barlake.schemas import NS_HOUR

LAYOUT = ("market", "kind", "symbol", "interval", "month")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format(ts_date("ts_ns"), "yyyy-MM"))


def write_table(df: DataFrame, path: str, by: Sequence[str] = LAYOUT,
                mode: str = "overwrite") -> None:
    """Zstd Parquet by directory; only the partitions present in ``df`` are replaced.

    Rows of a directory come from as many tasks as its day count asks for, so a month of one
    hot symbol is not one writer's work.
    """
    day = F.call_function("div", F.col("ts_ns"), F.lit(24 * NS_HOUR))
    (df.repartition(*by, day).write.mode(mode).option("compression", "zstd")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def scan_bars(spark: SparkSession, path: str, start_ns: int, end_ns: int, on: str = "open",
              interval_ns: int = 0) -> DataFrame:
    """Bars of a period: directories by month, then rows by open or close time."""
    df = spark.read.parquet(path)
    # A close time inside the period may belong to a bar that opened the month before.
    first = start_ns - (interval_ns if on == "close" else 0)
    lo, hi = (F.date_format(ts_date(F.lit(x)), "yyyy-MM") for x in (first, end_ns))
    months = df.where(F.col("month").between(lo, hi))
    shift = interval_ns if on == "close" else 0
    return months.where(F.col("ts_ns").between(start_ns - shift, end_ns - shift))


def scan_with_symbol(spark: SparkSession, path: str, ts: str = "ts_ns") -> DataFrame:
    """Files whose parent directory names the symbol; first row per (symbol, time).

    Among repeats the row of the first file path wins.
    """
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    df = raw.select("*", F.element_at(parts, -2).alias("symbol"),
                    F.col("_metadata.file_path").alias("_file"))
    return df.groupBy("symbol", ts).agg(F.min_by(F.struct(*raw.columns), "_file").alias("_r")
                                        ).select("symbol", "_r.*")


def catalog_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: rows, first and last time, and the SHA-256 of its bytes."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts_ns").alias("ts_min_ns"),
        F.max("ts_ns").alias("ts_max_ns"))
    digests = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.parquet").load(path)
               .select("path", F.sha2("content", 256).alias("sha256")))
    def plain(c):  # the two readers spell the scheme differently
        return F.regexp_replace(c, "^file:/+", "/")
    return rows.withColumn("path", plain("path")).join(
        digests.withColumn("path", plain("path")), "path")


def upsert_catalog(catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalog with new entries in place of old ones of the same path."""
    return catalog.join(entries, "path", "left_anti").unionByName(entries)


def not_ingested(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose (path, sha256) the catalog does not hold yet."""
    return files.join(catalog, ["path", "sha256"], "left_anti")


def ingest_flows(flows: DataFrame, path: str) -> DataFrame:
    """Write daily flows and return their manifest row; an empty table is an error."""
    flows.repartitionByRange("day").sortWithinPartitions("day").write.mode("overwrite").option(
        "compression", "zstd").parquet(path)
    spark = flows.sparkSession
    stored = spark.read.parquet(path)
    empty = F.raise_error(F.lit("no flows in the window")).cast("bigint")
    n = F.count(F.lit(1))
    rows = stored.agg(F.when(n > 0, n).otherwise(empty).alias("n_rows"),
                      F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    digests = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    digest = digests.select(F.sha2("content", 256).alias("d")).agg(
        F.sha2(F.concat_ws("", F.sort_array(F.collect_list("d"))), 256).alias("sha256"))
    return rows.crossJoin(digest)


def write_runs(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Run tables (fills, equity, orders, trips, metrics), one directory per run."""
    writer = df.write.mode("append").partitionBy("run_id")
    writer.parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def funding_from_pages(pages: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Settlements out of JSON pages ``[{symbol, fundingTime (ms), fundingRate}, …]``.

    The interval is the rounded distance to the settlement before, at least one hour; the
    first takes the second's. Repeated times are an error. Settlements come a few times a
    day, so one symbol's series is bounded by the calendar.
    """
    schema = "array<struct<symbol:string, fundingTime:bigint, fundingRate:string>>"
    rows = pages.select(F.inline(F.from_json("body", schema))).select(
        "symbol", (F.col("fundingTime") * 1_000_000).alias("ts_ns"),
        F.col("fundingRate").try_cast("double").alias("rate")).where(
        F.col("ts_ns").between(start_ns, end_ns))
    w = W.partitionBy("symbol").orderBy("ts_ns")
    gap = F.col("ts_ns") - F.lag("ts_ns").over(w)
    bad = F.raise_error(F.lit("repeated settlement or rate not finite")).cast("boolean")
    fine = (F.coalesce(gap, F.lit(1)) > 0) & F.col("rate").isNotNull() & ~F.isnan("rate")
    hours = F.greatest(F.lit(1), F.round(gap / F.lit(float(NS_HOUR)))).cast("int")
    # The test is part of a filter, so it stands whichever columns are read.
    rows = rows.withColumns({"_fine": fine, "_h": F.when(gap.isNotNull(), hours)})
    rows = rows.where(F.when(F.col("_fine"), True).otherwise(bad)).drop("_fine")
    return rows.withColumn("interval_hours", F.coalesce("_h", F.lead("_h").over(w))).drop("_h")


def manifest_summary(listing: DataFrame) -> DataFrame:
    """Months available per quoted symbol of a file listing (symbol, path)."""
    rows = listing.where(F.col("symbol").endswith("USDT")).withColumn(
        "month", month_of_stem("path")).where(F.col("month").isNotNull())
    return rows.groupBy("symbol").agg(
        F.countDistinct("month").alias("n_months"), F.min("month").alias("earliest"),
        F.max("month").alias("latest"))


def missing_files(wanted: DataFrame, start: str, today: str, catalog: DataFrame) -> DataFrame:
    """Files a complete archive would have and the catalog lacks.

    Elapsed months are one file each, the current month one file per elapsed day; funding
    exists by month only. ``wanted``: (symbol, kind); ``catalog``: (symbol, kind, period).
    """
    months = wanted.withColumn("_d", F.explode(F.expr(
        f"sequence(DATE'{start}', date_trunc('MONTH', DATE'{today}')::date, INTERVAL 1 MONTH)")))
    full = months.where(F.col("_d") < F.date_trunc("MONTH", F.lit(today).cast("date"))).select(
        "symbol", "kind", F.date_format("_d", "yyyy-MM").alias("period"))
    days = wanted.where("kind <> 'fundingRate'").withColumn("_d", F.explode(F.expr(
        f"sequence(date_trunc('MONTH', DATE'{today}')::date, DATE'{today}', INTERVAL 1 DAY)")))
    daily = days.where(F.col("_d") < F.lit(today).cast("date")).select(
        "symbol", "kind", F.date_format("_d", "yyyy-MM-dd").alias("period"))
    return full.unionByName(daily).join(catalog, ["symbol", "kind", "period"], "left_anti")
