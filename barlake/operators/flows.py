"""Transfer-network aggregates: degrees, hubs and daily flows of an address set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.scalars import ts_date
from barlake.operators.quantiles import grouped_quantiles
from barlake.session import settle

TASK_ROWS = 1 << 20  # rows of transactions and addresses that one task makes distinct


def _window(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    if start_ns >= end_ns:
        raise ValueError("start must be before end")
    return df.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))


def hub_degrees(transfers: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Distinct senders and receivers per address; in and out stay separate rows.

    Pairs are made distinct first, so a hot address is spread over its counterparties.
    """
    t = _window(transfers, start_ns, end_ns).where(
        (F.col("value") > 0) & F.col("to_address").isNotNull() & F.col("from_address").isNotNull())
    pairs = t.groupBy("from_address", "to_address").agg(F.sum("value").alias("value"))
    into = pairs.groupBy(F.col("to_address").alias("address")).agg(
        F.count(F.lit(1)).alias("in_deg"), F.sum("value").alias("volume")).select(
        "address", "in_deg", F.lit(0).cast("bigint").alias("out_deg"), "volume")
    out = pairs.groupBy(F.col("from_address").alias("address")).agg(
        F.count(F.lit(1)).alias("out_deg"), F.sum("value").alias("volume")).select(
        "address", F.lit(0).cast("bigint").alias("in_deg"), "out_deg", "volume")
    return into.unionByName(out)


def select_hubs(degrees: DataFrame, min_in: int = 5000, min_out: int = 100,
                min_volume: float = 1000.0, top: int = 30) -> DataFrame:
    """Addresses over all floors, ranked by in-degree times out-degree."""
    totals = degrees.groupBy("address").agg(
        F.sum("in_deg").alias("in_deg"), F.sum("out_deg").alias("out_deg"),
        F.sum("volume").alias("volume"))
    score = F.col("in_deg") * F.col("out_deg")
    keep = (F.col("in_deg") >= min_in) & (F.col("out_deg") >= min_out) & (
        F.col("volume") >= min_volume)
    return totals.where(keep).withColumn("score", score).orderBy(
        F.desc("score"), "address").limit(top)


def daily_flows(transfers: DataFrame, hubs: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Per day: value and distinct counterparties into and out of the address set.

    ``hubs`` is a list of at most a few dozen addresses (``select_hubs`` limits it).
    """
    t = _window(transfers, start_ns, end_ns)
    members = hubs.select(F.lower("address").alias("address")).distinct()
    to_set = members.select(F.col("address").alias("_to"), F.lit(True).alias("_in"))
    from_set = members.select(F.col("address").alias("_from"), F.lit(True).alias("_out"))
    tagged = (t.join(to_set, F.lower("to_address") == F.col("_to"), "left")
              .join(from_set, F.lower("from_address") == F.col("_from"), "left"))
    # Distinct (day, counterparty, role) first keeps busy days spread.
    value = F.col("value")
    return tagged.groupBy(ts_date("ts_ns").alias("day")).agg(
        F.sum(F.when(F.col("_in"), value).otherwise(0.0)).alias("deposit"),
        F.sum(F.when(F.col("_out"), value).otherwise(0.0)).alias("withdraw"),
        F.countDistinct(F.when(F.col("_in"), F.col("from_address"))).alias("deposit_clients"),
        F.countDistinct(F.when(F.col("_out"), F.col("to_address"))).alias("withdraw_clients"))


def top_receivers(outputs: DataFrame, start_ns: int, end_ns: int, min_txs: int = 50_000,
                  top: int = 30, task_rows: int = TASK_ROWS) -> DataFrame:
    """Addresses by value received, with a floor on distinct paying transactions.

    Pairs of address and transaction are nearly as many as the rows, so they are stored apart from
    what made them and dealt to as many tasks as they need.
    """
    paid = _window(outputs, start_ns, end_ns).select(
        "tx_id", "value", F.explode("addresses").alias("address")).where(
        F.col("address").isNotNull())
    paid = settle(paid, "paid")
    paid = paid.repartition(paid.count() // task_rows + 1, "tx_id")
    per_tx = paid.groupBy("address", "tx_id").agg(F.sum("value").alias("value"))
    return per_tx.groupBy("address").agg(
        F.sum("value").alias("received"), F.count(F.lit(1)).alias("funding_txs")).where(
        F.col("funding_txs") >= min_txs).orderBy(F.desc("received"), "address").limit(top)


def two_sided_flows(outputs: DataFrame, inputs: DataFrame, hubs: DataFrame, start_ns: int,
                    end_ns: int) -> DataFrame:
    """Daily amount and transactions received by and spent from one address set.

    ``hubs`` is a list of at most a few dozen addresses (``select_hubs`` limits it). It becomes one
    value of the filter, so rows that pay no member are dropped where they are read.
    """
    members = hubs.agg(F.collect_set("address"))

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = _window(df, start_ns, end_ns).where(F.arrays_overlap("addresses", members.scalar())).select(
            "tx_id", "value", ts_date("ts_ns").alias("day"),
            F.explode("addresses").alias("address"))
        # Transactions first, which stay where they are; a day is spread over them.
        per_tx = rows.where(F.array_contains(members.scalar(), F.col("address"))).groupBy("day", "tx_id").agg(
            F.sum("value").alias("value"))
        return per_tx.groupBy("day").agg(
            F.sum("value").alias(f"{name}_amount"), F.count("tx_id").alias(f"{name}_txs"))

    return side(outputs, "in").join(side(inputs, "out"), "day", "full_outer")


def calibrate_entry(flows: DataFrame, value: str, quantile: float,
                    min_positives: int = 10) -> DataFrame:
    """Entry at a quantile and exit at the 25th percentile of the positive net flows.

    Both are NULL with fewer than ``min_positives`` positive days.
    """
    q = grouped_quantiles(flows.where(F.col(value) > 0), [], value,
                          {"_entry": quantile, "_exit": 0.25})
    ok = F.col("n") >= min_positives
    return q.select(F.col("n").alias("n_positive"), F.when(ok, F.col("_entry")).alias("entry"),
                    F.when(ok, F.col("_exit")).alias("exit"))
