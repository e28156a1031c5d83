"""Queries over file formats, stored tables and streams."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from barlake.plans import views as v
from barlake.plans.market_queries import FLOW_SQL, VOL_SQL, Z_SQL
from barlake.plans.registry import query
from barlake.plans.views import D, H
from barlake.session import settle, shared_folder
from barlake.sources import archives, instruments, tables
from barlake.streaming import feeds

MS = 1_000_000


def _csv(*cols):
    return F.concat_ws(",", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def _with_noise(lines, header):
    """The lines of each file with a header, blank lines and broken lines among them."""
    extra = lines.select("file").distinct().select("file", F.explode(F.array(
        F.lit(header), F.lit(""), F.lit("1,2"))).alias("line"))
    return lines.unionByName(extra)


@query("s1_klines", """SELECT symbol AS file, ts_ns // 1000000 * 1000000 AS ts_ns, open, high, low,
    close, volume, n_trades FROM bars_1h""", "file ts_ns n_trades", "open high low close volume")
def _(spark, sf):
    ms = F.call_function("div", F.col("ts_ns"), F.lit(MS))
    zero = F.lit(0)
    line = _csv(ms, "open", "high", "low", "close", "volume", zero, "quote_volume", "n_trades",
                "taker_buy_volume", "taker_buy_quote_volume", zero)
    lines = v.bars_1h(spark, sf).select(F.col("symbol").alias("file"), line.alias("line"))
    return archives.parse_klines(_with_noise(lines, ",".join(archives.KLINE_COLUMNS)))[0]


@query("s1_kline_rejects", "SELECT DISTINCT symbol AS file, 'field count' AS reason FROM ticks",
       "file reason")
def _(spark, sf):
    lines = v.ticks(spark, sf).select(F.col("symbol").alias("file"), F.lit(" ").alias("line"))
    return archives.parse_klines(_with_noise(lines, "open_time"))[1]


@query("s2_trades", """SELECT symbol AS file, agg_id, ts_ns, price, qty, buyer_is_maker FROM ticks""",
       "file agg_id ts_ns buyer_is_maker", "price qty")
def _(spark, sf):
    us = F.call_function("div", F.col("ts_ns"), F.lit(1000))
    flag = F.when(F.col("buyer_is_maker"), " True").otherwise("FALSE ")
    line = _csv("agg_id", "price", "qty", F.lit(0), F.lit(0), us, flag)
    lines = v.ticks(spark, sf).select(F.col("symbol").alias("file"), line.alias("line"))
    return archives.parse_trades(_with_noise(lines, ",".join(archives.TRADE_COLUMNS)))[0]


@query("s3_funding", "SELECT symbol AS file, ts_ns, interval_hours, rate FROM funding",
       "file ts_ns interval_hours", "rate")
def _(spark, sf):
    line = _csv(F.call_function("div", F.col("ts_ns"), F.lit(MS)), "interval_hours", "rate")
    lines = v.funding(spark, sf).select(F.col("symbol").alias("file"), line.alias("line"))
    return archives.parse_funding(_with_noise(lines, ",".join(archives.FUNDING_COLUMNS)))[0]


@query("s4_zipped_trades", "SELECT agg_id, ts_ns, price, qty, buyer_is_maker FROM ticks",
       "agg_id ts_ns buyer_is_maker", "price qty")
def _(spark, sf):
    us = F.call_function("div", F.col("ts_ns"), F.lit(1000))
    line = _csv("agg_id", "price", "qty", F.lit(0), F.lit(0), us, "buyer_is_maker")
    hour = F.call_function("div", F.col("ts_ns"), F.lit(H))
    # One archive per symbol and hour, the way a venue publishes them.
    files = v.ticks(spark, sf).groupBy("symbol", hour.alias("h")).agg(
        F.concat_ws("\n", F.collect_list(line)).alias("text"))

    def pack(batches):
        for pdf in batches:
            rows = []
            for symbol, h, text in zip(pdf["symbol"], pdf["h"], pdf["text"], strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("trades.csv", text)
                rows.append((f"{symbol}-{h}.zip", buffer.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    packed = files.mapInPandas(pack, "path string, content binary")
    return archives.parse_trades(archives.zipped_lines(packed))[0]


FEB = (1704844800 * 10**9, 1705622400 * 10**9)  # 2024-01-10, 2024-01-19


@query("s5_s6_partitioned_scan", f"""SELECT symbol, ts_ns, close FROM bars_1h WHERE ts_ns BETWEEN
    {FEB[0] - H} AND {FEB[1] - H}""", "symbol ts_ns", "close")
def _(spark, sf):
    path = shared_folder(spark, "bars")
    b = tables.with_month(v.bars_1h(spark, sf)).withColumns({
        "market": F.lit("um"), "kind": F.lit("klines"), "interval": F.lit("1h")})
    tables.write_table(b, path)
    return tables.scan_bars(spark, path, *FEB, on="close", interval_ns=H)


@query("s7_scan_with_symbol", "SELECT symbol, ts_ns, close FROM daily", "symbol ts_ns", "close")
def _(spark, sf):
    path = shared_folder(spark, "daily")
    d = v.daily(spark, sf).select(F.col("symbol").alias("dir"), "ts_ns", "close")
    for _copy in range(2):
        d.write.mode("append").partitionBy("dir").parquet(path)
    return tables.scan_with_symbol(spark, path).withColumn(
        "symbol", F.regexp_replace("symbol", "^dir=", ""))


@query("s8_s9_catalog", """SELECT count(*) AS n_rows, min(ts_ns) AS ts_min_ns, max(ts_ns) AS ts_max_ns,
    true AS digests_ok, 0 AS pending FROM bars_1h""", "n_rows ts_min_ns ts_max_ns digests_ok pending")
def _(spark, sf):
    path = shared_folder(spark, "bars")
    v.bars_1h(spark, sf).write.parquet(path)
    entries = settle(tables.catalog_entries(spark, path), "catalog")
    pending = tables.not_ingested(entries, entries).agg(
        F.count(F.lit(1)).cast("int").alias("pending"))
    return entries.agg(
        F.sum("n_rows").alias("n_rows"), F.min("ts_min_ns").alias("ts_min_ns"),
        F.max("ts_max_ns").alias("ts_max_ns"),
        F.bool_and(F.length("sha256") == 64).alias("digests_ok")).crossJoin(pending)


@query("s10_flow_manifest", """SELECT count(DISTINCT o_orderdate::DATE) AS n_rows, min(o_orderdate::DATE)
    AS first_day, max(o_orderdate::DATE) AS last_day FROM orders""", "n_rows first_day last_day")
def _(spark, sf):
    flows = v.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("deposit"))
    return tables.ingest_flows(flows, shared_folder(spark, "flows"))


@query("s11_s12_instruments", """SELECT s_name AS symbol, (s_nationkey + 1) / 100.0::DOUBLE AS tick_size,
    0.001::DOUBLE AS step_size, s_suppkey::DOUBLE AS min_notional FROM supplier WHERE s_suppkey % 3 = 0
    AND s_suppkey % 4 <> 1""", "symbol", "tick_size step_size min_notional")
def _(spark, sf):
    k = F.col("s_suppkey")

    def rule(kind, field, value):
        cols = {"tickSize": F.lit(None), "stepSize": F.lit(None), "notional": F.lit(None)}
        cols[field] = value
        return F.struct(F.lit(kind).alias("filterType"),
                        *[c.cast("string").alias(n) for n, c in cols.items()])

    one = F.struct(
        F.col("s_name").alias("symbol"),
        F.when(k % 3 == 0, "PERPETUAL").otherwise("CURRENT_QUARTER").alias("contractType"),
        F.when(k % 4 == 1, "BREAK").otherwise("TRADING").alias("status"),
        F.lit("USDT").alias("quoteAsset"), F.array(
            rule("LOT_SIZE", "stepSize", F.lit("0.001")), rule("MIN_NOTIONAL", "notional", k),
            rule("PRICE_FILTER", "tickSize", (F.col("s_nationkey") + 1) / 100.0)).alias("filters"))
    # One document per supplier; a real one holds a venue's listing.
    info = v.table(spark, sf, "supplier").select(
        F.to_json(F.struct(F.array(one).alias("symbols"))).alias("body"))
    path = shared_folder(spark, "universe")
    instruments.save_universe(instruments.instrument_rules(info), path)
    return instruments.load_universe(spark, path)


@query("s13_run_tables", "SELECT run_id, count(*) AS n, sum(fee) AS fee FROM fills GROUP BY 1",
       "run_id n", "fee")
def _(spark, sf):
    path = shared_folder(spark, "runs")
    tables.write_runs(v.fills(spark, sf), path)
    return spark.read.parquet(path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fee").alias("fee"))


@query("s14_funding_pages", """SELECT symbol, ts_ns, rate, coalesce(h, lead(h) OVER (PARTITION BY symbol
    ORDER BY ts_ns)) AS interval_hours FROM (SELECT symbol, ts_ns, rate, CASE WHEN d IS NOT NULL THEN
    greatest(1, round(d / 3.6e12))::INT END AS h FROM (SELECT *, ts_ns - lag(ts_ns) OVER (
    PARTITION BY symbol ORDER BY ts_ns) AS d FROM funding))""",
       "symbol ts_ns interval_hours", "rate")
def _(spark, sf):
    item = F.struct("symbol", F.call_function("div", F.col("ts_ns"), F.lit(MS)).alias("fundingTime"),
                    F.col("rate").cast("string").alias("fundingRate"))
    day = F.call_function("div", F.col("ts_ns"), F.lit(D))
    pages = v.funding(spark, sf).groupBy("symbol", day.alias("d")).agg(
        F.to_json(F.collect_list(item)).alias("body"))
    return tables.funding_from_pages(pages, 0, 2 * 10**18)


LISTING = """SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'S' || l_suppkey % 20 || 'BUSD' ELSE 'S' ||
    l_suppkey % 20 || 'USDT' END AS symbol, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem"""


def listing(spark, sf):
    n = F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string"))
    symbol = F.when(F.col("l_suppkey") % 5 == 0, F.concat(n, F.lit("BUSD"))).otherwise(
        F.concat(n, F.lit("USDT")))
    path = F.concat(F.lit("um/klines/"), symbol, F.lit("-1m-"),
                    F.date_format("l_shipdate", "yyyy-MM"), F.lit(".zip"))
    return v.table(spark, sf, "lineitem").select(symbol.alias("symbol"), path.alias("path"))


@query("s15_manifest_summary", f"""SELECT symbol, count(DISTINCT month) AS n_months, min(month)
    AS earliest, max(month) AS latest FROM ({LISTING}) WHERE symbol LIKE '%USDT' GROUP BY 1""",
       "symbol n_months earliest latest")
def _(spark, sf):
    return tables.manifest_summary(listing(spark, sf))


@query("s16_j11_coverage", f"""WITH cat AS (SELECT DISTINCT symbol, month FROM ({LISTING})),
    w AS (SELECT DISTINCT symbol FROM cat) SELECT symbol, 'klines' AS kind, p AS period FROM w CROSS JOIN
    (SELECT strftime(d, '%Y-%m') AS p FROM (SELECT unnest(generate_series(TIMESTAMP '1994-06-01',
    TIMESTAMP '2002-05-01', INTERVAL 1 MONTH)) AS d) UNION ALL SELECT strftime(d, '%Y-%m-%d') FROM
    (SELECT unnest(generate_series(TIMESTAMP '2002-06-01', TIMESTAMP '2002-06-14', INTERVAL 1 DAY))
    AS d)) WHERE (symbol, p) NOT IN (SELECT (symbol, month) FROM cat)""", "symbol kind period")
def _(spark, sf):
    files = listing(spark, sf).select("symbol", F.lit("klines").alias("kind"),
                                      F.regexp_extract("path", r"(\d{4}-\d{2})", 1).alias("period"))
    catalog = files.distinct()
    return tables.missing_files(catalog.select("symbol", "kind").distinct(), "1994-06-01",
                                "2002-06-15", catalog)


# -- streams ------------------------------------------------------------------------------

def drain(spark, df, name):
    """Run a stream over what is there and read its table."""
    out = shared_folder(spark, name)
    feeds.write_stream(df, out, shared_folder(spark, name + "-checkpoint")).awaitTermination()
    return spark.read.parquet(out)


def bar_folder(spark, sf):
    path = shared_folder(spark, "feed")
    v.bars_1h(spark, sf).write.parquet(path)
    return path, spark.read.parquet(path).schema


def in_slices_of_time(spark, df, name, parts):
    """A folder of files that follow each other in time, one for each part."""
    folder = shared_folder(spark, name)
    stored = settle(df, name)
    for part in slices_of_time(stored, parts):
        part.coalesce(1).write.mode("append").parquet(folder)
    return folder, stored.schema


def slices_of_time(df, parts):
    low, high = df.agg(F.min("ts_ns"), F.max("ts_ns")).first()
    width = ((high or 0) - (low or 0)) // parts + 1
    return [df.where(F.col("ts_ns").between((low or 0) + k * width, (low or 0) + (k + 1) * width - 1))
            for k in range(parts)]


NOW, SINCE = 1705622400 * 10**9, 1704240000 * 10**9


@query("r1_r4_closed_bars", f"""SELECT symbol, ts_ns, close FROM bars_1h
    WHERE ts_ns + {H} <= {NOW} AND ts_ns >= {SINCE}""", "symbol ts_ns", "close")
def _(spark, sf):
    """Three files in time order and a fourth of repeats, one file for each trigger."""
    path, schema = in_slices_of_time(spark, v.bars_1h(spark, sf), "feed", 3)
    v.bars_1h(spark, sf).where("n_trades > 5").coalesce(1).write.mode("append").parquet(path)
    feed = feeds.stream_table(spark, path, schema, max_files=1)
    return drain(spark, feeds.closed_bars(feed, H, now_ns=NOW, delay="60 days", since_ns=SINCE),
                 "closed")


@query("r2_late_rows", """SELECT count(*) AS delivered, (SELECT count(*) FROM bars_1h WHERE ts_ns <=
    (SELECT min(ts_ns) + (max(ts_ns) - min(ts_ns)) // 3 FROM bars_1h)) AS late FROM bars_1h""",
       "delivered late")
def _(spark, sf):
    """The first of three slices comes again at the end: all of it is behind the watermark."""
    bars = settle(v.bars_1h(spark, sf), "bars")
    path, schema = in_slices_of_time(spark, bars, "feed", 3)
    slices_of_time(bars, 3)[0].coalesce(1).write.mode("append").parquet(path)
    closed = feeds.closed_bars(feeds.stream_table(spark, path, schema, max_files=1), H)
    out = shared_folder(spark, "closed")
    run = feeds.write_stream(closed, out, shared_folder(spark, "closed-checkpoint"))
    run.awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("delivered")).withColumn(
        "late", F.lit(feeds.late_rows(run)).cast("bigint"))


@query("r8_r9_resume", "SELECT symbol, ts_ns, close FROM bars_1h", "symbol ts_ns", "close")
def _(spark, sf):
    """Three runs that each drain what is there and stop; the later ones resume."""
    bars = settle(v.bars_1h(spark, sf), "bars")
    path, out, checkpoint = (shared_folder(spark, n) for n in ("feed", "out", "checkpoint"))
    for part in slices_of_time(bars, 3):
        part.coalesce(1).write.mode("append").parquet(path)
        closed = feeds.closed_bars(feeds.stream_table(spark, path, bars.schema), H)
        feeds.write_stream(closed, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("r5_r10_stream_indicators", f"""SELECT e.symbol, e.ts_ns, ema, z, vwap, vol, flow FROM ema_rows e
    JOIN zs USING (symbol, ts_ns) JOIN vols USING (symbol, ts_ns) JOIN flows USING (symbol, ts_ns)
    JOIN (SELECT symbol, ts_ns, sum(close * volume) OVER w / sum(volume) OVER w AS vwap FROM bars_1h
    WINDOW w AS (PARTITION BY symbol, ts_ns // {D} ORDER BY ts_ns)) USING (symbol, ts_ns)""",
       "symbol ts_ns", "ema z vwap vol flow", zs=Z_SQL, vols=VOL_SQL, flows=FLOW_SQL,
       numbered="""SELECT symbol, ts_ns, close, row_number() OVER (
       PARTITION BY symbol ORDER BY ts_ns) AS rn FROM bars_1h""",
       ema_rows="""SELECT symbol, ts_ns, rn, close AS ema FROM numbered WHERE rn = 1 UNION ALL
       SELECT n.symbol, n.ts_ns, n.rn, n.close * (2.0::DOUBLE / 21) + (1 - 2.0::DOUBLE / 21) * e.ema
       FROM ema_rows e JOIN numbered n ON n.symbol = e.symbol AND n.rn = e.rn + 1""")
def _(spark, sf):
    path, schema = bar_folder(spark, sf)
    feed = feeds.stream_table(spark, path, schema)
    return drain(spark, feeds.stream_indicators(feed, 20, 24, 12), "indicators")


@query("r6_stream_bars", f"""SELECT symbol, ts_ns, n_trades, open, high, low, close, volume FROM bars_1h
    WHERE ts_ns + {H} <= (SELECT max(ts_ns) // 1000 * 1000 FROM ticks)""", "symbol ts_ns n_trades",
       "open high low close volume")
def _(spark, sf):
    path = shared_folder(spark, "ticks")
    v.ticks(spark, sf).write.parquet(path)
    feed = feeds.stream_table(spark, path, spark.read.parquet(path).schema)
    return drain(spark, feeds.stream_bars(feed, "1 hour"), "bars")


@query("r3_r7_stream_settlements", f"""SELECT f.symbol, f.ts_ns, f.rate, b.close AS mark, false AS late
    FROM (SELECT f.* FROM funding f JOIN (SELECT symbol, max(ts_ns) + {H} AS newest FROM bars_1h
    GROUP BY 1) n USING (symbol) WHERE f.ts_ns <= newest) f
    ASOF LEFT JOIN (SELECT symbol, ts_ns + {H} AS ts_ns, close FROM bars_1h) b
    ON b.symbol = f.symbol AND f.ts_ns > b.ts_ns""", "symbol ts_ns late", "rate mark")
def _(spark, sf):
    """Bars in three batches, settlements in four other ones, and all of them a second time.
    Those after the last bar still wait for the next."""
    path, schema = in_slices_of_time(spark, v.bars_1h(spark, sf), "feed", 3)
    folder, paid_schema = in_slices_of_time(spark, v.funding(spark, sf), "funding", 4)
    v.funding(spark, sf).write.mode("append").parquet(folder)
    bars = feeds.stream_table(spark, path, schema, max_files=1).withColumn(
        "ts_ns", F.col("ts_ns") + H)
    paid = feeds.stream_table(spark, folder, paid_schema, max_files=1)
    return drain(spark, feeds.stream_settlements(bars, paid, keep_ns=1000 * D), "payments")
