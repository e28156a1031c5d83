"""Archives, and streams fed in slices with repeats and late rows."""

import io
import zipfile

import numpy as np
import pytest

from barlake.operators import features
from barlake.session import shared_folder
from barlake.sources import archives
from barlake.streaming import feeds


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return bytearray(buffer.getvalue())


def test_zipped_funding(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped(a="calc_time,h,r\n1704067200000,8,0.0001\n\nx,8,0.1\n"))
    good, bad = archives.parse_funding(archives.read_zipped_lines(spark, str(tmp_path)))
    assert [tuple(r)[1:] for r in good.collect()] == [(1704067200000 * 10**6, 8, 0.0001)]
    assert [(r.line, r.reason) for r in bad.collect()] == [("x,8,0.1", "bad ts_ns")]


def test_archive_with_two_members_is_refused(spark):
    files = spark.createDataFrame([("p", zipped(a="1", b="2"))], "path string, content binary")
    with pytest.raises(Exception, match="expected one member"):
        archives.zipped_lines(files).collect()


def test_stream_in_slices_equals_batch(spark):
    rng = np.random.default_rng(5)
    rows = [(s, i * 3600 * 10**9, float(100 + rng.normal()), float(rng.integers(1, 9)), 0.5)
            for s in ("A", "B") for i in range(60)]
    schema = "symbol string, ts_ns long, close double, volume double, taker_buy_volume double"
    df = spark.createDataFrame(rows, schema).cache()
    folder, out, mark = (shared_folder(spark, n) for n in ("in", "out", "mark"))
    for lo, hi in ((0, 25), (20, 41), (41, 60)):  # the second slice repeats five bars
        hour = 3600 * 10**9
        df.where(f"ts_ns >= {lo * hour} and ts_ns < {hi * hour}").coalesce(1).write.mode(
            "append").parquet(folder)
        feed = feeds.stream_table(spark, folder, df.schema)
        # A new query each time resumes from the checkpoint.
        feeds.write_stream(feeds.stream_indicators(feed, 5, 8, 4), out, mark).awaitTermination()
    got = spark.read.parquet(out).toPandas().sort_values(["symbol", "ts_ns"])
    want = features.ema(features.zscore(features.realized_vol(features.session_vwap(
        features.flow_imbalance(df, 4)), 8), 8), 5).toPandas().sort_values(["symbol", "ts_ns"])
    assert len(got) == 120
    for c in ("ema", "z", "vwap", "vol", "flow"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9)


def test_settlements_do_not_depend_on_batches(spark):
    bars = [("A", t, 10.0 * t) for t in range(1, 9)]
    paid = [("A", 3, 0.3), ("A", 5, 0.5), ("A", 6, 0.6), ("A", 99, 0.9)]
    want = {(3, 0.3, 20.0, False), (5, 0.5, 40.0, False), (6, 0.6, 50.0, False)}
    # Bars first, settlements first, and in turns; settlements always come twice.
    orders = [[("b", bars), ("s", paid), ("s", paid)], [("s", paid), ("b", bars), ("s", paid)],
              [("b", bars[:3]), ("s", paid[:2]), ("b", bars[3:]), ("s", paid)]]
    for steps in orders:
        folders = {k: shared_folder(spark, k) for k in "bs"}
        out, mark = shared_folder(spark, "out"), shared_folder(spark, "mark")
        kinds = {"b": "symbol string, ts_ns long, close double",
                 "s": "symbol string, ts_ns long, rate double"}
        for k in "bs":
            spark.createDataFrame([], kinds[k]).write.mode("append").parquet(folders[k])
        for k, rows in steps:
            spark.createDataFrame(rows, kinds[k]).coalesce(1).write.mode("append").parquet(folders[k])
            b, s = (feeds.stream_table(spark, folders[k], spark.createDataFrame([], kinds[k]).schema)
                    for k in "bs")
            feeds.write_stream(feeds.stream_settlements(b, s, keep_ns=100), out,
                               mark).awaitTermination()
        got = {(r.ts_ns, r.rate, r.mark, r.late) for r in spark.read.parquet(out).collect()}
        assert got == want


def test_settlement_behind_the_kept_bars_is_late(spark):
    folders = {k: shared_folder(spark, k) for k in "bs"}
    out, mark = shared_folder(spark, "out"), shared_folder(spark, "mark")
    b_kind, s_kind = ("symbol string, ts_ns long, close double", "symbol string, ts_ns long, rate double")
    spark.createDataFrame([("A", t, 1.0 * t) for t in range(50)], b_kind).write.parquet(folders["b"])
    spark.createDataFrame([("A", 45, 0.1)], s_kind).write.parquet(folders["s"])
    for rows in ([], [("A", 45, 0.1), ("A", 7, 0.2), ("A", 44, 0.3)]):
        if rows:
            spark.createDataFrame(rows, s_kind).write.mode("append").parquet(folders["s"])
        b = feeds.stream_table(spark, folders["b"], spark.createDataFrame([], b_kind).schema)
        s = feeds.stream_table(spark, folders["s"], spark.createDataFrame([], s_kind).schema)
        feeds.write_stream(feeds.stream_settlements(b, s, keep_ns=10), out, mark).awaitTermination()
    got = {(r.ts_ns, r.mark, r.late) for r in spark.read.parquet(out).collect()}
    assert got == {(45, 44.0, False), (44, 43.0, False), (7, None, True)}
