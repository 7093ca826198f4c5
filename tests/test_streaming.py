"""Streaming metrics: windows close on the watermark; rows later than it are dropped."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from chromatide.streaming.metrics import read_table, run_to_table, stream_metrics


def test_late_rows_dropped_in_append_mode(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src = tempfile.mkdtemp(prefix="chromatide-stream-src-")
    d = lambda day, h=12: dt.datetime(2024, 1, day, h)
    schema = "ts timestamp, gt string, pred string"
    batches = [
        [(d(1), "a", "a"), (d(1), "a", "b"), (d(2), "b", "b"), (d(4), "a", "a")],  # watermark -> day 3 12:00
        [(d(4, 13), "b", "b")],                                                     # day-1 window closes here
        [(d(1, 13), "a", "a"), (d(4, 14), "b", "b")],                               # late day-1 row: dropped
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"b{n}"))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = tempfile.mkdtemp(prefix="chromatide-stream-out-")
    run_to_table(stream_metrics(stream, "1 day", "1 day"), out, tempfile.mkdtemp(prefix="chromatide-stream-ck-"),
                 mode="append")
    got = {(r["window_start"], r["label"]): (r["n"], r["n_correct"]) for r in read_table(spark, out).collect()}
    assert got[("2024-01-01 00:00:00", "a")] == (2, 1)
    # day 4 is still open (watermark day 3), so append mode has not emitted it
    assert not any(k[0].startswith("2024-01-04") for k in got)


def test_complete_mode_counts_everything(spark):
    import __spark_entry__ as E
    from conftest import SMALL
    df = E.queries()["stream_metrics"](spark, SMALL)
    ev = spark.read.parquet(f"{SMALL}/events.parquet")
    assert df.agg(F.sum("n")).first()[0] == ev.count()


def test_restart_and_repeated_batch_write_no_window_twice(spark):
    import shutil
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src, out, ck = (tempfile.mkdtemp(prefix=f"chromatide-stream-{n}-") for n in ("src", "out", "ck"))
    schema = "ts timestamp, gt string, pred string"

    def put(n, days):
        rows = [(dt.datetime(2024, 1, d, 12), "a", "a") for d in days]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"b{n}"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        run_to_table(stream_metrics(stream, "1 day", "1 day"), out, ck, mode="append")
        return sorted((r["window_start"][:10], r["n"]) for r in read_table(spark, out).collect())

    put(0, [1, 1, 2])
    put(1, [4])
    assert run() == [("2024-01-01", 2), ("2024-01-02", 1)]
    # the last commit is lost: the batch runs again on restart and replaces its own folder
    last = max(int(n) for n in os.listdir(os.path.join(ck, "commits")) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(ck, "commits", name)):
            shutil.move(os.path.join(ck, "commits", name), os.path.join(tempfile.mkdtemp(), "lost"))
    put(2, [8])
    assert run() == [("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-04", 1)]


def test_session_zone_is_left_alone(spark):
    import __spark_entry__ as E
    from conftest import SMALL
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        E.queries()["stream_metrics_append"](spark, SMALL)
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
