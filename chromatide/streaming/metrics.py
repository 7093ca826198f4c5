"""Running classification metrics over an event stream (Structured Streaming).

Label / prediction counts and accuracy per tumbling event-time window and
label.  In append mode a window is emitted once the watermark (max event
time minus the delay) passes its end; a row whose window lies behind the
watermark of an earlier micro-batch is dropped (Spark filters late rows with
the previous batch's watermark).  Complete mode re-emits every window.  State
lives in the streaming checkpoint, the result in a Parquet table.  In append
mode each micro-batch has a folder of its own, named by the batch id: a batch
that runs again after a failure writes the same folder again, so no window is
there twice, and a restarted query goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """``events.parquet`` of a folder as a file stream with the table's schema; ``ts`` as TIMESTAMP."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def with_prediction(events: DataFrame) -> DataFrame:
    """Ground truth and prediction as in the ``preds`` fixture."""
    return events.select("ts", F.col("event_type").alias("gt"),
                         F.expr("substr(event_type, CAST(1 + event_id % 2 AS INT), CAST(3 + event_id % 4 AS INT))").alias("pred"))


def stream_metrics(stream: DataFrame, window: str = "1 day", watermark: str = "1 day", ts: str = "ts",
                   gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Per (window, label): rows, correct predictions, predictions of the label, accuracy."""
    w = stream.withWatermark(ts, watermark)
    return (w.groupBy(F.window(ts, window).alias("w"), F.col(gt).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum((F.col(gt) == F.col(pred)).cast("long")).alias("n_correct"))
            .select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "label", "n", "n_correct",
                    (F.col("n_correct") / F.col("n")).alias("accuracy")))


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str, mode: str = "complete") -> None:
    """Run the query over everything available now; a micro-batch replaces the table (complete) or its own folder (append)."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out_path if mode == "complete" else f"{out_path}/batch={number}")

    q = (agg.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    ex = q.exception()
    if ex:
        raise RuntimeError(str(ex))


def read_table(spark: SparkSession, out_path: str) -> DataFrame:
    """All windows of a table that :func:`run_to_table` wrote in append mode."""
    return spark.read.parquet(out_path).drop("batch")


def staged_files(events: DataFrame, path: str, parts: int = 4, late: int = 50) -> None:
    """``events`` as ``parts`` files in order of time, for a stream of several micro-batches.

    Days are dealt to the files in order; of the first file, the rows whose
    event_id is divisible by ``late`` come with the last one, far too late.
    """
    day = F.datediff(F.to_date("ts"), F.lit(events.agg(F.min(F.to_date("ts"))).first()[0]))
    days = events.agg(F.max(day)).first()[0] + 1
    part = F.floor(day * parts / days)
    part = F.when((part == 0) & (F.col("event_id") % late == 0), parts - 1).otherwise(part)
    for number in range(parts):
        events.where(part == number).coalesce(1).write.parquet(f"{path}/part{number}")
