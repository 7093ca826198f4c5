"""Shared DataFrame helpers used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (reliable, lineage cut).

    Used where partition ids are part of the result: both uses of the frame
    must see the same partitions, also after a lost executor, so they read
    the checkpointed copy instead of re-running a sampled range shuffle.
    """
    from chromatide.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_position(df: DataFrame, order_cols: list, name: str = "pos", start: int = 1) -> DataFrame:
    """Add a 1-based position in a *total* order, without a single-partition window.

    The frame is range-partitioned by ``orderBy``; each row gets its partition id
    and its index inside the partition (``monotonically_increasing_id`` keeps the
    partition in the upper bits).  The tagged frame is checkpointed, so the
    counts and the rows come from one materialisation.  Per-partition counts
    (one row per partition, so a bounded table) give the offsets, broadcast
    back.  ``order_cols`` must make the order total, so the result does not
    depend on the run.
    """
    tagged = materialize(df.orderBy(*order_cols)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local + F.lit(start)).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def arr_text(col, sep: str = ",") -> Column:
    """Array to delimited text (for sinks and value checks)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c.cast("array<string>"), sep)


def sql_arr_text(expr: str, sep: str = ",") -> str:
    return f"array_to_string({expr}, '{sep}')"


def ecdf(df: DataFrame, value: str, name: str = "percentile") -> DataFrame:
    """Empirical CDF of ``value``: share of rows with value <= this row's value.

    Counted per distinct value, cumulated with the distributed running sum
    (no window over all values in one partition) and joined back.
    """
    per_value = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    total = per_value.agg(F.sum("_c")).first()[0] or 0
    cdf = running_sum(per_value, [], value, "_c", "_cum")
    return df.join(cdf.select(value, (F.col("_cum") / F.lit(float(total) or 1.0)).alias(name)), value)


def in_order(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``df`` range-partitioned on ``by + [order]`` and written, with its partition in ``_pid``: input of :func:`scan`."""
    return materialize(df.orderBy(*by, order).withColumn("_pid", F.spark_partition_id()))


def scan(ordered: DataFrame, by: list[str], order: str, value: str, name: str, fold, exclusive: bool = False) -> DataFrame:
    """Running ``fold`` (``F.sum`` or ``F.max``) of ``value`` within ``by`` in ``order`` (keys ``by + [order]`` unique).

    One key of ``by`` holding most rows is still spread over many partitions.
    Each partition folds locally; what earlier partitions hold of a key - one
    small row for each partition - is carried in.  Nulls do not count.
    """
    w = Window.partitionBy("_pid", *by).orderBy(order)
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = ordered.withColumn("_loc", fold(value).over(frame))
    per = ordered.groupBy("_pid", *by).agg(fold(value).alias("_tot"))
    wc = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("_pid", *by, fold("_tot").over(wc).alias("_car"))
    zero = F.lit(0)
    total = F.coalesce("_loc", zero) + F.coalesce("_car", zero) if fold is F.sum else F.greatest("_loc", "_car")
    return local.join(carry, ["_pid", *by]).withColumn(name, total).drop("_loc", "_car")


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str,
                exclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` within ``by`` in ``order`` (keys ``by + [order]`` unique); see :func:`scan`."""
    return scan(in_order(df, by, order), by, order, value, name, F.sum, exclusive).drop("_pid")
