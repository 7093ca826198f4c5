"""Genomic intervals: overlap joins, interval merging, coverage pile-up, tiling, BED6.

Nothing here runs a window over a whole chromosome.  Interval merging is a pair
of running maxima over range partitions; the coverage running sum is computed
per (chrom, bin) with a carry per bin.  So a chromosome, a group or one long
interval that holds a third of all rows is still split across many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromatide.operators.common import global_position, in_order, scan

BIN = 1_000_000


def _bins(start, end, width: int):
    return F.explode(F.sequence(F.floor(start / width).cast("bigint"), F.floor(end / width).cast("bigint")))


def overlapping_ids(a: DataFrame, b: DataFrame, a_id: str, width: int = 1000,
                    a_cols=("chrom", "start_pos", "end_pos"), b_cols=("chrom", "start_pos", "end_pos")) -> DataFrame:
    """Ids of ``a`` rows overlapping any ``b`` row (closed intervals, same chrom).

    Both sides explode into fixed-width bins and meet on an equi-join of
    (chrom, bin), so no nested-loop join is planned; a pair found in several
    shared bins is reported once.
    """
    ac, as_, ae = a_cols
    bc, bs, be = b_cols
    ax = a.select(F.col(a_id).alias("_id"), F.col(ac).alias("_c"), F.col(as_).alias("_s"), F.col(ae).alias("_e"),
                  _bins(F.col(as_), F.col(ae), width).alias("_bin"))
    bx = b.select(F.col(bc).alias("_c"), F.col(bs).alias("_bs"), F.col(be).alias("_be"),
                  _bins(F.col(bs), F.col(be), width).alias("_bin"))
    hit = ax.join(bx, ["_c", "_bin"]).where((F.col("_s") <= F.col("_be")) & (F.col("_bs") <= F.col("_e")))
    return hit.select(F.col("_id").alias(a_id)).distinct()


def remove_blacklist(regions: DataFrame, blacklist: DataFrame, region_id: str, width: int = 1000) -> DataFrame:
    """Drop regions overlapping any blacklist interval (closed overlap)."""
    return regions.join(overlapping_ids(regions, blacklist, region_id, width), region_id, "left_anti")


def setdiff_index(index: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Index positions not among the hits."""
    return index.join(hits.select(key), key, "left_anti")


def reduce_intervals(df: DataFrame, by: list[str], chrom: str = "chrom", start: str = "start_pos",
                     end: str = "end_pos", group: str | None = None, gap: int = 1, max_of: str | None = None) -> DataFrame:
    """Merge intervals that overlap or lie within ``gap`` of each other.

    Closed coordinates; ``gap=1`` merges book-ended ranges like GenomicRanges
    ``reduce``.  Output: ``by + [chrom, start, end]`` plus ``groups`` (sorted
    distinct values of ``group``) when ``group`` is given, and ``max_<col>`` when
    ``max_of`` names a column to carry as a maximum.

    Two running maxima over range partitions, carried from one to the next: the
    furthest end so far tells where a merged interval starts, and the latest of
    these starts names the interval a row belongs to.  An interval that spans a
    whole chromosome is folded by partial aggregates, never in one window.
    """
    keys = by + [chrom]
    x = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"),
                  *([F.col(group).alias("_g")] if group else []),
                  *([F.col(max_of).alias("_m")] if max_of else []))
    # intervals sharing a start collapse first (map-side partial aggregation): starts are then unique keys
    first = [F.max("_e").alias("_e"), *([F.collect_set("_g").alias("_g")] if group else []), *([F.max("_m").alias("_m")] if max_of else [])]
    x = scan(in_order(x.groupBy(*keys, "_s").agg(*first), keys, "_s"), keys, "_s", "_e", "_reach", F.max, exclusive=True)
    opens = F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + gap)
    x = scan(x.withColumn("_open", F.when(opens, F.col("_s"))), keys, "_s", "_open", "_isl", F.max)
    out = x.groupBy(*keys, F.col("_isl").alias(start)).agg(
        F.max("_e").alias(end), *([F.max("_m").alias(f"max_{max_of}")] if max_of else []))
    if group:
        sets = x.select(*keys, F.col("_isl").alias(start), F.explode("_g").alias("_g")).groupBy(*keys, start).agg(F.array_sort(F.collect_set("_g")).alias("groups"))
        empty = F.array().cast(sets.schema["groups"].dataType)
        out = out.join(sets, [*keys, start], "left").withColumn("groups", F.coalesce("groups", empty))
    return out


def coverage_segments(frags: DataFrame, by: list[str], chrom: str = "chrom", start: str = "start_pos",
                      end: str = "end_pos", bin_size: int = BIN) -> DataFrame:
    """Coverage of half-open fragments as segments ``[seg_start, seg_end)`` with depth ``cov``.

    +1/-1 events are pre-aggregated per position, then the running sum is
    taken per (by, chrom, bin) with the sum of all earlier bins carried in
    from a small per-bin table.  The segment end is the next event position,
    taken from the same bin or, for the last event of a bin, the first event
    of the next non-empty bin.
    """
    keys = by + [chrom]
    ev = (frags.select(*keys, F.col(start).alias("_p"), F.lit(1).alias("_d"))
          .unionByName(frags.select(*keys, F.col(end).alias("_p"), F.lit(-1).alias("_d")))
          .groupBy(*keys, "_p").agg(F.sum("_d").alias("_d")))
    ev = ev.withColumn("_bin", F.floor(F.col("_p") / bin_size).cast("bigint"))
    per_bin = ev.groupBy(*keys, "_bin").agg(F.sum("_d").alias("_bsum"), F.min("_p").alias("_bfirst"))
    wb = Window.partitionBy(*keys).orderBy("_bin")
    per_bin = per_bin.select(
        *keys, "_bin",
        F.coalesce(F.sum("_bsum").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"),
        F.lead("_bfirst").over(wb).alias("_next_first"))
    w = Window.partitionBy(*keys, "_bin").orderBy("_p")
    seg = (ev.join(per_bin, keys + ["_bin"])
           .withColumn("cov", F.col("_carry") + F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("seg_end", F.coalesce(F.lead("_p").over(w), F.col("_next_first"))))
    return (seg.where(F.col("seg_end").isNotNull())
            .select(*keys, F.col("_p").alias("seg_start"), "seg_end", F.col("cov").cast("bigint").alias("cov")))


def call_peaks(frags: DataFrame, by: list[str], min_cov: int = 2, chrom: str = "chrom",
               bin_size: int = BIN) -> DataFrame:
    """Pile-up per group, keep segments with depth >= min_cov, join touching ones into peaks.

    Peaks are half-open ``[peak_start, peak_end)`` with their maximum depth.
    """
    seg = coverage_segments(frags, by, chrom, bin_size=bin_size).where(F.col("cov") >= min_cov)
    # touching half-open segments [a,b) [b,c): closed [a,b-1] [b,c-1] are book-ended, gap 1
    closed = seg.select(*by, chrom, F.col("seg_start").alias("start_pos"),
                        (F.col("seg_end") - 1).alias("end_pos"), "cov")
    peaks = reduce_intervals(closed, by, chrom, gap=1, max_of="cov")
    return peaks.select(*by, chrom, F.col("start_pos").alias("peak_start"),
                        (F.col("end_pos") + 1).alias("peak_end"), "max_cov")


def tile(ranges: DataFrame, width: int, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """Q17: cut half-open ranges into consecutive windows of ``width`` (last one clipped); an empty range has none."""
    starts = F.when(F.col(end) > F.col(start), F.sequence(F.col(start), F.col(end) - 1, F.lit(width).cast("bigint")))
    t = ranges.withColumn("tile_start", F.explode(starts))
    return t.withColumn("tile_end", F.least(F.col("tile_start") + width, F.col(end)))


def to_bed6(df: DataFrame, chrom: str = "chrom", start: str = "start_pos", end: str = "end_pos",
            strand: str | None = None) -> DataFrame:
    """BED6 projection; name ``peak_i`` in (chrom, start, end) order, score '.'."""
    pos = global_position(df, [F.col(chrom), F.col(start), F.col(end)], "_i")
    return pos.select(F.col(chrom).alias("chrom"), F.col(start).alias("start_pos"), F.col(end).alias("end_pos"),
                      F.concat(F.lit("peak_"), F.col("_i").cast("string")).alias("name"),
                      F.lit(".").alias("score"),
                      (F.col(strand) if strand else F.lit("*")).alias("strand"))
