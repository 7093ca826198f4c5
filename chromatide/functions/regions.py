"""Column functions for genomic region strings and chromosome names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_region_colon(c) -> Column:
    """``chr:start-end`` to struct(chrom, start_pos, end_pos)."""
    m = r"^([^:]+):(\d+)-(\d+)$"
    return F.struct(F.regexp_extract(_c(c), m, 1).alias("chrom"),
                    F.regexp_extract(_c(c), m, 2).cast("bigint").alias("start_pos"),
                    F.regexp_extract(_c(c), m, 3).cast("bigint").alias("end_pos"))


def parse_region_dash(c) -> Column:
    """``chr-start-end`` to struct; exactly three parts, else ``ok`` is false and fields null."""
    parts = F.split(_c(c), "-")
    ok = F.size(parts) == 3
    return F.struct(F.when(ok, parts.getItem(0)).alias("chrom"),
                    F.when(ok, parts.getItem(1).cast("bigint")).alias("start_pos"),
                    F.when(ok, parts.getItem(2).cast("bigint")).alias("end_pos"),
                    ok.alias("ok"))


def region_to_dash(c) -> Column:
    """Replace ':' by '-' in region names."""
    return F.replace(_c(c), F.lit(":"), F.lit("-"))


def ensure_chr(c) -> Column:
    """Add the ``chr`` prefix when missing."""
    return F.when(_c(c).startswith("chr"), _c(c)).otherwise(F.concat(F.lit("chr"), _c(c)))
