"""Orders: per-cell ranked region names, long internally, wide at the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatide.functions.regions import region_to_dash
from chromatide.operators.matrix import topk


def orders_long(counts: DataFrame, features: DataFrame, k: int = 100) -> DataFrame:
    """(cell, rank, feature) with dash-separated region names."""
    names = features.select("feature_idx", region_to_dash("feature").alias("feature"))
    return topk(counts, k).join(names, "feature_idx").select("cell", "rank", "feature")


def orders_wide(long: DataFrame, k: int, key: str = "cell") -> DataFrame:
    """A10: one row per cell with ``top_1..top_k`` (pivot with the values given, no extra pass)."""
    wide = long.groupBy(key).pivot("rank", list(range(1, k + 1))).agg(F.max("feature"))
    return wide.select(key, *[F.col(str(r)).alias(f"top_{r}") for r in range(1, k + 1)])
