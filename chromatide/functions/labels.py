"""Column functions for cell labels and cell names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def normalize_label(c) -> Column:
    """Lower-case, delete "cells" then "cell" (also inside words), strip."""
    return strip_ws(F.replace(F.replace(F.lower(_c(c)), F.lit("cells"), F.lit("")), F.lit("cell"), F.lit("")))


def strip_numbers(c) -> Column:
    """Remove standalone digit words, then strip."""
    return strip_ws(F.regexp_replace(_c(c), r"\b\d+\b", ""))


def fill_unknown(c) -> Column:
    """P10: missing label becomes "Unknown"."""
    return F.coalesce(_c(c), F.lit("Unknown"))


def rename_cells(sample, barcode) -> Column:
    """Cell id = first 4 characters of the sample + "-" + barcode."""
    return F.concat(F.substring(_c(sample), 1, 4), F.lit("-"), _c(barcode).cast("string"))


LABEL_PRECEDENCE = ["manual_celltype", "cell_type", "Celltype"]


def pick_label(df: DataFrame, out: str = "cell_type") -> DataFrame:
    """Choose the label column by name precedence (a schema-level choice)."""
    for name in LABEL_PRECEDENCE:
        if name in df.columns:
            others = [c for c in df.columns if c not in LABEL_PRECEDENCE]
            return df.select(*others, F.col(name).alias(out))
    raise ValueError(f"no label column among {LABEL_PRECEDENCE}; columns are {df.columns}")
