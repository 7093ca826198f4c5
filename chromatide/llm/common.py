"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatide.operators.common import materialize

ROW_KEY = "_rk"

# ASCII letters lower-cased, every other character kept (unlike lower(), which folds all scripts).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """Words of ``text``: the runs between ``separators`` (a Java regex); null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), separators)
    return F.filter(parts, lambda w: w != F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(*cols: str) -> Column:
    """64-bit identity of a row by content: rows equal in ``cols`` share it, so repeated rows need no id."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; a lost executor rereads it."""
    return materialize(df)
