"""Seeded, engine-independent randomness.

All random choices (tie breaks, shuffles, splits, windows, prompt templates)
come from the first 32 bits of an md5 over ``seed|key...``.  The same value is
computable in plain SQL (DuckDB: ``('0x'||substr(md5(x),1,8))::BIGINT``), so
every seeded operator keeps an SQL oracle and is reproducible across runs and
cluster sizes.  ``rand()`` would depend on partitioning; it is never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.concat_ws("|", *parts)


def seeded_hash(seed, *cols) -> Column:
    """Unsigned 32-bit hash in [0, 2^32) as BIGINT."""
    return F.conv(F.substring(F.md5(seeded_key(seed, *cols)), 1, 8), 16, 10).cast("bigint")


def seeded_unit(seed, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_hash(seed, *cols) / F.lit(4294967296.0)


def sql_seeded_hash(seed, *exprs: str) -> str:
    """DuckDB form of :func:`seeded_hash`; ``exprs`` are SQL expressions."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5(concat_ws('|', {inner})), 1, 8))::BIGINT"
