"""Shuffle and shard by a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatide.operators.common import global_position

from .common import written

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: the round function's mixing step."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    """Bits of one half of the smallest even-width domain that holds 0..n-1."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _round_key(seed: int, i: int) -> np.uint64:
    return _mix(np.array([(seed * 0x9E3779B97F4A7C15 + i + 1) % 2**64], dtype=np.uint64))[0]


def _encrypt(x: np.ndarray, half: int, seed: int) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for i in range(ROUNDS):
        left, right = right, left ^ (_mix(right ^ _round_key(seed, i)) & mask)
    return (left << np.uint64(half)) | right


def _decrypt(x: np.ndarray, half: int, seed: int) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for i in reversed(range(ROUNDS)):
        left, right = right ^ (_mix(left ^ _round_key(seed, i)) & mask), left
    return (left << np.uint64(half)) | right


def _walk(step, x: np.ndarray, n: int, half: int, seed: int) -> np.ndarray:
    """Cycle walking: apply ``step`` again wherever the value has left 0..n-1 (under 4 times on average)."""
    out = step(x.astype(np.uint64), half, seed)
    out_of_range = out >= n
    while out_of_range.any():
        out[out_of_range] = step(out[out_of_range], half, seed)
        out_of_range = out >= n
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Place of each row number 0..n-1 in the shuffled order; a bijection on 0..n-1."""
    return _walk(_encrypt, np.asarray(rows), n, _half_bits(n), seed)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row number that :func:`permute` sends to each place."""
    return _walk(_decrypt, np.asarray(places), n, _half_bits(n), seed)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of one row number, without any table."""
    place = int(permute(np.array([row]), n, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """Row number held by (shard, slot)."""
    return int(unpermute(np.array([slot * shards + shard]), n, seed)[0])


def feistel_shards(df: DataFrame, order_cols: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``row_number`` (0-based, in ``order_cols`` order), ``shard`` and ``slot``.

    The permuted place p of a row number gives shard p % shards and slot
    p // shards, so shard counts differ by one at most and slots have no gap.
    The same table, order and seed give the same result on any cluster.

    Nulls sort first and are numbered like any value; rows equal in all
    ``order_cols`` take their numbers in any order among themselves; an empty
    table stays empty. Other columns pass through; a column of the input named
    row_number, shard or slot is replaced.
    """
    df = df.drop("row_number", "shard", "slot")
    numbered = global_position(written(df), [F.col(c).asc_nulls_first() for c in order_cols], "row_number", start=0)
    n = numbered.count()

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return (numbered.withColumn("_place", place("row_number"))
            .withColumn("shard", (F.col("_place") % shards).cast("int"))
            .withColumn("slot", F.floor(F.col("_place") / shards).cast("long"))
            .drop("_place"))
