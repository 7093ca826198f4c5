"""PSL alignment hits: typed reader (header lines skipped by pattern) and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The 21 PSL columns in file order, with their types.
PSL_COLUMNS = [
    ("matches", "int"), ("mis_matches", "int"), ("rep_matches", "int"), ("n_count", "int"),
    ("q_num_insert", "int"), ("q_base_insert", "int"), ("t_num_insert", "int"), ("t_base_insert", "int"),
    ("strand", "string"), ("q_name", "string"), ("q_size", "bigint"), ("q_start", "bigint"), ("q_end", "bigint"),
    ("t_name", "string"), ("t_size", "bigint"), ("t_start", "bigint"), ("t_end", "bigint"),
    ("block_count", "int"), ("block_sizes", "string"), ("q_starts", "string"), ("t_starts", "string"),
]


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """PSL rows as a typed table; the 5 header lines (and any non-data line) are skipped."""
    raw = spark.read.text(path).where(F.col("value").rlike(r"^\d+\t"))
    parts = F.split(F.col("value"), "\t")
    return raw.select(*[parts.getItem(i).cast(t).alias(n) for i, (n, t) in enumerate(PSL_COLUMNS)])


def write_psl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write PSL data rows (no header, like ``-noHead``); missing columns are written as 0 or empty."""
    cols = []
    for n, t in PSL_COLUMNS:
        if n in df.columns:
            cols.append(F.col(n).cast("string"))
        elif t == "string":
            cols.append(F.lit("+" if n == "strand" else ""))
        else:
            cols.append(F.lit("0"))
    df.select(F.concat_ws("\t", *cols).alias("value")).write.mode(mode).text(path)
