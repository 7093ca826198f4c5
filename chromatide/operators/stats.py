"""Dataset statistics per dataset and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ["train", "test", "valid"]


def split_counts(df: DataFrame, dataset: str = "dataset", split: str = "split") -> DataFrame:
    """Rows per dataset and split (pivot with the split values given) plus total."""
    p = df.groupBy(dataset).pivot(split, SPLITS).count().fillna(0, SPLITS)
    return p.withColumn("total", sum((F.col(s) for s in SPLITS), F.lit(0)))


def counts_json(key: Column, n: Column) -> Column:
    """Counts as a JSON object with keys sorted (to_json of a map built from sorted entries)."""
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, n)))))


def celltype_counts(df: DataFrame, dataset: str = "dataset", label: str = "cell_type") -> DataFrame:
    """Per dataset the number of cell types and their counts (JSON map); NULL when labels are missing."""
    per = df.groupBy(dataset, label).agg(F.count(F.lit(1)).alias("_n"))
    agg = per.groupBy(dataset).agg(F.count(F.when(F.col(label).isNotNull(), 1)).alias("num_cell_types"),
                                   F.max(F.col(label).isNull().cast("int")).alias("_has_null"),
                                   counts_json(F.col(label), F.col("_n")).alias("count_cell_types"))
    bad = F.col("_has_null") == 1
    return agg.select(dataset, F.when(bad, F.lit(None)).otherwise(F.col("num_cell_types")).alias("num_cell_types"),
                      F.when(bad, F.lit(None)).otherwise(F.col("count_cell_types")).alias("count_cell_types"))


def distinct_types(dfs: list[DataFrame], label: str = "cell_type") -> DataFrame:
    """Number of distinct cell types over all datasets."""
    u = dfs[0].select(label)
    for d in dfs[1:]:
        u = u.union(d.select(label))
    return u.agg(F.countDistinct(label).alias("n_cell_types"))


def add_file_name(df: DataFrame, path: Column | None = None, first: str = "cell_type") -> DataFrame:
    """Insert ``file_name`` as the second column: base name before the first '_', then before
    the first '.', plus ``.h5ad``.  The path defaults to the row's source file."""
    p = path if path is not None else F.input_file_name()
    base = F.substring_index(p, "/", -1)
    stem = F.substring_index(F.substring_index(base, "_", 1), ".", 1)
    out = df.withColumn("file_name", F.concat(stem, F.lit(".h5ad")))
    rest = [c for c in df.columns if c != first]
    return out.select(first, "file_name", *rest)
