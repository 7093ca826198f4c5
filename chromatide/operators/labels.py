"""Label cleaning, label sets and label -> class-id joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatide.functions.labels import normalize_label


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; missing columns become null; duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, nulls dropped."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def shared_labels(a: DataFrame, b: DataFrame, col: str = "label") -> DataFrame:
    """Labels present in both tables (nulls never match)."""
    return (a.select(col).where(F.col(col).isNotNull())
            .intersect(b.select(col).where(F.col(col).isNotNull())))


def clean_labels(train: DataFrame, test: DataFrame, label: str = "cell_type") -> tuple[DataFrame, DataFrame]:
    """Normalise labels on both sides and keep rows whose label occurs in both.

    The shared key set is the intersection of two label sets (one row per
    label); the semi joins are left to Catalyst, which broadcasts it when the
    runtime size is small.
    """
    tr = train.withColumn(label, normalize_label(label))
    te = test.withColumn(label, normalize_label(label))
    keys = shared_labels(tr, te, label)
    return tr.join(keys, label, "left_semi"), te.join(keys, label, "left_semi")


def complement(all_rows: DataFrame, group: DataFrame, key: str = "cell") -> DataFrame:
    """Rows of ``all_rows`` whose key is not in ``group``."""
    return all_rows.join(group.select(key), key, "left_anti")


def union_distinct(dfs: list[DataFrame]) -> DataFrame:
    """Distinct rows over all inputs."""
    return reduce(lambda a, b: a.union(b), dfs).distinct()


def add_metadata(cells: DataFrame, meta: DataFrame, key: str = "cell") -> DataFrame:
    """Attach metadata by barcode (left join)."""
    return cells.join(meta, key, "left")


def add_class_id(df: DataFrame, ids: DataFrame, label: str = "cell_type") -> DataFrame:
    """Label -> class id; an unknown label fails the job.

    ``ids`` is a class dictionary (tens of rows), broadcast.
    """
    joined = df.join(F.broadcast(ids.select(F.col("label").alias(label), "class_id")), label, "left")
    check = F.when(F.col("class_id").isNull(),
                   F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(label), F.lit("NULL")))))
    return joined.withColumn("class_id", F.coalesce(F.col("class_id"), check.cast("int")))


def class_ids_from_labels(df: DataFrame, label: str = "cell_type") -> DataFrame:
    """Class dictionary from the distinct labels, ids by label order starting at 0."""
    from chromatide.operators.common import global_position
    labels = df.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return global_position(labels, [F.col("label")], "class_id", 0).withColumn("class_id", F.col("class_id").cast("int"))
