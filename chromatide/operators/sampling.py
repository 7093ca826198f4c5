"""Reproducible shuffles, splits and stratified samples (seeded md5 order, no collect)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromatide.functions.seeded import seeded_hash
from chromatide.operators.common import global_position


def shuffle(df: DataFrame, seed: int, key: str, name: str = "shuffle_pos") -> DataFrame:
    """Reproducible shuffle: position in (seeded hash of key, key) order."""
    return global_position(df.withColumn("_h", seeded_hash(seed, key)), [F.col("_h"), F.col(key)], name).drop("_h")


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """First n rows after the seeded shuffle (``TakeOrderedAndProject``)."""
    return df.withColumn("_h", seeded_hash(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def check_fractions(train: float, test: float, val: float, tol: float = 1e-9) -> None:
    """Fractions must sum to 1."""
    if abs(train + test + val - 1.0) > tol:
        raise ValueError(f"train_pct = {train} + test_pct = {test} + val_pct = {val} do not sum to 1.")


def split(df: DataFrame, key: str, train: float = 0.8, test: float = 0.1, val: float = 0.1,
          seed: int = 42) -> DataFrame:
    """Disjoint train/test/valid split.

    Test takes ceil(n * test) rows, then valid takes ceil(val / (1 - test) *
    rest) of the remainder, the others are train.  Rows are taken in seeded
    hash order; the only value read back is n.
    """
    check_fractions(train, test, val)
    n = df.count()
    n_test = math.ceil(test * n)
    n_val = math.ceil(val / (1 - test) * (n - n_test))
    pos = shuffle(df, seed, key, "_pos")
    s = (F.when(F.col("_pos") <= n_test, "test").when(F.col("_pos") <= n_test + n_val, "valid").otherwise("train"))
    return pos.withColumn("split", s).drop("_pos")


def split_indices(df: DataFrame, key: str, order: str, **kw) -> DataFrame:
    """0-based row index (input order by ``order``) with its split."""
    idx = global_position(df, [F.col(order)], "row_index", 0)
    return split(idx, key, **kw).select("row_index", "split")


def few_shot(df: DataFrame, label: str, key: str, shots: int, seed: int) -> DataFrame:
    """``shots`` examples per class in seeded order (the shot table, shots x classes rows)."""
    w = Window.partitionBy(label).orderBy(seeded_hash(seed, key), F.col(key))
    return df.withColumn("shot", F.row_number().over(w)).where(F.col("shot") <= shots)


def with_shots(queries: DataFrame, shots: DataFrame, label: str, key: str) -> DataFrame:
    """Put the shot ids (ordered by class, then shot; null classes first) in front of each query row, its own id left out.

    Every result row holds the list (shots x classes ids), so it fits in a row;
    it is gathered inside the plan, as a scalar subquery. Without shots the
    list is empty.
    """
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).isNotNull().alias("_k"), F.col(label).alias("_l"), F.col("shot").alias("_s"), F.col(key).alias("_id")))), lambda s: s["_id"])
    listed = queries.withColumn("shot_ids", shots.agg(ids.alias("shot_ids")).scalar())
    return listed.withColumn("shot_ids", F.filter("shot_ids", lambda x: ~x.eqNullSafe(F.col(key))))


def weighted_sample(df: DataFrame, total: int, species: str, contig: str, key: str, seed: int) -> DataFrame:
    """Uniform over species, then uniform over contigs within a species, to about ``total`` rows.

    Quota per (species, contig) stratum = ceil(total / n_species / n_contigs of
    the species); rows are taken in seeded order inside each stratum.
    """
    n_species = df.select(species).distinct().count()
    per_species = total / n_species
    nc = df.groupBy(species).agg(F.countDistinct(contig).alias("_nc"))
    w = Window.partitionBy(species, contig).orderBy(seeded_hash(seed, key), F.col(key))
    x = df.join(nc, species).withColumn("_r", F.row_number().over(w))
    # a literal bound (the largest possible quota) lets Catalyst cut each stratum to it before the
    # shuffle (WindowGroupLimit); the per-stratum quota is applied after
    bound = math.ceil(per_species)
    return (x.where(F.col("_r") <= bound)
            .where(F.col("_r") <= F.ceil(F.lit(per_species) / F.col("_nc"))).drop("_r", "_nc"))
