"""Sparse cell x feature matrix: ranking, margins, TF-IDF, top features, SVD.

The matrix is always COO ``(cell, feature_idx, n)`` with implicit zeros; it
is never densified.  Work is keyed by cell (ranking) or by feature (margins),
so it partitions by those keys and map-side partial aggregation applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chromatide.operators.common import ecdf, global_position, materialize
from chromatide.operators.svd import truncated_svd

FEATURE_BLOCK = 8192  # features whose zero entries of a cell are opened from one array


def topk(counts: DataFrame, k: int | None = 100, cell: str = "cell", feature: str = "feature_idx",
         value: str = "n") -> DataFrame:
    """Top-k features per cell by value desc, ties to the lower feature index.

    ``row_number <= k`` lets Catalyst insert a partial ``WindowGroupLimit``
    before the shuffle, so at most k rows per cell and map task are exchanged.
    """
    w = Window.partitionBy(cell).orderBy(F.col(value).desc(), F.col(feature).asc())
    ranked = counts.where(F.col(value) != 0).withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.select(cell, "rank", feature, value)


def topk_dense(counts: DataFrame, features: DataFrame, k: int, cell: str = "cell",
               feature: str = "feature_idx", value: str = "n") -> DataFrame:
    """Top-k on the dense row; cells short of k nonzero take zero features by index.

    Only short cells get candidates: the first k features by index (at most
    k-1 of them can be present, so k candidates always suffice).  They are
    attached by an equi-join on a slot number to a k-row table, anti-joined
    with the present entries and numbered after the nonzero ones.
    """
    nonzero = counts.where(F.col(value) != 0)
    top = topk(nonzero, k, cell, feature, value)
    nnz = nonzero.groupBy(cell).agg(F.count(F.lit(1)).alias("_nnz")).where(F.col("_nnz") < k)
    first_k = (features.select(feature).distinct().orderBy(feature).limit(k)
               .withColumn("_slot", F.row_number().over(Window.orderBy(feature))))
    cand = (nnz.select(cell, "_nnz", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("_slot"))
            .join(F.broadcast(first_k), "_slot")  # k rows: bounded by the parameter
            .join(nonzero.select(cell, feature), [cell, feature], "left_anti"))
    w = Window.partitionBy(cell).orderBy(feature)
    fill = (cand.withColumn("rank", F.col("_nnz") + F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select(cell, "rank", feature, F.lit(0).cast("bigint").alias(value)))
    return top.unionByName(fill)


def topk_all(counts: DataFrame, features: DataFrame, cell: str = "cell", feature: str = "feature_idx", value: str = "n",
             block: int = FEATURE_BLOCK, cells_per_part: int = 2000) -> DataFrame:
    """``top_k=None`` ranks every feature of the file (width taken per call): cells x features rows.

    The ranked nonzero entries come first, then the zero features by index. A
    zero feature's rank follows from counts: the cell's nonzero entries, and
    the zero features in the blocks of features before its own. So the rows of
    a cell and a block are opened from the block's array, and no dense row is
    joined, sorted or shuffled.
    """
    pos = global_position(features.select(F.col(feature).alias("_f")).distinct(), [F.col("_f")], "_slot", 0)
    pos = materialize(pos.withColumn("_b", F.floor(F.col("_slot") / block).cast("bigint")))
    width = pos.count()
    nonzero = counts.where(F.col(value) != 0)
    top = topk(nonzero, width, cell, feature, value)
    if not width:
        return top
    nnz = materialize(nonzero.groupBy(F.col(cell).alias("_c")).agg(F.count(F.lit(1)).alias("_nnz")).where(F.col("_nnz") < width))
    n_blocks, salts = -(-width // block), max(1, -(-nnz.count() // cells_per_part))
    n = min(n_blocks * salts, 8 * counts.sparkSession.sparkContext.defaultParallelism + n_blocks * salts // 64)

    present = nonzero.select(F.col(cell).alias("_c"), F.col(feature).alias("_f")).distinct().join(pos, "_f") \
        .groupBy("_c", "_b").agg(F.collect_list("_f").alias("_has"))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    grid = nnz.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
    grid = grid.join(present, ["_c", "_b"], "left").withColumn("_n", F.when(F.col("_has").isNull(), F.lit(0)).otherwise(F.size("_has")))
    grid = grid.withColumn("_first", F.col("_nnz") + F.col("_b") * block - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    grid = grid.withColumn("_salt", F.pmod(F.xxhash64("_c"), F.lit(salts))).drop("_nnz", "_n")

    listed = F.transform(F.sort_array(F.collect_list(F.struct("_slot", "_f"))), lambda s: s["_f"])
    lists = pos.groupBy("_b").agg(listed.alias("_all")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    met = grid.repartition(max(1, n), "_b", "_salt").join(lists.repartition(max(1, n), "_b", "_salt").hint("merge"), ["_b", "_salt"])
    zero = F.when(F.col("_has").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_has"))
    fill = met.select("_c", "_first", F.posexplode(zero).alias("_p", "_f"))
    fill = fill.select(F.col("_c").alias(cell), (F.col("_first") + F.col("_p") + 1).cast("bigint").alias("rank"), F.col("_f").alias(feature),
                       F.lit(0).cast("bigint").alias(value)).where(F.col("rank") <= width)
    return top.unionByName(fill)


def vocabulary(counts: DataFrame, features: DataFrame, feature: str = "feature_idx") -> DataFrame:
    """Number of cells with a nonzero entry per feature; 0 for unseen features."""
    seen = counts.where(F.col("n") != 0).groupBy(feature).agg(F.count(F.lit(1)).alias("n_cells"))
    return (features.select(feature, "feature").join(seen, feature, "left")
            .select(feature, "feature", F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells")))


def filter_vocab(vocab: DataFrame) -> DataFrame:
    """drop features seen in no cell."""
    return vocab.where(F.col("n_cells") > 0)


def vocab_sorted(vocab: DataFrame, feature: str = "feature_idx") -> DataFrame:
    """Vocabulary by frequency descending, zero dropped, ties by index."""
    return global_position(filter_vocab(vocab), [F.col("n_cells").desc(), F.col(feature).asc()], "vocab_rank")


def margins(counts: DataFrame) -> DataFrame:
    """Totals and nonzero counts per cell and per feature, as one long table."""
    def side(key, axis):
        return (counts.groupBy(key).agg(F.sum("n").cast("bigint").alias("total"),
                                        F.count(F.when(F.col("n") != 0, 1)).alias("nnz"))
                .select(F.lit(axis).alias("axis"), F.col(key).alias("id"), "total", "nnz"))
    return side("cell", "cell").unionByName(side("feature_idx", "feature"))


def feature_totals(counts: DataFrame, features: DataFrame) -> DataFrame:
    tot = counts.groupBy("feature_idx").agg(F.sum("n").cast("bigint").alias("total"))
    return (features.select("feature_idx").join(tot, "feature_idx", "left")
            .select("feature_idx", F.coalesce("total", F.lit(0)).cast("bigint").alias("total")))


def feature_percentile(counts: DataFrame, features: DataFrame) -> DataFrame:
    """Empirical CDF of feature totals over all features (zeros included)."""
    return ecdf(feature_totals(counts, features), "total", "percentile")


def top_features(counts: DataFrame, features: DataFrame, cutoff: str | float = "q5") -> DataFrame:
    """Keep features whose total-count percentile exceeds the cutoff."""
    q = float(cutoff[1:]) / 100.0 if isinstance(cutoff, str) else float(cutoff)
    return feature_percentile(counts, features).where(F.col("percentile") > q)


def tfidf(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p(scale * (n / cell total) * (n_cells / feature total))."""
    cell_tot = counts.groupBy("cell").agg(F.sum("n").alias("_ctot"))
    feat_tot = counts.groupBy("feature_idx").agg(F.sum("n").alias("_ftot"))
    n_cells = counts.select("cell").distinct().count()
    v = F.log1p(F.lit(scale) * (F.col("n") / F.col("_ctot")) * (F.lit(float(n_cells)) / F.col("_ftot")))
    return (counts.join(cell_tot, "cell").join(feat_tot, "feature_idx")
            .select("cell", "feature_idx", v.alias("tfidf")))


def svd(values: DataFrame, k: int = 50, value: str = "tfidf") -> DataFrame:
    """Truncated SVD of the sparse cell x feature matrix, long form; see :func:`~chromatide.operators.svd.truncated_svd`."""
    return truncated_svd(values, k, value=value)


def lsi_dims(emb: DataFrame, col: str = "embedding", first: int = 2, last: int = 50) -> DataFrame:
    """Drop component 1, keep components first..last."""
    return emb.withColumn(col, F.slice(col, first, last - first + 1))


def subset_cells(counts: DataFrame, cells: DataFrame, label: str = "cell_type") -> DataFrame:
    """J02 (with F02): keep entries of cells that carry a label."""
    return counts.join(cells.where(F.col(label).isNotNull()).select("cell"), "cell", "left_semi")


def merge_samples(dfs: list[DataFrame]) -> DataFrame:
    """Union samples by name (missing columns null), re-index the union of feature names."""
    merged = dfs[0]
    for d in dfs[1:]:
        merged = merged.unionByName(d, allowMissingColumns=True)
    merged = materialize(merged)   # read twice: for the names and for the rows
    names = global_position(merged.select("feature").distinct(), [F.col("feature")], "merged_idx")
    return merged.join(names, "feature")
