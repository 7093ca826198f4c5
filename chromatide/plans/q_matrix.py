"""Registered queries: matrix ranking, margins, TF-IDF, top features."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatide.operators import matrix as M
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

TOPK = 100
TOPK_FILL = 600


@query("win_topk_features", views=("counts",), sql=f"""
SELECT cell, rank, feature_idx, n FROM (
  SELECT cell, feature_idx, n,
         row_number() OVER (PARTITION BY cell ORDER BY n DESC, feature_idx ASC) AS rank
  FROM counts WHERE n <> 0) WHERE rank <= {TOPK}""")
def win_topk_features(spark, sf):
    return M.topk(Inputs(spark, sf).counts, TOPK)


@query("win_topk_zero_fill", views=("counts", "features"), sql=f"""
SELECT cell, rank, feature_idx, n FROM (
  SELECT c.cell, f.feature_idx, COALESCE(x.n, 0) AS n,
         row_number() OVER (PARTITION BY c.cell ORDER BY COALESCE(x.n, 0) DESC, f.feature_idx ASC) AS rank
  FROM (SELECT DISTINCT cell FROM counts) c CROSS JOIN features f
  LEFT JOIN counts x ON x.cell = c.cell AND x.feature_idx = f.feature_idx) WHERE rank <= {TOPK_FILL}""")
def win_topk_zero_fill(spark, sf):
    i = Inputs(spark, sf)
    return M.topk_dense(i.counts, i.features, TOPK_FILL)


@query("topk_all", views=("counts", "features"), sql="""
SELECT c.cell, f.feature_idx, COALESCE(x.n, 0) AS n,
       row_number() OVER (PARTITION BY c.cell ORDER BY COALESCE(x.n, 0) DESC, f.feature_idx ASC) AS rank
FROM (SELECT DISTINCT cell FROM counts) c CROSS JOIN features f
LEFT JOIN counts x ON x.cell = c.cell AND x.feature_idx = f.feature_idx""")
def topk_all(spark, sf):
    i = Inputs(spark, sf)
    return M.topk_all(i.counts, i.features)


_VOCAB_SQL = """SELECT f.feature_idx, f.feature, COALESCE(v.n_cells, 0) AS n_cells FROM features f
LEFT JOIN (SELECT feature_idx, COUNT(*) AS n_cells FROM counts WHERE n <> 0 GROUP BY feature_idx) v
ON v.feature_idx = f.feature_idx"""


@query("agg_vocabulary", views=("counts", "features"), sql=_VOCAB_SQL)
def agg_vocabulary(spark, sf):
    i = Inputs(spark, sf)
    return M.vocabulary(i.counts, i.features)


@query("filter_vocab_nonzero", views=("counts", "features"),
       sql=f"SELECT * FROM ({_VOCAB_SQL}) WHERE n_cells > 0")
def filter_vocab_nonzero(spark, sf):
    i = Inputs(spark, sf)
    return M.filter_vocab(M.vocabulary(i.counts, i.features))


@query("sort_vocab_desc", views=("counts", "features"), sql=f"""
SELECT *, row_number() OVER (ORDER BY n_cells DESC, feature_idx ASC) AS vocab_rank
FROM ({_VOCAB_SQL}) WHERE n_cells > 0""")
def sort_vocab_desc(spark, sf):
    i = Inputs(spark, sf)
    return M.vocab_sorted(M.vocabulary(i.counts, i.features))


@query("agg_matrix_margins", views=("counts",), sql="""
SELECT 'cell' AS axis, cell AS id, CAST(SUM(n) AS BIGINT) AS total, COUNT(*) FILTER (WHERE n <> 0) AS nnz
FROM counts GROUP BY cell
UNION ALL
SELECT 'feature', feature_idx, CAST(SUM(n) AS BIGINT), COUNT(*) FILTER (WHERE n <> 0) FROM counts GROUP BY feature_idx""")
def agg_matrix_margins(spark, sf):
    return M.margins(Inputs(spark, sf).counts)


_TOTALS_SQL = """SELECT f.feature_idx, COALESCE(t.total, 0) AS total FROM features f LEFT JOIN
(SELECT feature_idx, CAST(SUM(n) AS BIGINT) AS total FROM counts GROUP BY feature_idx) t
ON t.feature_idx = f.feature_idx"""
_PCT_SQL = f"""SELECT feature_idx, total, round(cume_dist() OVER (ORDER BY total), 6) AS percentile
FROM ({_TOTALS_SQL})"""


@query("win_percentile", views=("counts", "features"), sql=_PCT_SQL)
def win_percentile(spark, sf):
    i = Inputs(spark, sf)
    return M.feature_percentile(i.counts, i.features).withColumn("percentile", F.round("percentile", 6))


@query("filter_top_features", views=("counts", "features"),
       sql=f"SELECT feature_idx, total FROM ({_PCT_SQL}) WHERE percentile > 0.05")
def filter_top_features(spark, sf):
    i = Inputs(spark, sf)
    return M.top_features(i.counts, i.features, "q5").select("feature_idx", "total")


@query("mat_top_features", views=("counts", "features"),
       sql=f"SELECT feature_idx, total, percentile FROM ({_PCT_SQL}) WHERE percentile > 0.05")
def mat_top_features(spark, sf):
    i = Inputs(spark, sf)
    return (M.top_features(i.counts, i.features, "q5")
            .select("feature_idx", "total", F.round("percentile", 6).alias("percentile")))


@query("mat_tfidf", views=("counts",), sql="""
SELECT c.cell, c.feature_idx, round(ln(1 + 1e4 * (c.n / ct.ctot) * (nc.k / ft.ftot)), 6) AS tfidf
FROM counts c JOIN (SELECT cell, SUM(n) AS ctot FROM counts GROUP BY cell) ct ON ct.cell = c.cell
JOIN (SELECT feature_idx, SUM(n) AS ftot FROM counts GROUP BY feature_idx) ft ON ft.feature_idx = c.feature_idx,
(SELECT CAST(COUNT(DISTINCT cell) AS DOUBLE) AS k FROM counts) nc""")
def mat_tfidf(spark, sf):
    return M.tfidf(Inputs(spark, sf).counts).withColumn("tfidf", F.round("tfidf", 6))


@query("mat_svd")
def mat_svd(spark, sf):
    return M.svd(M.tfidf(Inputs(spark, sf).counts), k=50)


@query("mat_lsi_dims", views=("logits",), sql="""
SELECT vec_id, component, round(CAST(value AS DOUBLE), 6) AS value FROM (
  SELECT vec_id, unnest(range(2, 51)) AS component, unnest(embedding[2:50]) AS value FROM logits)""")
def mat_lsi_dims(spark, sf):
    e = M.lsi_dims(Inputs(spark, sf).logits, "embedding", 2, 50)
    return e.select("vec_id", F.posexplode("embedding").alias("p", "v")).select(
        "vec_id", (F.col("p") + 2).alias("component"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("join_cells_subset", views=("counts", "cells"), sql="""
SELECT * FROM counts WHERE cell IN (SELECT cell FROM cells WHERE cell_type IS NOT NULL)""")
def join_cells_subset(spark, sf):
    i = Inputs(spark, sf)
    return M.subset_cells(i.counts, i.cells)


def _sample_coo(i: Inputs):
    from chromatide.functions.labels import rename_cells
    return (i.counts.join(i.cells.select("cell", "sample"), "cell")
            .join(i.features.select("feature_idx", "feature"), "feature_idx")
            .select("sample", rename_cells(F.col("sample"), F.col("cell")).alias("cell_name"), "feature", "n"))


@query("set_merge_samples", views=("counts", "cells", "features"), sql="""
SELECT cell_name, feature, n, dense_rank() OVER (ORDER BY feature) AS merged_idx FROM (
  SELECT concat(substr(s.sample, 1, 4), '-', CAST(c.cell AS VARCHAR)) AS cell_name, f.feature, c.n
  FROM counts c JOIN cells s ON s.cell = c.cell JOIN features f ON f.feature_idx = c.feature_idx)""")
def set_merge_samples(spark, sf):
    coo = _sample_coo(Inputs(spark, sf))
    a = coo.where(F.col("sample") < "sample13").drop("sample")
    b = coo.where(F.col("sample") >= "sample13").drop("sample")
    return M.merge_samples([a, b]).select("cell_name", "feature", "n", "merged_idx")


def _pivot_sql(k):
    cols = ", ".join(f"max(CASE WHEN rank = {r} THEN feature END) AS top_{r}" for r in range(1, k + 1))
    return f"""SELECT t.cell, {cols} FROM (
  SELECT cell, feature_idx, row_number() OVER (PARTITION BY cell ORDER BY n DESC, feature_idx ASC) AS rank
  FROM counts WHERE n <> 0) t JOIN (SELECT feature_idx, replace(feature, ':', '-') AS feature FROM features) f
  ON f.feature_idx = t.feature_idx WHERE rank <= {k} GROUP BY t.cell"""


@query("agg_orders_pivot", views=("counts", "features"), sql=_pivot_sql(TOPK))
def agg_orders_pivot(spark, sf):
    from chromatide.operators.orders import orders_long, orders_wide
    i = Inputs(spark, sf)
    return orders_wide(orders_long(i.counts, i.features, TOPK), TOPK)
