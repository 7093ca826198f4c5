"""Registered queries: dataset statistics, splits, shuffles and samples."""

from __future__ import annotations


from pyspark.sql import functions as F

from chromatide.functions.seeded import sql_seeded_hash
from chromatide.operators import sampling as Z
from chromatide.operators import stats as T
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

SEED = 42
SHOTS = 2
TOTAL = 200
SAMPLE_N = 100
H = sql_seeded_hash(SEED, "doc_id")


@query("agg_split_counts", views=("corpus",), sql="""
SELECT dataset, COUNT(*) FILTER (WHERE split = 'train') AS train, COUNT(*) FILTER (WHERE split = 'test') AS test,
       COUNT(*) FILTER (WHERE split = 'valid') AS valid, COUNT(*) AS total FROM corpus GROUP BY dataset""")
def agg_split_counts(spark, sf):
    return T.split_counts(Inputs(spark, sf).corpus)


_JSON = """'{' || string_agg('"' || cell_type || '":' || CAST(n AS VARCHAR), ',' ORDER BY cell_type) || '}'"""


@query("label_map_json", views=("corpus",), sql=f"""
SELECT dataset, {_JSON} AS count_cell_types FROM (SELECT dataset, cell_type, COUNT(*) AS n FROM corpus GROUP BY 1, 2) GROUP BY dataset""")
def label_map_json(spark, sf):
    per = Inputs(spark, sf).corpus.groupBy("dataset", "cell_type").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("dataset").agg(T.counts_json(F.col("cell_type"), F.col("n")).alias("count_cell_types"))


@query("agg_celltype_counts", views=("corpus",), sql=f"""
SELECT dataset, COUNT(*) AS num_cell_types, {_JSON} AS count_cell_types FROM
 (SELECT dataset, cell_type, COUNT(*) AS n FROM corpus GROUP BY 1, 2) GROUP BY dataset""")
def agg_celltype_counts(spark, sf):
    return T.celltype_counts(Inputs(spark, sf).corpus)


@query("agg_distinct_celltypes", views=("corpus",), sql="SELECT COUNT(DISTINCT cell_type) AS n_cell_types FROM corpus")
def agg_distinct_celltypes(spark, sf):
    c = Inputs(spark, sf).corpus
    return T.distinct_types([c.where(F.col("split") == s) for s in T.SPLITS])


SPLIT_SQL = f"""WITH n AS (SELECT COUNT(*) AS n FROM corpus),
 k AS (SELECT CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS nt FROM n),
 v AS (SELECT nt, CAST(ceil(CAST(0.1 AS DOUBLE) / (1 - CAST(0.1 AS DOUBLE)) * (n - nt)) AS BIGINT) AS nv FROM k, n),
 p AS (SELECT doc_id, row_number() OVER (ORDER BY {H}, doc_id) AS pos FROM corpus)
SELECT doc_id, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + nv THEN 'valid' ELSE 'train' END AS split FROM p, v"""


@query("split_train_test_val", views=("corpus",), sql=SPLIT_SQL)
def split_train_test_val(spark, sf):
    return Z.split(Inputs(spark, sf).corpus.select("doc_id"), "doc_id", 0.8, 0.1, 0.1, SEED)


@query("split_fraction_check", views=("corpus",),
       sql=f"SELECT split, COUNT(*) AS n, TRUE AS bad_fractions_rejected FROM ({SPLIT_SQL}) GROUP BY split")
def split_fraction_check(spark, sf):
    """Valid fractions pass the check; the result is the split sizes."""
    s = Z.split(Inputs(spark, sf).corpus.select("doc_id"), "doc_id", 0.8, 0.1, 0.1, SEED)
    try:
        Z.check_fractions(0.8, 0.1, 0.2)
        rejected = False
    except ValueError:
        rejected = True
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("bad_fractions_rejected", F.lit(rejected))


@query("split_indices", views=("corpus",), sql=f"""
SELECT row_index, split FROM ({SPLIT_SQL}) s JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM corpus) r
USING (doc_id)""")
def split_indices(spark, sf):
    c = Inputs(spark, sf).corpus.select("doc_id")
    return Z.split_indices(c, "doc_id", "doc_id", seed=SEED)


@query("sort_seeded_shuffle", views=("corpus",),
       sql=f"SELECT doc_id, dataset, row_number() OVER (ORDER BY {H}, doc_id) AS shuffle_pos FROM corpus")
def sort_seeded_shuffle(spark, sf):
    return Z.shuffle(Inputs(spark, sf).corpus.select("doc_id", "dataset"), SEED, "doc_id")


@query("limit_after_shuffle", views=("corpus",),
       sql=f"SELECT doc_id, dataset FROM corpus ORDER BY {H}, doc_id LIMIT {SAMPLE_N}")
def limit_after_shuffle(spark, sf):
    return Z.sample_n(Inputs(spark, sf).corpus.select("doc_id", "dataset"), SAMPLE_N, SEED, "doc_id")


@query("sample_few_shot", views=("corpus",), sql=f"""
WITH shots AS (SELECT * FROM (SELECT doc_id, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY {H}, doc_id) AS shot
               FROM corpus WHERE split = 'train') WHERE shot <= {SHOTS}),
 lst AS (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY cell_type, shot) AS ids FROM shots)
SELECT q.doc_id, q.cell_type, lst.ids AS shot_ids FROM corpus q, lst WHERE q.split = 'test'""")
def sample_few_shot(spark, sf):
    c = Inputs(spark, sf).corpus
    shots = Z.few_shot(c.where(F.col("split") == "train"), "cell_type", "doc_id", SHOTS, SEED)
    q = Z.with_shots(c.where(F.col("split") == "test").select("doc_id", "cell_type"), shots, "cell_type", "doc_id")
    return q.select("doc_id", "cell_type", F.array_join(F.col("shot_ids").cast("array<string>"), ",").alias("shot_ids"))


@query("sample_species_uniform", views=("corpus",), sql=f"""
WITH s AS (SELECT COUNT(DISTINCT dataset) AS ns FROM corpus),
 nc AS (SELECT dataset, COUNT(DISTINCT cell_type) AS nc FROM corpus GROUP BY dataset),
 r AS (SELECT c.*, nc.nc, row_number() OVER (PARTITION BY c.dataset, c.cell_type ORDER BY {H}, c.doc_id) AS r
       FROM corpus c JOIN nc USING (dataset))
SELECT doc_id, dataset, cell_type FROM r, s WHERE r <= ceil({TOTAL} / ns / nc)""")
def sample_species_uniform(spark, sf):
    c = Inputs(spark, sf).corpus
    return Z.weighted_sample(c, TOTAL, "dataset", "cell_type", "doc_id", SEED).select("doc_id", "dataset", "cell_type")


@query("file_stem_column", views=("corpus",), sql="""
SELECT cell_type, split_part(split_part(concat(dataset, '_', split, '.parquet'), '_', 1), '.', 1) || '.h5ad' AS file_name,
       doc_id FROM corpus""")
def file_stem_column(spark, sf):
    c = Inputs(spark, sf).corpus
    path = F.concat(F.lit("/data/"), F.col("dataset"), F.lit("_"), F.col("split"), F.lit(".parquet"))
    return T.add_file_name(c.select("cell_type", "doc_id", path.alias("_path")), F.col("_path")).drop("_path")
