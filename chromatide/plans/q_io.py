"""Registered queries: sources and sinks, each written to a fresh folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromatide.operators import sequences as S
from chromatide.operators import stats as ST
from chromatide.operators.common import materialize
from chromatide.operators.orders import orders_long, orders_wide
from chromatide.operators.regions import call_peaks
from chromatide.plans.fixtures import Inputs
from chromatide.plans.q_eval import MAPPED, mapped
from chromatide.plans.q_sequences import L
from chromatide.plans.registry import query
from chromatide.session import scratch_path
from chromatide.sources import tables as IO
from chromatide.sources.genome import read_fasta, write_fasta

K_ORD = 100
CHUNK = 4096
WRAP = 60


def _mtx(spark, sf):
    i = Inputs(spark, sf)
    path = scratch_path(spark, "mtx")
    IO.write_mtx(i.counts, i.features.select("feature_idx"), i.cells.select("cell"), path)
    return path


@query("src_coo_matrix", views=("counts",), sql="""
SELECT CAST(cell AS VARCHAR) AS cell, CAST(feature_idx AS VARCHAR) AS feature, n FROM counts""")
def src_coo_matrix(spark, sf):
    coo, _ = IO.read_mtx(spark, _mtx(spark, sf), "features_x_cells")
    return coo


@query("src_matrix_check", views=("counts", "features", "cells"), sql="""
SELECT (SELECT COUNT(*) FROM features) AS n_rows, (SELECT COUNT(*) FROM cells) AS n_cols, (SELECT COUNT(*) FROM counts) AS nnz,
       true AS ok""")
def src_matrix_check(spark, sf):
    path = _mtx(spark, sf)
    coo, dims = IO.read_mtx(spark, path)
    feats = spark.read.text(f"{path}/features.tsv")
    cells = spark.read.text(f"{path}/barcodes.tsv")
    return IO.check_dims(dims, feats, cells)


@query("src_matrix_parquet", views=("counts", "cells", "features"), sql="""
SELECT c.cell, c.feature_idx, c.n, s.sample, s.cell_type, f.feature FROM counts c JOIN cells s ON s.cell = c.cell
JOIN features f ON f.feature_idx = c.feature_idx""")
def src_matrix_parquet(spark, sf):
    i = Inputs(spark, sf)
    path = scratch_path(spark, "matrix")
    IO.write_matrix(i.counts, i.cells, i.features.select("feature_idx", "feature"), path)
    return IO.read_matrix(spark, path).select("cell", "feature_idx", "n", "sample", "cell_type", "feature")


@query("snk_matrix", views=("counts", "cells"), sql="""
SELECT c.cell, c.feature_idx, c.n, s.sample FROM counts c JOIN cells s ON s.cell = c.cell""")
def snk_matrix(spark, sf):
    i = Inputs(spark, sf)
    path = scratch_path(spark, "matrix_by_sample")
    x = i.counts.join(i.cells.select("cell", "sample"), "cell")
    IO.write_matrix(x, i.cells, i.features.select("feature_idx", "feature"), path, partition_by="sample")
    return spark.read.parquet(f"{path}/X").select("cell", "feature_idx", "n", "sample")


def _orders_path(spark, sf):
    i = Inputs(spark, sf)
    wide = orders_wide(orders_long(i.counts, i.features, K_ORD), K_ORD)
    wide = wide.join(i.cells.select("cell", "cell_type", "sample"), "cell")
    wide = wide.select("cell", "cell_type", F.concat(F.col("sample"), F.lit(".h5ad")).alias("file_name"),
                       *[f"top_{r}" for r in range(1, K_ORD + 1)])
    path = scratch_path(spark, "orders")
    IO.write_orders(wide, path)
    return path


_ORD_SQL = f"""SELECT t.cell, s.cell_type, s.sample || '.h5ad' AS file_name, t.rank, replace(f.feature, ':', '-') AS feature FROM (
  SELECT cell, feature_idx, row_number() OVER (PARTITION BY cell ORDER BY n DESC, feature_idx) AS rank FROM counts WHERE n <> 0) t
JOIN features f ON f.feature_idx = t.feature_idx JOIN cells s ON s.cell = t.cell WHERE t.rank <= {K_ORD}"""


@query("snk_orders_csv", views=("counts", "features", "cells"), sql=_ORD_SQL)
def snk_orders_csv(spark, sf):
    return IO.read_orders(spark, _orders_path(spark, sf), K_ORD, with_cell=True)


@query("src_orders_csv", views=("counts", "features", "cells"), sql=f"SELECT cell, rank, feature FROM ({_ORD_SQL})")
def src_orders_csv(spark, sf):
    return IO.read_orders(spark, [_orders_path(spark, sf)], K_ORD, with_cell=True).select("cell", "rank", "feature")


@query("src_bed", views=("blacklist",), sql="SELECT chrom, start_pos, end_pos FROM blacklist")
def src_bed(spark, sf):
    path = scratch_path(spark, "bed")
    IO.write_bed(Inputs(spark, sf).blacklist, path, zero_based=False)
    return IO.read_bed(spark, path)


@query("snk_bed", views=("features",), sql="""
SELECT chrom, start_pos - 1 AS start_pos, end_pos, concat('peak_', CAST(row_number() OVER (ORDER BY chrom, start_pos, end_pos) AS VARCHAR)) AS name,
       '.' AS score, '*' AS strand FROM features""")
def snk_bed(spark, sf):
    from chromatide.operators.regions import to_bed6
    path = scratch_path(spark, "bed6")
    IO.write_bed(to_bed6(Inputs(spark, sf).features), path, zero_based=True, six=True)
    return IO.read_bed(spark, path, six=True)


@query("src_fragments", views=("fragments",), sql="""
SELECT chrom, start_pos, end_pos, CAST(barcode AS VARCHAR) AS barcode, CAST(length(grp) AS BIGINT) AS n FROM fragments""")
def src_fragments(spark, sf):
    f = Inputs(spark, sf).fragments.withColumn("n", F.length("grp").cast("bigint"))
    path = scratch_path(spark, "fragments")
    IO.write_fragments(f, path)
    return IO.read_fragments(spark, path)


@query("src_fasta", views=("contigs",), sql=f"""
SELECT contig, CAST(i // {CHUNK} AS INTEGER) AS chunk_id, length(substr(seq, i + 1, {CHUNK})) AS chunk_len,
       md5(substr(seq, i + 1, {CHUNK})) AS chunk_md5 FROM (SELECT contig, seq, unnest(range(0, length(seq), {CHUNK})) AS i FROM contigs)""")
def src_fasta(spark, sf):
    c = Inputs(spark, sf).contigs
    path = scratch_path(spark, "fasta")
    write_fasta(c, path, "contig", "seq", width=WRAP)
    g = read_fasta(spark, path, CHUNK)
    return g.select("contig", "chunk_id", F.length("seq").alias("chunk_len"), F.md5("seq").alias("chunk_md5"))


@query("snk_fasta", views=("regions", "contigs"), sql="""
SELECT 'region_' || CAST(r.region_id AS VARCHAR) AS contig, substr(c.seq, r.start_pos + 1, r.end_pos - r.start_pos) AS seq
FROM regions r JOIN contigs c ON c.contig = r.contig WHERE length(substr(c.seq, r.start_pos + 1, r.end_pos - r.start_pos)) > 0""")
def snk_fasta(spark, sf):
    from chromatide.plans.q_sequences import chunks
    i = Inputs(spark, sf)
    r = i.regions.withColumnRenamed("start_pos", "fetch_start").withColumnRenamed("end_pos", "fetch_end")
    seqs = S.fetch(r, chunks(i), "region_id", size=CHUNK).where(F.length("bases") > 0)
    path = scratch_path(spark, "regions_fasta")
    write_fasta(seqs.withColumn("name", F.concat(F.lit("region_"), F.col("region_id").cast("string"))), path, "name", "bases", WRAP)
    g = read_fasta(spark, path, CHUNK, header_prefix=">", name_pattern=None)
    back = g.groupBy("contig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "seq"))),
                                                             lambda s: s["seq"]), "").alias("seq"))
    return back


@query("seq_window_genomes", views=("regions", "contigs"), sql=f"""
SELECT region_id, rpad(b, {L}, 'N') AS "window", length(b) < want AS truncated FROM (
  SELECT r.region_id, least(r.end_pos - r.start_pos, {L}) AS want,
         substr(CASE WHEN r.region_id % 2 = 0 THEN c.seq ELSE reverse(c.seq) END, r.start_pos + 1, least(r.end_pos - r.start_pos, {L})) AS b
  FROM regions r JOIN contigs c ON c.contig = r.contig)""")
def seq_window_genomes(spark, sf):
    """Q01 over two FASTA genomes with the same contig names; each region names its genome."""
    i = Inputs(spark, sf)
    genomes = []
    for name, seq in (("fwd", F.col("seq")), ("rev", F.reverse("seq"))):
        path = scratch_path(spark, f"genome_{name}")
        write_fasta(i.contigs.select("contig", seq.alias("seq")), path, "contig", "seq", WRAP)
        genomes.append(read_fasta(spark, path, CHUNK).withColumn("genome", F.lit(name)))
    regions = i.regions.withColumn("genome", F.when(F.col("region_id") % 2 == 0, "fwd").otherwise("rev"))
    return S.window_fixed(regions, genomes[0].unionByName(genomes[1]), L, size=CHUNK)


PEAK_SCHEMA = T.StructType([T.StructField("grp", T.StringType()), T.StructField("chrom", T.StringType()),
                            T.StructField("peak_start", T.LongType()), T.StructField("peak_end", T.LongType()),
                            T.StructField("max_cov", T.LongType())])


def _peaks_sql():
    from chromatide.plans.q_regions import _COV_SQL, _islands_sql
    return ("SELECT grp, chrom, start_pos AS peak_start, end_pos + 1 AS peak_end, max_cov FROM (" + _islands_sql(
        f"SELECT grp, chrom, seg_start AS s, seg_end - 1 AS e, cov FROM ({_COV_SQL}) WHERE seg_end IS NOT NULL AND cov >= 2",
        "grp, chrom", 1, ", max(cov) AS max_cov") + ")")


@query("snk_peaks_csv", views=("fragments",), sql=_peaks_sql())
def snk_peaks_csv(spark, sf):
    p = call_peaks(Inputs(spark, sf).fragments, ["grp"], 2, bin_size=1000)
    path = scratch_path(spark, "peaks")
    IO.write_csv(p.select("grp", "chrom", "peak_start", "peak_end", "max_cov"), path)
    return IO.read_csv(spark, path, PEAK_SCHEMA)


@query("snk_preds_csv", views=("preds",), sql=f"SELECT gt, pred FROM ({MAPPED})")
def snk_preds_csv(spark, sf):
    """Truth and matched label (J08), as the report writes them."""
    path = scratch_path(spark, "preds")
    IO.write_csv(mapped(Inputs(spark, sf)).select("gt", "pred"), path)
    return IO.read_csv(spark, path, IO.PREDS)


@query("src_class_ids", views=("cells",), sql="""
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_id FROM
  (SELECT DISTINCT cell_type AS label FROM cells WHERE cell_type IS NOT NULL)""")
def src_class_ids(spark, sf):
    from chromatide.operators.labels import class_ids_from_labels
    ids = class_ids_from_labels(Inputs(spark, sf).cells)
    path = scratch_path(spark, "class_ids")
    IO.write_class_ids(ids, path)
    return IO.read_class_ids(spark, path)


@query("snk_split_dataset", views=("corpus",), sql="SELECT doc_id, cell_type, dataset, split FROM corpus")
def snk_split_dataset(spark, sf):
    path = scratch_path(spark, "splits")
    IO.write_splits(Inputs(spark, sf).corpus, path)
    parts = [IO.read_splits(spark, path, name).select("doc_id", "cell_type", "dataset", "split") for name in ("train", "test", "valid")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snk_stats_csv", views=("corpus",), sql="""
WITH a AS (SELECT dataset, COUNT(*) FILTER (WHERE split = 'train') AS train, COUNT(*) FILTER (WHERE split = 'test') AS test,
       COUNT(*) FILTER (WHERE split = 'valid') AS valid, COUNT(*) AS total FROM corpus GROUP BY dataset),
 b AS (SELECT dataset, COUNT(*) AS num_cell_types,
       '{' || string_agg('"' || cell_type || '":' || CAST(n AS VARCHAR), ',' ORDER BY cell_type) || '}' AS count_cell_types
       FROM (SELECT dataset, cell_type, COUNT(*) AS n FROM corpus GROUP BY 1, 2) GROUP BY dataset)
SELECT dataset AS name, train, test, valid, total, num_cell_types, count_cell_types FROM a JOIN b USING (dataset)""")
def snk_stats_csv(spark, sf):
    c = Inputs(spark, sf).corpus
    stats = ST.split_counts(c).join(ST.celltype_counts(c), "dataset").withColumnRenamed("dataset", "name")
    path = scratch_path(spark, "stats")
    IO.write_csv(stats, path)
    schema = T.StructType([T.StructField("name", T.StringType())] +
                          [T.StructField(s, T.LongType()) for s in ["train", "test", "valid", "total", "num_cell_types"]] +
                          [T.StructField("count_cell_types", T.StringType())])
    return IO.read_csv(spark, path, schema)


_SPLIT_CELLS = """WITH n AS (SELECT COUNT(*) AS n FROM sentences),
 k AS (SELECT CAST(ceil(CAST(0.1 AS DOUBLE) * n) AS BIGINT) AS nt FROM n),
 v AS (SELECT nt, CAST(ceil(CAST(0.1 AS DOUBLE) / (1 - CAST(0.1 AS DOUBLE)) * (n - nt)) AS BIGINT) AS nv FROM k, n),
 p AS (SELECT cell, row_number() OVER (ORDER BY HASH, cell) AS pos FROM sentences)
SELECT cell, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + nv THEN 'valid' ELSE 'train' END AS split FROM p, v"""


def _corpus_sql():
    from chromatide.functions.seeded import sql_seeded_hash
    sp = _SPLIT_CELLS.replace("HASH", sql_seeded_hash(42, "cell"))
    ex = "SELECT cell, unnest(tokens) AS feature_idx, unnest(range(0, len(tokens))) AS pos FROM sentences"
    return f"""WITH sp AS ({sp}),
 st AS (SELECT x.cell, string_agg(f.feature, ' ' ORDER BY x.pos) AS sentence FROM ({ex}) x
        JOIN features f ON f.feature_idx = x.feature_idx GROUP BY x.cell),
 vc AS (SELECT f.feature, COUNT(*) AS n_cells FROM counts c JOIN features f ON f.feature_idx = c.feature_idx WHERE c.n <> 0
        GROUP BY f.feature)
SELECT 'vocab_hs' AS file, feature || ' ' || CAST(n_cells AS VARCHAR) AS line FROM vc
UNION ALL SELECT split || '_hs', sentence FROM st JOIN sp USING (cell)
UNION ALL SELECT split || '_barcodes_hs', CAST(cell AS VARCHAR) FROM sp"""


@query("snk_text_corpus", views=("sentences", "features", "counts"), sql=_corpus_sql())
def snk_text_corpus(spark, sf):
    from chromatide.operators import matrix as M
    from chromatide.operators import sentences as SE
    from chromatide.operators.sampling import split
    i = Inputs(spark, sf)
    vs = M.vocab_sorted(M.vocabulary(i.counts, i.features))
    sent = materialize(SE.sentence_strings(i.sentences, i.features, " "))   # read for the split and for the text
    sent = sent.join(split(sent.select("cell"), "cell", seed=42), "cell")
    path = scratch_path(spark, "corpus")
    IO.export_corpus(vs, sent, path, "hs")
    out = None
    for name in ["vocab_hs"] + [f"{s}_{k}hs" for s in ["train", "test", "valid"] for k in ["", "barcodes_"]]:
        d = spark.read.text(f"{path}/{name}").select(F.lit(name).alias("file"), F.col("value").alias("line"))
        out = d if out is None else out.unionByName(d)
    return out
