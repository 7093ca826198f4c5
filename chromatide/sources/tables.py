"""Readers and writers for the reference's file formats, with fixed schemas.

Formats: Matrix Market triplets (+ features / barcodes lists), Parquet COO
matrices, orders CSV (wide), BED, fragments, peaks CSV, predictions CSV,
class-id JSON, split datasets, text corpus export, statistics CSV.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromatide.operators.common import global_position, materialize

BED3 = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start_pos", T.LongType()),
                     T.StructField("end_pos", T.LongType())])
BED6 = T.StructType(BED3.fields + [T.StructField("name", T.StringType()), T.StructField("score", T.StringType()),
                                   T.StructField("strand", T.StringType())])
FRAGMENTS = T.StructType(BED3.fields + [T.StructField("barcode", T.StringType()), T.StructField("n", T.LongType())])
PREDS = T.StructType([T.StructField("gt", T.StringType()), T.StructField("pred", T.StringType())])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their place: part name, start of the block read, place in the block.  Parts follow each other by name."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a 0-based line number in file order (no single-partition window)."""
    return global_position(_placed(spark, path), [F.col("place")], "line_no", 0).drop("place")


# ---- Matrix Market -----------------------------------------------------------------

def write_mtx(counts: DataFrame, row_names: DataFrame, col_names: DataFrame, path: str,
              row: str = "feature_idx", col: str = "cell", value: str = "n") -> None:
    """Triplets with 1-based positions of ``row_names``/``col_names`` (their row order), plus the lists.

    Each file is a folder of numbered parts in a global sort order, written in
    parallel: the parts one after the other, by name, are the file.  Header and
    size line come first, then the entries column by column.
    """
    spark = counts.sparkSession
    rn = global_position(row_names, [F.col(row)], "_r")
    cn = global_position(col_names, [F.col(col)], "_c")
    trip = counts.join(rn.select(row, "_r"), row).join(cn.select(col, "_c"), col)
    nnz, nr, nc = trip.count(), rn.count(), cn.count()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general", 0), (f"{nr} {nc} {nnz}", 1)],
                                 "value string, k int")
    body = trip.select(F.concat_ws(" ", "_r", "_c", F.col(value).cast("string")).alias("value"), F.lit(2).alias("k"),
                       "_c", "_r")
    head = head.withColumn("_c", F.lit(0).cast("bigint")).withColumn("_r", F.lit(0).cast("bigint"))
    head.unionByName(body).orderBy("k", "_c", "_r").select("value").write.mode("overwrite").text(f"{path}/matrix.mtx")
    rn.orderBy("_r").select(F.col(row).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/features.tsv")
    cn.orderBy("_c").select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/barcodes.tsv")


def read_mtx(spark: SparkSession, path: str, orientation: str = "features_x_cells") -> tuple[DataFrame, tuple[int, int, int]]:
    """Matrix Market folder -> COO ``(cell, feature, n)`` named through the two lists.

    ``orientation`` says which list the matrix rows index (fixed from the
    argument, not guessed).  Returns the COO and the declared (rows, cols, nnz).
    """
    lines = _placed(spark, f"{path}/matrix.mtx").where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    first = lines.agg(F.min(F.struct("place", "line")).alias("f")).first()["f"]   # the size line
    dims = tuple(int(x) for x in first["line"].split())
    size_line = F.struct(*[F.lit(first["place"][c]).alias(c) for c in ("file", "block", "at")])
    trip = lines.where(F.col("place") != size_line).select(F.split(F.trim("line"), r"\s+").alias("p")).select(
        F.col("p")[0].cast("long").alias("_r"), F.col("p")[1].cast("long").alias("_c"), F.col("p")[2].cast("long").alias("n"))
    feats = _lines(spark, f"{path}/features.tsv").select((F.col("line_no") + 1).alias("_i"),
                                                         F.split("line", "\t")[0].alias("feature"))
    cells = _lines(spark, f"{path}/barcodes.tsv").select((F.col("line_no") + 1).alias("_i"),
                                                         F.split("line", "\t")[0].alias("cell"))
    fr, cr = ("_r", "_c") if orientation == "features_x_cells" else ("_c", "_r")
    coo = (trip.join(feats.withColumnRenamed("_i", fr), fr).join(cells.withColumnRenamed("_i", cr), cr)
           .select("cell", "feature", "n"))
    return coo, dims


def check_dims(dims: tuple[int, int, int], features: DataFrame, cells: DataFrame,
               orientation: str = "features_x_cells") -> DataFrame:
    """The declared size must equal the feature and barcode counts for the given orientation."""
    nf, nc = features.count(), cells.count()
    want = (nf, nc) if orientation == "features_x_cells" else (nc, nf)
    if (dims[0], dims[1]) != want:
        raise ValueError(f"matrix is {dims[0]} x {dims[1]} but the lists give {want[0]} x {want[1]}")
    return features.sparkSession.createDataFrame([(dims[0], dims[1], dims[2], True)],
                                                 "n_rows long, n_cols long, nnz long, ok boolean")


# ---- Parquet COO matrix --------------------------------------------------------------

def write_matrix(counts: DataFrame, obs: DataFrame, var: DataFrame, path: str, partition_by: str | None = None) -> None:
    """COO ``X``, ``obs`` and ``var`` as Parquet (X optionally partitioned, e.g. by sample)."""
    w = counts.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(f"{path}/X")
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    var.write.mode("overwrite").parquet(f"{path}/var")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Parquet COO matrix joined to its cell and feature tables."""
    x = spark.read.parquet(f"{path}/X")
    return x.join(spark.read.parquet(f"{path}/obs"), "cell").join(spark.read.parquet(f"{path}/var"), "feature_idx")


# ---- orders CSV ---------------------------------------------------------------------

def write_orders(wide: DataFrame, path: str) -> None:
    """``cell_type, file_name, top_1..top_k`` with a header; any other column (a cell id) follows them."""
    first = ["cell_type", "file_name", *sorted((c for c in wide.columns if c.startswith("top_")), key=lambda c: int(c[4:]))]
    wide.select(*first, *[c for c in wide.columns if c not in first]).write.mode("overwrite").option("header", True).csv(path)


def read_orders(spark: SparkSession, paths, k: int, with_cell: bool = False) -> DataFrame:
    """Order CSVs (header) as one table, turned long ``(cell_type, file_name, rank, feature)``.

    ``with_cell``: the files hold the cell id as one more column at the end, and
    so ``cell`` comes first in the result.  Without it one file row is known by
    its cell type and file name only.
    """
    cell = ["cell"] if with_cell else []
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("cell_type", "file_name", *[f"top_{r}" for r in range(1, k + 1)])] +
                          [T.StructField(c, T.LongType()) for c in cell])
    wide = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(paths)
    arr = F.array(*[F.col(f"top_{r}") for r in range(1, k + 1)])
    return wide.select(*cell, "cell_type", "file_name", F.posexplode(arr).alias("_p", "feature")) \
        .select(*cell, "cell_type", "file_name", (F.col("_p") + 1).alias("rank"), "feature") \
        .where(F.col("feature").isNotNull())


# ---- BED, fragments, peaks -------------------------------------------------------------

def write_bed(df: DataFrame, path: str, zero_based: bool = True, six: bool = False) -> None:
    """Tab-separated BED3/BED6 without header; ``zero_based=False`` keeps 1-based starts."""
    # zero_based: rows hold 1-based closed starts (as GRanges) and BED wants start - 1;
    # zero_based=False writes them unchanged, as the reference's writer did.
    start = F.col("start_pos") - (1 if zero_based else 0)
    cols = [F.col("chrom"), start.alias("start_pos"), F.col("end_pos")]
    if six:
        cols += [F.col("name"), F.col("score"), F.col("strand")]
    df.select(*cols).write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def read_bed(spark: SparkSession, path: str, six: bool = False) -> DataFrame:
    """BED intervals with a fixed schema."""
    return spark.read.option("sep", "\t").option("header", False).schema(BED6 if six else BED3).csv(path)


def write_fragments(df: DataFrame, path: str) -> None:
    df.select("chrom", "start_pos", "end_pos", "barcode", "n").write.mode("overwrite") \
        .option("sep", "\t").option("compression", "gzip").csv(path)


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragment file ``chrom, start, end, barcode, n`` (tab, gzip, '#' comments)."""
    return spark.read.option("sep", "\t").option("comment", "#").schema(FRAGMENTS).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


# ---- class ids, splits, corpus export ------------------------------------------------

def write_class_ids(ids: DataFrame, path: str) -> None:
    """Class dictionary as one JSON object ``{label: id}`` (a class table: tens of rows)."""
    obj = ids.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "class_id"))))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(path)


def read_class_ids(spark: SparkSession, path: str) -> DataFrame:
    """``{label: id}`` JSON -> rows ``(label, class_id)``."""
    m = spark.read.text(path).select(F.from_json("value", "map<string,int>").alias("m"))
    return m.select(F.explode("m").alias("label", "class_id"))


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet laid out by dataset and split."""
    df.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Read back; a split filter prunes partitions (no other folder is opened)."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df


def export_corpus(vocab_sorted: DataFrame, sentences: DataFrame, path: str, tag: str) -> None:
    """Text export: ``vocab_<tag>`` ("feature n" by T01 order), sentences and barcodes per split.

    ``sentences`` has (cell, sentence, split).  Test barcodes go to their own
    files (the reference overwrote the train barcode file).
    """
    sentences = materialize(sentences.select("cell", "sentence", "split"))   # six files are written from it
    vocab_sorted.orderBy("vocab_rank").select(F.concat_ws(" ", "feature", F.col("n_cells").cast("string")).alias("value")) \
        .write.mode("overwrite").text(f"{path}/vocab_{tag}")
    for s in ["train", "test", "valid"]:
        part = sentences.where(F.col("split") == s)
        part.select(F.col("sentence").alias("value")).write.mode("overwrite").text(f"{path}/{s}_{tag}")
        part.select(F.col("cell").cast("string").alias("value")).write.mode("overwrite").text(f"{path}/{s}_barcodes_{tag}")
