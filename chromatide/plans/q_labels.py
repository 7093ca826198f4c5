"""Registered queries: labels, label sets, label joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatide.functions import labels as L
from chromatide.operators import labels as O
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

NORM_SQL = "regexp_replace(replace(replace(lower({c}), 'cells', ''), 'cell', ''), '^\\s+|\\s+$', '', 'g')"
STRIP_SQL = "regexp_replace(regexp_replace({c}, '\\b\\d+\\b', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _train_test(i: Inputs):
    """Train = even cells, test = odd cells; together the whole table."""
    c = i.cells
    return c.where(F.col("cell") % 2 == 0), c.where(F.col("cell") % 2 == 1)


TRAIN = "SELECT * FROM cells WHERE cell % 2 = 0"
TEST = "SELECT * FROM cells WHERE cell % 2 = 1"


@query("normalize_label", views=("cells",),
       sql=f"SELECT cell, cell_type, {NORM_SQL.format(c='cell_type')} AS label FROM cells")
def normalize_label(spark, sf):
    return Inputs(spark, sf).cells.select("cell", "cell_type", L.normalize_label("cell_type").alias("label"))


@query("strip_label_numbers", views=("cells",),
       sql=f"SELECT cell, cell_type, {STRIP_SQL.format(c='cell_type')} AS label FROM cells")
def strip_label_numbers(spark, sf):
    return Inputs(spark, sf).cells.select("cell", "cell_type", L.strip_numbers("cell_type").alias("label"))


@query("rename_barcode", views=("cells",),
       sql="SELECT cell, concat(substr(sample, 1, 4), '-', CAST(cell AS VARCHAR)) AS cell_name FROM cells")
def rename_barcode(spark, sf):
    return Inputs(spark, sf).cells.select("cell", L.rename_cells("sample", "cell").alias("cell_name"))


@query("pick_label_column", views=("cells",), sql="SELECT cell, sample, cell_type FROM cells")
def pick_label_column(spark, sf):
    c = Inputs(spark, sf).cells
    wide = c.withColumnRenamed("cell_type", "Celltype").withColumn("cell_type", F.col("Celltype"))
    return L.pick_label(wide.withColumn("Celltype", F.upper("Celltype")))


@query("label_unknown", views=("cells",),
       sql="SELECT cell, COALESCE(cell_type, 'Unknown') AS cell_type FROM cells")
def label_unknown(spark, sf):
    return Inputs(spark, sf).cells.select("cell", L.fill_unknown("cell_type").alias("cell_type"))


@query("filter_labelled", views=("cells",), sql="SELECT * FROM cells WHERE cell_type IS NOT NULL")
def filter_labelled(spark, sf):
    return Inputs(spark, sf).cells.where(F.col("cell_type").isNotNull())


@query("filter_contig_name", views=("contigs",),
       sql="SELECT contig, length(seq) AS seq_len FROM contigs WHERE regexp_matches(contig, '^chr[A-Za-z0-9]*$')")
def filter_contig_name(spark, sf):
    from chromatide.operators.sequences import filter_contigs
    c = filter_contigs(Inputs(spark, sf).contigs)
    return c.select("contig", F.length("seq").alias("seq_len"))


@query("set_union_files", views=("cells",), sql=f"""
SELECT cell, cell_type, NULL::VARCHAR AS sample FROM ({TRAIN}) UNION ALL SELECT cell, cell_type, sample FROM ({TEST})""")
def set_union_files(spark, sf):
    tr, te = _train_test(Inputs(spark, sf))
    return O.union_all([tr.select("cell", "cell_type"), te])


@query("set_intersect_labels", views=("cells",), sql=f"""
SELECT {NORM_SQL.format(c='cell_type')} AS label FROM ({TRAIN}) WHERE cell_type IS NOT NULL
INTERSECT SELECT {NORM_SQL.format(c='cell_type')} FROM ({TEST}) WHERE cell_type IS NOT NULL""")
def set_intersect_labels(spark, sf):
    tr, te = _train_test(Inputs(spark, sf))
    a = tr.select(L.normalize_label("cell_type").alias("label"))
    b = te.select(L.normalize_label("cell_type").alias("label"))
    return O.shared_labels(a, b)


@query("set_difference_group", views=("cells",), sql=f"""
SELECT cell FROM cells EXCEPT SELECT cell FROM cells WHERE {NORM_SQL.format(c='cell_type')} = 'microglia'""")
def set_difference_group(spark, sf):
    c = Inputs(spark, sf).cells
    g1 = c.where(L.normalize_label("cell_type") == "microglia")
    return O.complement(c.select("cell"), g1)


@query("set_union_distinct", views=("cells",), sql=f"""
SELECT cell_type FROM ({TRAIN}) UNION SELECT cell_type FROM ({TEST})""")
def set_union_distinct(spark, sf):
    tr, te = _train_test(Inputs(spark, sf))
    return O.union_distinct([tr.select("cell_type"), te.select("cell_type")])


@query("join_metadata", views=("counts", "cells"), sql="""
SELECT c.cell, m.sample, m.cell_type FROM (SELECT DISTINCT cell FROM counts) c LEFT JOIN cells m ON m.cell = c.cell""")
def join_metadata(spark, sf):
    i = Inputs(spark, sf)
    return O.add_metadata(i.counts.select("cell").distinct(), i.cells)


@query("join_shared_labels", views=("cells",), sql=f"""
WITH tr AS (SELECT cell, {NORM_SQL.format(c='cell_type')} AS cell_type FROM ({TRAIN})),
     te AS (SELECT cell, {NORM_SQL.format(c='cell_type')} AS cell_type FROM ({TEST})),
     k AS (SELECT cell_type FROM tr WHERE cell_type IS NOT NULL INTERSECT SELECT cell_type FROM te WHERE cell_type IS NOT NULL)
SELECT 'train' AS side, cell, cell_type FROM tr WHERE cell_type IN (SELECT cell_type FROM k)
UNION ALL SELECT 'test', cell, cell_type FROM te WHERE cell_type IN (SELECT cell_type FROM k)""")
def join_shared_labels(spark, sf):
    tr, te = _train_test(Inputs(spark, sf))
    a, b = O.clean_labels(tr.select("cell", "cell_type"), te.select("cell", "cell_type"))
    return a.select(F.lit("train").alias("side"), "cell", "cell_type").unionByName(
        b.select(F.lit("test").alias("side"), "cell", "cell_type"))


@query("join_class_id", views=("cells",), sql=f"""
SELECT c.cell, {NORM_SQL.format(c='c.cell_type')} AS cell_type, CAST(k.class_id AS INTEGER) AS class_id FROM cells c JOIN
 (SELECT label, row_number() OVER (ORDER BY label) - 1 AS class_id FROM
   (SELECT DISTINCT {NORM_SQL.format(c='cell_type')} AS label FROM cells WHERE cell_type IS NOT NULL)) k
 ON k.label = {NORM_SQL.format(c='c.cell_type')} WHERE c.cell_type IS NOT NULL""")
def join_class_id(spark, sf):
    c = Inputs(spark, sf).cells.where(F.col("cell_type").isNotNull())
    c = c.select("cell", L.normalize_label("cell_type").alias("cell_type"))
    ids = O.class_ids_from_labels(c)
    return O.add_class_id(c, ids)


@query("agg_label_counts", views=("cells",), sql=f"""
SELECT {NORM_SQL.format(c='cell_type')} AS label, COUNT(*) AS n FROM cells WHERE cell_type IS NOT NULL GROUP BY 1""")
def agg_label_counts(spark, sf):
    c = Inputs(spark, sf).cells.select(L.normalize_label("cell_type").alias("label"))
    return O.value_counts(c, "label")
