"""Derived inputs: the reference's table shapes built from the driver's tables.

Each view exists twice: as a DataFrame built with the DataFrame API (what the
registered queries run) and as a DuckDB SQL text (what the oracle runs).  The
views read whole tables; none is cut to an id range or a text prefix.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatide.functions.letters import replaced
from chromatide.functions.seeded import sql_seeded_hash

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Letters to bases for the synthetic genome (a..z then blank).
LETTERS = "abcdefghijklmnopqrstuvwxyz "
BASES = "ACGTACGTACGTACGTACGTACGTACA"
# The five cell-type labels of the synthetic cells (cell % 6), 5 -> NULL.
CELL_TYPES = ["T Cells", "t cell", "B cell 2", "Unicellular 12 x", "Microglia"]

SENTENCE_SEED = 42


def _s(c):
    return F.col(c).cast("string")


class Inputs:
    """Lazily built fixture DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def counts(self) -> DataFrame:
        li = self.table("lineitem")
        return (li.groupBy(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("feature_idx"))
                .agg(F.sum("l_quantity").cast("bigint").alias("n")))

    @cached_property
    def features(self) -> DataFrame:
        p = self.table("part")
        start = F.col("p_partkey") * 1000
        end = start + F.col("p_size") * 20
        chrom = F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("string"))
        return p.select(
            F.col("p_partkey").alias("feature_idx"),
            F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")).alias("feature"),
            chrom.alias("chrom"), start.alias("start_pos"), end.alias("end_pos"))

    @cached_property
    def cells(self) -> DataFrame:
        s = self.table("supplier")
        m = F.col("s_suppkey") % 6
        ct = F.when(m == 0, CELL_TYPES[0]).when(m == 1, CELL_TYPES[1]).when(m == 2, CELL_TYPES[2]) \
            .when(m == 3, CELL_TYPES[3]).when(m == 4, CELL_TYPES[4])
        return s.select(F.col("s_suppkey").alias("cell"),
                        F.concat(F.lit("sample"), _s("s_nationkey")).alias("sample"),
                        ct.alias("cell_type"))

    @cached_property
    def contigs(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.concat(F.lit("chr"), _s("doc_id")).alias("contig"),
                        replaced("text", LETTERS, BASES, "N").alias("seq"),
                        replaced("text", "aeiourst", "ACGTacgt").alias("raw_seq"))

    @cached_property
    def regions(self) -> DataFrame:
        """Regions over all contigs and their whole length: the contig by number, the start within its length."""
        d = self.table("documents").select("doc_id", F.greatest(F.length("text"), F.lit(1)).cast("bigint").alias("_len"))
        p = self.table("part").withColumn("doc_id", F.col("p_partkey") % max(1, d.count()))
        st = (F.col("p_partkey") * 104729) % F.col("_len")
        return p.join(d, "doc_id").select(F.col("p_partkey").alias("region_id"),
                                          F.concat(F.lit("chr"), _s("doc_id")).alias("contig"),
                                          st.alias("start_pos"), (st + F.col("p_size") * 40).alias("end_pos"))

    @cached_property
    def blacklist(self) -> DataFrame:
        s = self.table("supplier")
        st = (F.col("s_suppkey") * 7919) % 200000
        return s.select(F.concat(F.lit("chr"), (F.col("s_suppkey") % 22 + 1).cast("string")).alias("chrom"),
                        st.alias("start_pos"), (st + 1500).alias("end_pos"))

    @cached_property
    def hits(self) -> DataFrame:
        li = self.table("lineitem")
        q = F.col("l_quantity").cast("int")
        return li.select(F.col("l_orderkey").alias("q_name"), F.col("l_linenumber").alias("line_no"),
                         F.col("l_partkey").alias("t_name"), F.col("l_suppkey").alias("q_start"),
                         (F.col("l_suppkey") + q).alias("q_end"), q.alias("matches"),
                         F.round(F.col("l_quantity") * F.col("l_discount") * 8).cast("int").alias("mis_matches"),
                         F.lit(0).alias("rep_matches"))

    @cached_property
    def fragments(self) -> DataFrame:
        e = self.table("events")
        st = (F.col("event_id") * 13) % 5000
        return e.select(F.concat(F.lit("chr"), (F.col("user_id") % 5).cast("string")).alias("chrom"),
                        st.alias("start_pos"), (st + 50 + F.col("event_id") % 200).alias("end_pos"),
                        F.col("user_id").alias("barcode"), F.col("event_type").alias("grp"))

    @cached_property
    def preds(self) -> DataFrame:
        e = self.table("events")
        return e.select(F.col("event_id").alias("sample_id"), F.col("event_type").alias("gt"),
                        F.expr("substr(event_type, CAST(1 + event_id % 2 AS INT), CAST(3 + event_id % 4 AS INT))").alias("pred"))

    @cached_property
    def words(self) -> DataFrame:
        c = self.table("conversations")
        return c.select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("sentence"))

    @cached_property
    def corpus(self) -> DataFrame:
        d = self.table("documents")
        m = F.col("doc_id") % 10
        return d.select("doc_id", F.col("source").alias("dataset"),
                        F.when(m < 8, "train").when(m == 8, "test").otherwise("valid").alias("split"),
                        F.col("lang").alias("cell_type"))

    @cached_property
    def logits(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select("vec_id", (F.col("vec_id") % 50).cast("bigint").alias("cell"), "label", "embedding")

    @cached_property
    def sentences(self) -> DataFrame:
        """Cell sentences (A09) over ``counts``: nonzero features by count desc, seeded ties."""
        from chromatide.operators.sentences import sentences
        return sentences(self.counts, seed=SENTENCE_SEED)

    @cached_property
    def vocab_words(self) -> DataFrame:
        """Word vocabulary: distinct upper-cased letter-only words of ``benchmark``."""
        b = self.table("benchmark")
        w = F.explode(F.split(F.upper(F.regexp_replace("text", "[^A-Za-z ]", " ")), " +")).alias("word")
        return b.select(w).where(F.col("word") != "").distinct()


# ---- SQL forms (DuckDB) -------------------------------------------------------

VIEW_SQL = {
    "counts": "SELECT l_suppkey AS cell, l_partkey AS feature_idx, CAST(SUM(l_quantity) AS BIGINT) AS n "
              "FROM lineitem GROUP BY l_suppkey, l_partkey",
    "features": "SELECT p_partkey AS feature_idx, concat('chr', CAST(p_partkey % 22 + 1 AS VARCHAR), ':', "
                "CAST(p_partkey*1000 AS VARCHAR), '-', CAST(p_partkey*1000 + p_size*20 AS VARCHAR)) AS feature, "
                "concat('chr', CAST(p_partkey % 22 + 1 AS VARCHAR)) AS chrom, p_partkey*1000 AS start_pos, "
                "p_partkey*1000 + p_size*20 AS end_pos FROM part",
    "cells": "SELECT s_suppkey AS cell, concat('sample', CAST(s_nationkey AS VARCHAR)) AS sample, "
             "CASE s_suppkey % 6 WHEN 0 THEN 'T Cells' WHEN 1 THEN 't cell' WHEN 2 THEN 'B cell 2' "
             "WHEN 3 THEN 'Unicellular 12 x' WHEN 4 THEN 'Microglia' ELSE NULL END AS cell_type FROM supplier",
    "contigs": "SELECT concat('chr', CAST(doc_id AS VARCHAR)) AS contig, "
               f"regexp_replace(translate(text,'{LETTERS}','{BASES}'),'[^ACGT]','N','g') AS seq, "
               "translate(text,'aeiourst','ACGTacgt') AS raw_seq FROM documents",
    "regions": "SELECT p_partkey AS region_id, concat('chr', CAST(doc_id AS VARCHAR)) AS contig, "
               "(p_partkey*104729) % greatest(length(text), 1) AS start_pos, "
               "(p_partkey*104729) % greatest(length(text), 1) + p_size*40 AS end_pos "
               "FROM part JOIN documents ON doc_id = p_partkey % (SELECT COUNT(*) FROM documents)",
    "blacklist": "SELECT concat('chr', CAST(s_suppkey % 22 + 1 AS VARCHAR)) AS chrom, (s_suppkey*7919) % 200000 "
                 "AS start_pos, (s_suppkey*7919) % 200000 + 1500 AS end_pos FROM supplier",
    "hits": "SELECT l_orderkey AS q_name, l_linenumber AS line_no, l_partkey AS t_name, l_suppkey AS q_start, "
            "l_suppkey + CAST(l_quantity AS INT) AS q_end, CAST(l_quantity AS INT) AS matches, "
            "CAST(round(l_quantity*l_discount*8) AS INT) AS mis_matches, 0 AS rep_matches FROM lineitem",
    "fragments": "SELECT concat('chr', CAST(user_id % 5 AS VARCHAR)) AS chrom, (event_id*13) % 5000 AS start_pos, "
                 "(event_id*13) % 5000 + 50 + event_id % 200 AS end_pos, user_id AS barcode, event_type AS grp "
                 "FROM events",
    "preds": "SELECT event_id AS sample_id, event_type AS gt, substr(event_type, CAST(1 + event_id % 2 AS INT), "
             "CAST(3 + event_id % 4 AS INT)) AS pred FROM events",
    "words": "SELECT conv_id, turn, regexp_replace(text,'[^A-Za-z ]','','g') AS sentence FROM conversations",
    "corpus": "SELECT doc_id, source AS dataset, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 "
              "THEN 'test' ELSE 'valid' END AS split, lang AS cell_type FROM documents",
    "logits": "SELECT vec_id, CAST(vec_id % 50 AS BIGINT) AS cell, label, embedding FROM embeddings",
    "sentences": "SELECT cell, list(feature_idx ORDER BY n DESC, "
                 + sql_seeded_hash(SENTENCE_SEED, "cell", "feature_idx")
                 + " ASC, feature_idx ASC) AS tokens FROM counts GROUP BY cell",
    "vocab_words": "SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(upper(regexp_replace(text, "
                   "'[^A-Za-z ]', ' ', 'g')), ' +')) AS word FROM benchmark) WHERE word <> ''",
}

VIEW_DEPS = {"sentences": ["counts"]}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the CTEs of ``views`` (dependencies first)."""
    order: list[str] = []

    def add(v):
        for d in VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in order)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
