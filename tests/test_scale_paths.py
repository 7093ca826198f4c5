"""Block SVD, label candidates, p-values: against numpy and brute force, over several blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromatide.operators import evaluate as EV
from chromatide.operators import sentences as S
from chromatide.operators import svd as V


@pytest.mark.parametrize("n,m,rank,cells,features", [(40, 60, 6, 10, 16), (25, 9, 9, 4096, 32_768), (60, 30, 30, 2, 7)])
def test_svd_over_blocks(spark, n, m, rank, cells, features, monkeypatch):
    monkeypatch.setattr(V, "FAN", 3)
    rng = np.random.default_rng(n)
    a = (rng.normal(size=(n, rank)) * (0.6 ** np.arange(rank))) @ rng.normal(size=(rank, m))
    a[rng.random(a.shape) < 0.3] = 0
    entries = [(int(i) * 7 - 20, int(j) * 3 + 2**40, float(a[i, j])) for i, j in zip(*np.nonzero(a))] + [(999, 2, None), (998, 2, 0.0)]
    df = spark.createDataFrame(entries, "cell long, feature_idx long, tfidf double")
    got = V.truncated_svd(df, 4, cells=cells, features=features).toPandas().pivot(index="cell", columns="component", values="value")
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    sign = np.where(vt[np.arange(len(s)), np.abs(vt).argmax(axis=1)] >= 0, 1, -1)
    want = (u * s * sign)[:, :4]
    assert got.index.tolist() == [i * 7 - 20 for i in range(n)]
    assert np.allclose(got.to_numpy(), want, atol=2e-4 * s[0])
    assert np.allclose((got.to_numpy() ** 2).sum(axis=0), s[:4] ** 2, rtol=1e-5)


def test_a_pass_sends_the_panels_of_cells_alone(spark):
    """The matrix times its transpose times a panel, with the QR factors of the inner product, which is never written."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(23, 31)) * (rng.random((23, 31)) < 0.5)
    df = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "cell long, feature long, x double")
    matrix = V._blocked(df, 6, 8)
    assert matrix.select("cb").distinct().count() > 2 and matrix.select("fb").distinct().count() > 2

    def whole(panels, width):
        out = np.zeros((23, width))
        for p in panels.where("block >= 0").collect():
            out[np.frombuffer(p["ids"], np.int64)] = np.frombuffer(p["panel"]).reshape(-1, width)
        return out

    first = V._pass(matrix, None, None, 4, 42)
    y, w = whole(first, 4), rng.normal(size=(4, 3))
    panels = first.where("block >= 0")
    second = V._pass(matrix, panels, w, 4, 42)
    assert np.allclose(whole(second, 3), a @ (a.T @ y @ w))
    r = np.concatenate([np.frombuffer(p["panel"]).reshape(-1, 3) for p in second.where("block < 0").collect()])
    assert np.allclose(r.T @ r, (a.T @ y @ w).T @ (a.T @ y @ w))
    assert V._by_features(matrix, panels).where("panel IS NOT NULL").selectExpr("max(octet_length(ids))").first()[0] <= 8 * 23


def test_svd_of_all_components_keeps_row_norms(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 20))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(20)], "cell long, feature_idx long, tfidf double")
    norms = {r["cell"]: r["n"] for r in V.truncated_svd(df, 12, cells=5, features=6).groupBy("cell").agg(F.sum(F.col("value") ** 2).alias("n")).collect()}
    assert np.allclose([norms[i] for i in range(12)], (a ** 2).sum(axis=1))
    assert V.truncated_svd(df.limit(0), 3).count() == 0


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_label_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda top: "".join(rng.choice("abcd") for _ in range(rng.randrange(top)))
    labels = sorted({word(9) for _ in range(25)} | ({""} if seed == 1 else set()))
    preds = [word(12) for _ in range(80)] + ["", "zzzzzzzzzz", "é", labels[0], None, "zz"]
    df = spark.createDataFrame([(p, "x") for p in preds] * 2, "pred string, gt string").withColumn("_p", F.lit(1)).drop("_p")
    got = EV.nearest_label(df, [*labels, None]).collect()
    assert len(got) == 2 * len(preds)
    for r in got:
        assert r["nearest"] == (None if r["pred"] is None else min(labels, key=lambda l: (_edit(r["pred"], l), l)))


def test_no_labels(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "pred string, gt string")
    assert [r["nearest"] for r in EV.nearest_label(df).collect()] == [None, None]


def test_p_value_within_the_stated_error(spark):
    z = [0.0, 1e-9, 0.3, -1.0, 1.96, -2.5758, 5.0, 8.0, -20.0, 37.0, None, float("nan")]
    got = [r["p_val"] for r in S.with_pvalue(spark.createDataFrame([(v,) for v in z], "w_stat double")).collect()]
    for v, p in zip(z[:-2], got):
        assert p == pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=1.2e-7)
    assert got[-2] is None and math.isnan(got[-1])


def test_matrix_market_parts_are_the_file(spark):
    import os

    from chromatide.session import scratch_path
    from chromatide.sources import tables as IO
    path = scratch_path(spark, "mtx-parts")
    counts = spark.range(400).selectExpr("id % 40 as cell", "id div 40 as feature_idx", "id + 1 as n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # so few lines make several parts
    try:
        IO.write_mtx(counts, counts.select("feature_idx").distinct(), counts.select("cell").distinct(), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")

    def text(name):
        folder = f"{path}/{name}".removeprefix("file:")
        parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
        return parts, [line for f in parts for line in open(os.path.join(folder, f)).read().splitlines()]

    parts, lines = text("matrix.mtx")
    assert len(parts) > 1 and lines[:2] == ["%%MatrixMarket matrix coordinate integer general", "10 40 400"]
    assert lines[2:] == [f"{r + 1} {c + 1} {r * 40 + c + 1}" for c in range(40) for r in range(10)]
    assert text("barcodes.tsv")[1] == [str(c) for c in range(40)]
    coo, dims = IO.read_mtx(spark, path)
    assert dims == (10, 40, 400)
    assert {(r["cell"], r["feature"], r["n"]) for r in coo.collect()} == {(str(i % 40), str(i // 40), i + 1) for i in range(400)}


def test_every_feature_is_ranked_without_dense_rows_in_a_shuffle(spark):
    from chromatide.operators import matrix as M
    rng = random.Random(2)
    features = [3 * f for f in range(37)]
    counts = [(c, f, rng.choice([0, 1, 1, 2])) for c in [1, 2, 5, 8] for f in features if rng.random() < 0.3] + [(9, f, 1) for f in features] + [(1, 4, 7), (None, 6, 2)]
    df = spark.createDataFrame(counts, "cell long, feature_idx long, n long")
    out = M.topk_all(df, spark.createDataFrame([(f,) for f in features * 2], "feature_idx long"), block=5, cells_per_part=2)
    got = sorted([(r["cell"] or 0, r["rank"], r["feature_idx"], r["n"]) for r in out.collect()])
    want = []
    for c in sorted({c or 0 for c, _, n in counts if n}):
        top = sorted((-n, f) for d, f, n in counts if (d or 0) == c and n)
        have = {f for _, f in top} if c else set()      # a null cell is no key: its zero features are all of them
        rows = [(f, -m) for m, f in top] + [(f, 0) for f in features if f not in have]
        want += [(c, k, f, n) for k, (f, n) in enumerate(rows[:len(features)], 1)]
    assert got == sorted(want)
    plan = out._jdf.queryExecution().toString()
    assert "LeftAnti" not in plan


def _counted(spark, rows, schema):
    """A frame, and the number of times one of its rows was made."""
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(len(part))
            yield part
    return spark.createDataFrame(rows, schema).mapInPandas(count, schema), made


def test_corpus_export_makes_each_sentence_once(spark, tmp_path):
    from chromatide.sources.tables import export_corpus
    rows = [(1, "a b", "train"), (2, "b", "test"), (3, None, "valid"), (3, "c", "valid"), (4, "d", None)]
    sent, made = _counted(spark, rows, "cell long, sentence string, split string")
    vocab = spark.createDataFrame([("a", 1, 2), ("b", 2, 1)], "feature string, n_cells long, vocab_rank long")
    export_corpus(vocab, sent, str(tmp_path), "hs")
    assert made.value == len(rows)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/valid_barcodes_hs").collect()) == ["3", "3"]
    assert [r.value for r in spark.read.text(f"{tmp_path}/test_hs").collect()] == ["b"]


def test_merged_samples_are_made_once(spark):
    from chromatide.operators.matrix import merge_samples
    a, made = _counted(spark, [("c1", "f2", 1), ("c1", "f2", 1), ("c2", "f1", 3)], "cell_name string, feature string, n long")
    b = spark.createDataFrame([("c3", "f3")], "cell_name string, feature string")
    got = [tuple(r) for r in merge_samples([a, b]).orderBy("cell_name").select("cell_name", "feature", "n", "merged_idx").collect()]
    assert made.value == 3
    assert got == [("c1", "f2", 1, 2), ("c1", "f2", 1, 2), ("c2", "f1", 3, 1), ("c3", "f3", None, 3)]
