"""Hand-made tables for the semantic facts of SURVEY §1.3 (a..gg) and operator details."""

import math
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from chromatide.functions import labels as L
from chromatide.functions import strdist
from chromatide.operators import distance as D
from chromatide.operators import evaluate as EV
from chromatide.operators import hits as H
from chromatide.operators import labels as LO
from chromatide.operators import matrix as M
from chromatide.operators import regions as R
from chromatide.operators import sampling as Z
from chromatide.operators import sentences as S
from chromatide.operators import sequences as Q


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols).collect()]


def test_a_topk_ties_and_zero_fill(spark):
    counts = spark.createDataFrame([(1, 5, 3), (1, 2, 3), (1, 9, 7)], "cell long, feature_idx long, n long")
    feats = spark.createDataFrame([(i, f"f{i}") for i in range(1, 11)], "feature_idx long, feature string")
    top = M.topk(counts, 2)
    assert rows(top, "rank", "feature_idx") == [(1, 9), (2, 2)]
    dense = M.topk_dense(counts, feats, 6)
    assert [r["feature_idx"] for r in dense.orderBy("rank").collect()] == [9, 2, 5, 1, 3, 4]


def test_b_sentences_nonzero_and_seeded(spark):
    counts = spark.createDataFrame([(1, f, n) for f, n in [(1, 2), (2, 2), (3, 2), (4, 0), (5, 9)]],
                                   "cell long, feature_idx long, n long")
    a = S.sentences(counts, 42).first()["tokens"]
    b = S.sentences(counts, 42).first()["tokens"]
    assert a == b and a[0] == 5 and sorted(a[1:]) == [1, 2, 3] and 4 not in a


def test_d_normalize_label(spark):
    df = spark.createDataFrame([("T Cells",), ("Microglia cell",), ("Unicellular",), (" B cells 2 ",), (None,)], "c string")
    got = [r[0] for r in df.select(L.normalize_label("c")).collect()]
    assert got == ["t", "microglia", "uniular", "b  2", None]


def test_e_null_labels_never_match(spark):
    tr = spark.createDataFrame([(1, None), (2, "A cell")], "cell long, cell_type string")
    te = spark.createDataFrame([(3, None), (4, "a")], "cell long, cell_type string")
    a, b = LO.clean_labels(tr, te)
    assert rows(a, "cell") == [(2,)] and rows(b, "cell") == [(4,)]


def test_h_closed_overlap_blacklist(spark):
    reg = spark.createDataFrame([(1, "chr1", 1, 5), (2, "chr1", 6, 9), (3, "chr2", 5, 5)],
                                "rid long, chrom string, start_pos long, end_pos long")
    bl = spark.createDataFrame([("chr1", 5, 5), ("chr2", 6, 100)], "chrom string, start_pos long, end_pos long")
    assert rows(R.remove_blacklist(reg, bl, "rid", width=2), "rid") == [(2,), (3,)]


def test_j_fasta_reader(spark, tmp_path):
    from chromatide.sources.genome import read_fasta
    p = tmp_path / "hg38.fa"
    p.write_text(">chr1\nACGT\nac\n>chrUn_x\nGGGG\n>chr2\nNNNN\n>chr1\nTT\nTT\n")
    g = read_fasta(spark, str(p), chunk=3)
    got = {(r["contig"], r["chunk_id"]): r["seq"] for r in g.collect()}
    assert got == {("chr1", 0): "TTT", ("chr1", 1): "T", ("chr2", 0): "NNN", ("chr2", 1): "N"}
    assert {r["genome"] for r in g.collect()} == {"hg38"}


def test_k_lowercase_is_unknown(spark):
    df = spark.createDataFrame([("ACgtN*",)], "s string")
    assert df.select(Q.char_ids("s")).first()[0] == [7, 8, 6, 6, 11, 6]
    assert df.select(Q.char_ids("s", upper=True)).first()[0] == [7, 8, 9, 10, 11, 6]


def test_n_windows_pad_and_out_of_range(spark):
    contigs = spark.createDataFrame([("chr1", "ACGTACGTAC")], "contig string, seq string")
    ch = Q.chunk_contigs(contigs, 4)
    reg = spark.createDataFrame([(1, "chr1", 8, 20), (2, "chr1", 50, 60), (3, "chr1", 0, 3)],
                                "region_id long, contig string, start_pos long, end_pos long")
    fx = {r["region_id"]: (r["window"], r["truncated"]) for r in Q.window_fixed(reg, ch, 6, size=4).collect()}
    assert fx == {1: ("ACNNNN", True), 2: ("NNNNNN", True), 3: ("ACGNNN", False)}
    rnd = {r["region_id"]: (r["window"], r["out_of_range"]) for r in Q.window_random(reg, ch, 6, 1, size=4).collect()}
    assert rnd[2] == ("NNNNNN", True)
    assert all(len(w) == 6 for w, _ in rnd.values())


def test_q_knn_includes_self_and_r_ncd_asymmetric(spark):
    assert strdist.zlib_ncd("abcabcabcabcabc", "aaaaaaaaab") != strdist.zlib_ncd("aaaaaaaaab", "abcabcabcabcabc")
    df = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "xyz")], "cell long, s string")
    m = D.distance_matrix(df, "cell", "s", "levenshtein")
    nn = D.knn(m, 1)
    assert rows(nn, "i", "j") == [(1, 1), (2, 2), (3, 3)]


def test_t_split_fractions(spark):
    with pytest.raises(ValueError):
        Z.check_fractions(0.8, 0.1, 0.2)
    Z.check_fractions(0.7, 0.2, 0.1)  # float sum 0.9999999999999999 passes with tolerance
    df = spark.range(1000).withColumnRenamed("id", "k")
    s = Z.split(df, "k", 0.8, 0.1, 0.1, 42)
    n = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert n == {"test": 100, "valid": 100, "train": 800}
    assert s.select("k").distinct().count() == 1000


def test_w_dedupe_sequential(spark):
    df = spark.createDataFrame([(["A", "X", "X", "X", "Y", "B", "Y"],), (["X", "X"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(S.dedupe_average_position("t")).collect()]
    assert got == [["A", "X", "Y", "B"], ["X"], []]
    m = spark.createDataFrame([(["NOT_A_GENE", "A", "NOT_A_GENE"],)], "t array<string>")
    assert m.select(S.dedupe_average_position("t", "NOT_A_GENE")).first()[0] == ["NOT_A_GENE", "A", "NOT_A_GENE"]


def test_x_inverse_transform_last_duplicate(spark):
    names = spark.createDataFrame([(1, 0, "G1"), (1, 1, "G2"), (1, 2, "G1"), (1, 3, "NOPE")], "cell long, pos long, feature string")
    dic = spark.createDataFrame([(10, "G1"), (20, "G2"), (30, "G3")], "feature_idx long, feature string")
    got = {r["feature_idx"]: r["value"] for r in S.reconstruct(names, dic, -1.0, 2.0).collect()}
    assert got == pytest.approx({10: 2.0 - math.log10(3), 20: 2.0 - math.log10(2)})
    dense = S.densify(S.reconstruct(names, dic, -1.0, 2.0), dic, spark.createDataFrame([(1,)], "cell long")).first()
    assert dense["vector"][2] == 0.0 and len(dense["vector"]) == 3


@pytest.mark.parametrize("block", [None, 3])
def test_dense_vectors_from_blocks(spark, monkeypatch, block):
    """Several blocks, a feature index that comes twice or is null, a null cell, a missing value; no dense row is shuffled."""
    monkeypatch.setattr(S, "DENSE_BLOCK", 4)
    ids = [None, 3, 5, 5, 8, 9, 11, 20, 21, 22]
    dic = spark.createDataFrame([(i, f"G{i}") for i in ids], "feature_idx long, feature string")
    values = {(1, 5): 2.5, (1, 22): -1.0, (2, 3): 4.0, (None, 3): 7.0, (2, 99): 1.0}
    rows = [(c, f, v) for (c, f), v in values.items()] + [(2, 8, None), (2, 9, float("nan"))]
    df = spark.createDataFrame(rows, "cell long, feature_idx long, value double")
    cells = spark.createDataFrame([(1,), (2,), (3,), (None,)], "cell long")
    want = {c: [0.0 if c is None else values.get((c, f), 0.0) for f in ids] for c in (1, 2, 3, None)}
    got = S.densify(df, dic, cells, block)
    if block is None:
        assert {r["cell"]: r["vector"] for r in got.collect()} == want
        return
    parts = sorted(got.collect(), key=lambda r: r["block"])
    assert {c: [x for r in parts if r["cell"] == c for x in r["vector"]] for c in want} == want
    assert [x for r in parts if r["cell"] == 3 for x in r["ids"]] == ids
    assert max(len(r["ids"]) for r in parts) == block


def test_y_nearest_label_ties_by_text(spark):
    p = spark.createDataFrame([("ab", "ab"), ("cd", "ab"), ("zz", "xy")], "gt string, pred string")
    got = {r["pred"]: r["nearest"] for r in EV.nearest_label(p, ["ab", "cd", "xy"]).collect()}
    assert got["xy"] == "xy" and got["ab"] == "ab"
    t = spark.createDataFrame([("a",)], "pred string")
    assert EV.nearest_label(t, ["b", "c"]).first()["nearest"] == "b"


def test_z_shift_and_unmask(spark):
    df = spark.createDataFrame([([-100, -100, 5, 6, 1], [9, 8, 7, 6, 5])], "labels array<int>, preds array<int>")
    r = df.select(EV.unmask(F.col("labels")).alias("y"), EV.shift_preds(F.col("labels"), F.col("preds")).alias("p")).first()
    assert r["y"] == [5, 6] and r["p"] == [8, 7]


def test_aa_macro_rules(spark):
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("c", "a")], "gt string, pred string")
    m = EV.macro_metrics(p).first()
    # precision: a=1/3, b=0/1, c undefined (never predicted) -> mean over a, b
    assert m["precision"] == pytest.approx((1 / 3 + 0) / 2)
    # recall: a=1/2, b=0, c=0 -> all defined
    assert m["recall"] == pytest.approx((0.5 + 0 + 0) / 3)
    # f1: a=2/(2+2+1), b=0, c=0 (undefined counts as 0)
    assert m["macro_f1"] == pytest.approx((2 / 5) / 3)
    assert m["accuracy"] == pytest.approx(0.25)


def test_bb_short_fallback_and_constant(spark):
    tp = spark.createDataFrame([(1, 0, 7, 7), (2, 0, 7, 8), (2, 1, 7, 9), (3, 0, 5, 5), (3, 1, 6, 7)],
                               "sample long, pos int, y long, p long")
    got = {r["sample"]: r for r in EV.correlations(tp, "sample").collect()}
    assert got[1]["pearson"] == 1.0 and got[1]["r2"] == 1.0
    assert math.isnan(got[2]["pearson"])
    assert got[3]["pearson"] == pytest.approx(1.0)


def test_ff_identity_and_longest_hit(spark):
    h = spark.createDataFrame([("q", 1, "t1", 0, 10, 8, 2, 0), ("q", 2, "t2", 5, 15, 0, 0, 0)],
                              "q_name string, line_no int, t_name string, q_start long, q_end long, matches int, mis_matches int, rep_matches int")
    ids = [r["pct_identity"] for r in H.with_identity(h).orderBy("line_no").collect()]
    assert ids == [80.0, None]
    assert H.longest_hit(h).first()["line_no"] == 1


def test_rank_sum_pvalue_and_midranks(spark):
    rm = spark.createDataFrame([(1, 7, 3), (2, 7, 3), (3, 7, 1)], "cell long, feature_idx long, score long")
    g1 = spark.createDataFrame([(1,), (4,)], "cell long")
    g2 = spark.createDataFrame([(2,), (3,), (5,)], "cell long")
    sent = spark.createDataFrame([(c,) for c in range(1, 6)], "cell long")
    out = S.with_pvalue(S.rank_sum_test(rm, g1, g2, 0.1, sent)).first()
    # ranks over 5 cells: zeros (cells 4, 5) -> 1.5, score 1 -> 3, score 3 (x2) -> 4.5
    r1 = 4.5 + 1.5
    z = (r1 - 2 * 6 / 2) / math.sqrt(2 * 3 * 6 / 12)
    assert out["rank_sum_1"] == pytest.approx(r1) and out["w_stat"] == pytest.approx(z)
    assert out["p_val"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    dense = (rng.random((30, 12)) < 0.4) * rng.random((30, 12))
    vals = [(i, j, float(dense[i, j])) for i in range(30) for j in range(12) if dense[i, j] != 0]
    df = spark.createDataFrame(vals, "cell long, feature_idx long, tfidf double")
    out = M.svd(df, k=4).toPandas()
    us = np.zeros((30, 4))
    for r in out.itertuples():
        us[r.cell, r.component - 1] = r.value
    s_ref = np.linalg.svd(dense, compute_uv=False)[:4]
    assert np.allclose(np.linalg.norm(us, axis=0), s_ref, rtol=1e-6)


def test_label_propagation_planted(spark):
    e = [(a, b, 1.0) for a in range(5) for b in range(a + 1, 5)] + [(a, b, 1.0) for a in range(10, 15) for b in range(a + 1, 15)]
    e.append((4, 10, 0.1))
    lab = D.label_propagation(spark.createDataFrame(e, "a long, b long, jaccard double"), 10)
    got = {r["node"]: r["label"] for r in lab.collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1
    assert got[0] != got[10]


def test_class_id_unknown_fails(spark):
    df = spark.createDataFrame([("a",), ("zzz",)], "cell_type string")
    ids = spark.createDataFrame([("a", 0)], "label string, class_id int")
    with pytest.raises(Exception):
        LO.add_class_id(df, ids).collect()


def test_jaro_vectorised_equals_scalar():
    import random
    random.seed(3)
    a = ["".join(random.choice("abcd") for _ in range(random.randrange(0, 12))) for _ in range(500)]
    b = ["".join(random.choice("abcd") for _ in range(random.randrange(0, 12))) for _ in range(500)]
    assert list(strdist.jaro_batch(a, b)) == [strdist.jaro(x, y) for x, y in zip(a, b)]
    assert list(strdist.jaro_batch(a, b, True)) == [strdist.jaro_winkler(x, y) for x, y in zip(a, b)]
    assert strdist.damerau_levenshtein("ca", "abc") == 2


def test_shift_with_no_kept_labels_is_empty(spark):
    df = spark.createDataFrame([([-100, -100], [3, 4])], "labels array<int>, preds array<int>")
    assert df.select(EV.shift_preds(F.col("labels"), F.col("preds"))).first()[0] == []


def test_i_matrix_orientation_checked(spark, tmp_path):
    from chromatide.sources import tables as IO
    counts = spark.createDataFrame([(1, 10, 3), (2, 10, 1), (2, 30, 5)], "cell long, feature_idx long, n long")
    feats = spark.createDataFrame([(10,), (20,), (30,)], "feature_idx long")
    cells = spark.createDataFrame([(1,), (2,)], "cell long")
    path = str(tmp_path / "mtx")
    IO.write_mtx(counts, feats, cells, path)
    coo, dims = IO.read_mtx(spark, path, "features_x_cells")
    assert dims == (3, 2, 3)
    assert sorted((r["cell"], r["feature"], r["n"]) for r in coo.collect()) == [("1", "10", 3), ("2", "10", 1), ("2", "30", 5)]
    f = spark.read.text(f"{path}/features.tsv")
    c = spark.read.text(f"{path}/barcodes.tsv")
    assert IO.check_dims(dims, f, c, "features_x_cells").first()["ok"]
    with pytest.raises(ValueError):
        IO.check_dims(dims, f, c, "cells_x_features")


def test_symbols_beyond_the_first_plane(spark):
    from pyspark.sql import functions as F
    from chromatide.operators.sentences import symbols
    ids = [0, 35_327, 35_328, 35_400, 45_568, 100_000, 100_001, 1_092_095]
    df = spark.createDataFrame([(ids, [100_000], [100_001])], "t array<int>, a array<int>, b array<int>")
    got = df.select(symbols("t").alias("t"), F.levenshtein(symbols("a"), symbols("b")).alias("d")).first()
    assert len(got["t"]) == len(set(got["t"])) == len(ids) and got["d"] == 1


def test_label_propagation_comes_to_rest(spark):
    from chromatide.operators.distance import label_propagation
    edges = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "a long, b long, jaccard double")
    got = dict(label_propagation(edges, iterations=2).collect())
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]


def test_windows_over_two_fasta_genomes(spark, tmp_path):
    from chromatide.sources.genome import read_fasta
    (tmp_path / "one.fa").write_text(">chr1\nACGTAC\nGTAA\n")
    (tmp_path / "two.fa").write_text(">chr1\nTTTTGG\n")
    chunks = read_fasta(spark, [str(tmp_path / "one.fa"), str(tmp_path / "two.fa")], 4)
    reg = spark.createDataFrame([(1, "one", "chr1", 2, 8), (2, "two", "chr1", 2, 8), (3, "three", "chr1", 0, 4)],
                                "region_id long, genome string, contig string, start_pos long, end_pos long")
    got = {r["region_id"]: (r["window"], r["truncated"]) for r in Q.window_fixed(reg, chunks, 6, size=4).collect()}
    assert got == {1: ("GTACGT", False), 2: ("TTGGNN", True), 3: ("NNNNNN", True)}
    rnd = {r["region_id"]: (r["window"], r["out_of_range"]) for r in Q.window_random(reg, chunks, 6, 1, size=4).collect()}
    assert rnd == {1: ("GTACGT", False), 2: ("TTGGNN", False), 3: ("NNNNNN", True)}
    one = Q.window_fixed(reg.drop("genome").where("region_id = 1"), chunks, 6, size=4, genome=F.lit("one")).collect()
    assert [r["window"] for r in one] == ["GTACGT"]


def test_orders_csv_layout(spark, tmp_path):
    from chromatide.sources.tables import read_orders, write_orders
    (tmp_path / "a.csv").write_text("cell_type,file_name,top_1,top_2\nT,x.h5ad,chr1-1-2,chr2-3-4\nB,x.h5ad,chr2-3-4,\n")
    rows = sorted(tuple(r) for r in read_orders(spark, str(tmp_path / "a.csv"), 2).collect())
    assert rows == [("B", "x.h5ad", 1, "chr2-3-4"), ("T", "x.h5ad", 1, "chr1-1-2"), ("T", "x.h5ad", 2, "chr2-3-4")]
    wide = spark.createDataFrame([(7, "T", "x.h5ad", "r1", "r2")], "cell long, cell_type string, file_name string, top_2 string, top_1 string")
    write_orders(wide, str(tmp_path / "w"))
    back = sorted(tuple(r) for r in read_orders(spark, str(tmp_path / "w"), 2, with_cell=True).collect())
    assert back == [(7, "T", "x.h5ad", 1, "r2"), (7, "T", "x.h5ad", 2, "r1")]


def test_kmer_hits_keep_frequent_tiles(spark):
    seq = "ACCGTTAGCATGGCTAACTTGC"   # two tiles, each in more targets than one block holds
    t = spark.createDataFrame([(f"t{i}", seq) for i in range(2100)], "contig string, seq string")
    q = spark.createDataFrame([("q", seq)], "contig string, seq string")
    got = H.kmer_hits(q, t).collect()
    assert sorted(r["t_name"] for r in got) == sorted(f"t{i}" for i in range(2100))
    assert all((r["n_seeds"], r["identity"], r["q_start"], r["q_end"]) == (2, 100.0, 0, 22) for r in got)


def test_windows_are_tokenised_after_the_gather(spark):
    from chromatide.operators import examples as X
    rows = [("a", 2, "ACGT"), ("a", 1, "NNx"), ("b", 1, ""), ("b", 2, None), (None, 1, "T")]
    df = spark.createDataFrame(rows, "cell string, rank int, window string")
    before = X.stack_sequences(X.sequence_ids(df.where("window is not null")), "cell")
    got = X.stack_windows(df, "cell")
    assert sorted(map(str, got.collect())) == sorted(map(str, before.collect())) and got.count() == 3
    assert {r["cell"]: r["input_ids_of_seqs"] for r in got.collect()}["a"] == [[0, 11, 11, 6, 1], [0, 7, 8, 9, 10, 1]]
    assert X.stack_windows(df.limit(0), "cell").count() == 0


def test_shots_and_centroids_inside_the_plan(spark):
    from chromatide.operators import evaluate as E
    from chromatide.operators import sampling as Z
    made = spark.createDataFrame([(i, f"c{i % 3}" if i % 7 else None) for i in range(40)], "id long, kind string")
    shots = Z.few_shot(made, "kind", "id", 2, 5)
    want = [r["id"] for r in sorted(shots.collect(), key=lambda r: (r["kind"] or "", r["shot"]))]
    got = {r["id"]: r["shot_ids"] for r in Z.with_shots(made, shots, "kind", "id").collect()}
    assert len(want) == 8 and got == {i: [x for x in want if x != i] for i in range(40)}
    assert all(r["shot_ids"] == [] for r in Z.with_shots(made, shots.limit(0), "kind", "id").collect())
    vectors = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 0.0]), (1, [9.0, 0.0]), (2, [11.0, 0.0]), (None, [1.0, 1.0])], "label int, v array<double>")
    cents = E.fit_centroids(vectors, "label", "v")
    tie = spark.createDataFrame([([10.0, 0.0],), ([1.0, 1.0],), (None,)], "v array<double>")
    assert [r["pred"] for r in E.score_centroids(tie, cents, "label", "v").collect()][:2] == [1, 0]
    assert all(r["pred"] is None for r in E.score_centroids(tie, cents.limit(0), "label", "v").collect())


def test_fasta_lines_are_joined_to_pieces():
    import pyarrow as pa
    from chromatide.sources.genome import _walk
    lines = ["TT", ">chr1"] + ["ACGTACGTAC"] * 100 + ["é", ">chr2", "", "GG"]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(lines)), pa.array(lines), pa.array([3] * len(lines), pa.int32()),
                                        pa.array(range(len(lines)), pa.int64())], ["_file", "_line", "_pid", "_mid"])
    got = [r for b in _walk(iter([batch.slice(0, 50), batch.slice(50)]), ">chr", 400, True) for r in b.to_pylist()]
    assert [(r["_file"], r["_inst"], r["_off"], r["_len"]) for r in got[:3]] == [("f", None, 0, 2), (None, 1, 0, 400), (None, 1, 400, 80)]
    assert "".join(r["_line"] for r in got if r["_inst"] == 1) == "ACGTACGTAC" * 100 + "é"
    marks = [r for b in _walk(iter([batch]), ">chr", 400, False) for r in b.to_pylist()]
    assert [(r["_inst"], r["_off"], r["_len"], r["_line"]) for r in marks] == [(1, 0, None, ">chr1"), (103, 0, None, ">chr2"), (103, 2, 2, None)]


def test_fasta_contigs_over_many_partitions(spark, tmp_path):
    from chromatide.sources.genome import read_fasta
    rng = random.Random(3)
    want = {}
    for name in ("one", "two"):
        text = "skipped\n"
        for c in range(4):
            seq = "".join(rng.choice("ACGTN") for _ in range([700, 0, 1, 333][c]))
            want[name, f"chr{c}"] = seq
            text += f">chr{c}\n" + "".join(seq[i:i + 7] + "\n" for i in range(0, len(seq), 7))
        (tmp_path / f"{name}.fa").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = read_fasta(spark, [str(tmp_path / "one.fa"), str(tmp_path / "two.fa")], 50).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: r["chunk_id"]):
        assert len(r["seq"]) <= 50
        got[r["genome"], r["contig"]] = got.get((r["genome"], r["contig"]), "") + r["seq"]
    assert got == {k: v for k, v in want.items() if v}


def test_empty_ranges_have_no_tiles(spark):
    from chromatide.operators.regions import tile
    df = spark.createDataFrame([("a", 0, 5), ("b", 0, 0), ("c", 7, 3), ("d", 0, None), ("e", 4, 8)], "contig string, start_pos long, end_pos long")
    got = sorted((r["contig"], r["tile_start"], r["tile_end"]) for r in tile(df, 4).collect())
    assert got == [("a", 0, 4), ("a", 4, 5), ("e", 4, 8)]
