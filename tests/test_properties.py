"""Properties and brute-force comparisons on random inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from chromatide.operators import common as C
from chromatide.operators import distance as D
from chromatide.operators import evaluate as EV
from chromatide.operators import examples as X
from chromatide.operators import regions as R
from chromatide.operators import sampling as Z
from chromatide.operators import sequences as Q


def test_revcomp_twice_is_identity(spark):
    df = spark.createDataFrame([("ACGTacgtN*xyz",), ("",)], "s string")
    assert [r[0] for r in df.select(Q.revcomp(Q.revcomp(F.col("s")))).collect()] == ["ACGTacgtN*xyz", ""]


def test_tokenise_detokenise_identity(spark):
    df = spark.createDataFrame([("ACGTNNAC",)], "s string")
    assert df.select(Q.detokenize(Q.char_ids("s"))).first()[0] == "ACGTNNAC"


def test_global_position_dense_and_ordered(spark):
    rnd = random.Random(5)
    vals = [(rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(vals, "k long, id long").repartition(7)
    got = C.global_position(df, [F.col("k"), F.col("id")], "pos").toPandas().sort_values("pos")
    assert list(got["pos"]) == list(range(1, 3001))
    assert list(zip(got["k"], got["id"])) == sorted(vals)


def test_running_sum_matches_pandas(spark):
    rnd = random.Random(6)
    vals = [(rnd.choice(["a"] * 8 + ["b", "c"]), i, rnd.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(vals, "g string, o long, v long").repartition(5)
    got = {(r["g"], r["o"]): r["cs"] for r in C.running_sum(df, ["g"], "o", "v", "cs").collect()}
    acc = {}
    for g, o, v in sorted(vals, key=lambda x: (x[0], x[1])):
        acc[g] = acc.get(g, 0) + v
        assert got[(g, o)] == acc[g]


def _brute_merge(iv, gap):
    out = {}
    for c in sorted({x[0] for x in iv}):
        cur = None
        for _, s, e in sorted(x for x in iv if x[0] == c):
            if cur and s <= cur[1] + gap:
                cur[1] = max(cur[1], e)
            else:
                if cur:
                    out.setdefault(c, []).append(tuple(cur))
                cur = [s, e]
        out.setdefault(c, []).append(tuple(cur))
    return sorted((c, s, e) for c, v in out.items() for s, e in v)


def test_reduce_intervals_matches_brute_force(spark):
    rnd = random.Random(7)
    iv = []
    for _ in range(400):
        c = rnd.choice(["chr1", "chr2"])
        s = rnd.randrange(0, 5000)
        iv.append((c, s, s + rnd.choice([0, 3, 40, 300, 1200])))
    df = spark.createDataFrame(iv, "chrom string, start_pos long, end_pos long")
    got = sorted((r[0], r[1], r[2]) for r in R.reduce_intervals(df, []).collect())
    assert got == _brute_merge(iv, 1)


def test_one_interval_over_a_whole_chromosome(spark):
    """It swallows all others, across every partition; one behind it stays apart."""
    rnd = random.Random(3)
    iv = [("chr1", s, s + 5, f"g{s % 3}", s % 7) for s in (rnd.randrange(10, 100_000) for _ in range(2000))]
    iv += [("chr1", 0, 200_000, "all", 1), ("chr1", 200_002, 200_003, None, 9), ("chr2", 5, 6, "g1", None)]
    df = spark.createDataFrame(iv, "chrom string, start_pos long, end_pos long, g string, m long")
    out = R.reduce_intervals(df, [], group="g", max_of="m")
    got = {(r["chrom"], r["start_pos"], r["end_pos"]): (r["groups"], r["max_m"]) for r in out.collect()}
    assert got == {("chr1", 0, 200_000): (["all", "g0", "g1", "g2"], 6), ("chr1", 200_002, 200_003): ([], 9), ("chr2", 5, 6): (["g1"], None)}
    assert R.reduce_intervals(df.limit(0), []).count() == 0


def test_running_maximum(spark):
    from chromatide.operators.common import in_order, scan
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([None, rnd.randrange(1000)])) for k in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    for exclusive in (False, True):
        got = {(r["k"], r["i"]): r["top"] for r in scan(in_order(df, ["k"], "i"), ["k"], "i", "v", "top", F.max, exclusive).collect()}
        for k, i, _ in rows:
            before = [v for kk, j, v in rows if kk == k and v is not None and (j < i or (j == i and not exclusive))]
            assert got[k, i] == (max(before) if before else None)


def test_coverage_matches_brute_force(spark):
    rnd = random.Random(8)
    fr = [("chr1", s, s + rnd.randrange(1, 60)) for s in (rnd.randrange(0, 2000) for _ in range(300))]
    df = spark.createDataFrame(fr, "chrom string, start_pos long, end_pos long")
    seg = R.coverage_segments(df, [], bin_size=250).collect()
    depth = np.zeros(2100, int)
    for _, s, e in fr:
        depth[s:e] += 1
    got = np.zeros(2100, int)
    for r in seg:
        got[r["seg_start"]:r["seg_end"]] = r["cov"]
    assert (got == depth).all()
    peaks = R.call_peaks(df, [], 3, bin_size=250).collect()
    above = depth >= 3
    starts = [i for i in range(2100) if above[i] and (i == 0 or not above[i - 1])]
    assert sorted(r["peak_start"] for r in peaks) == starts


def test_blacklist_binned_equals_nested_loop(spark):
    rnd = random.Random(9)
    reg = [(i, "c", s, s + rnd.randrange(0, 500)) for i, s in enumerate(rnd.randrange(0, 20000) for _ in range(300))]
    bl = [("c", s, s + rnd.randrange(0, 200)) for s in (rnd.randrange(0, 20000) for _ in range(40))]
    a = spark.createDataFrame(reg, "rid long, chrom string, start_pos long, end_pos long")
    b = spark.createDataFrame(bl, "chrom string, start_pos long, end_pos long")
    got = sorted(r[0] for r in R.remove_blacklist(a, b, "rid", width=97).select("rid").collect())
    want = sorted(i for i, _, s, e in reg if not any(s <= be and bs <= e for _, bs, be in bl))
    assert got == want


def test_window_length_always_L(spark):
    rnd = random.Random(10)
    contigs = spark.createDataFrame([(f"chr{i}", "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 300))))
                                     for i in range(5)], "contig string, seq string")
    ch = Q.chunk_contigs(contigs, 64)
    reg = spark.createDataFrame([(i, f"chr{rnd.randrange(6)}", s, s + rnd.randrange(1, 200))
                                 for i, s in enumerate(rnd.randrange(-50, 400) for _ in range(200))],
                                "region_id long, contig string, start_pos long, end_pos long")
    for w in (Q.window_random(reg, ch, 100, 3, size=64), Q.window_fixed(reg.where("start_pos >= 0"), ch, 100, size=64)):
        assert {len(r["window"]) for r in w.collect()} == {100}


def test_splits_disjoint_complete(spark):
    df = spark.range(537).withColumnRenamed("id", "k")
    s = Z.split(df, "k", 0.7, 0.2, 0.1, 1).toPandas()
    assert len(s) == 537 and s["k"].is_unique and set(s["split"]) == {"train", "test", "valid"}


def test_confusion_sums_to_rows(spark):
    rnd = random.Random(11)
    p = spark.createDataFrame([(rnd.choice("abc"), rnd.choice("abcd")) for _ in range(500)], "gt string, pred string")
    c = EV.confusion(p)
    assert c.agg(F.sum("n")).first()[0] == 500 and c.count() == 16


def test_symmetric_distance_matrix(spark):
    rnd = random.Random(12)
    df = spark.createDataFrame([(i, "".join(rnd.choice("abcde") for _ in range(8))) for i in range(40)], "cell long, s string")
    for kind in ("levenshtein", "jaro", "jaro_winkler", "damerau_levenshtein"):
        m = {(r["i"], r["j"]): r["dist"] for r in D.distance_matrix(df, "cell", "s", kind, rows_per_block=7).collect()}
        assert len(m) == 1600 and all(m[(i, j)] == m[(j, i)] for i in range(40) for j in range(40))


def test_knn_vectors_exact(spark):
    rng = np.random.default_rng(13)
    x = rng.random((150, 5))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(150)], "id long, v array<double>")
    nn = D.nearest_vectors(df, "id", "v", 4, rows_per_block=20).collect()
    got = {}
    for r in nn:
        got.setdefault(r["i"], []).append((r["rank"], r["j"]))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(150):
        want = list(np.lexsort((np.arange(150), d[i]))[:4])
        assert [j for _, j in sorted(got[i])] == want


def test_unpad_repad_identity(spark):
    rnd = random.Random(14)
    df = spark.createDataFrame([(i, [rnd.randrange(7, 12) for _ in range(rnd.randrange(1, 30))]) for i in range(50)],
                               "rid long, ids array<bigint>")
    b = X.batches(df, "rid", 8)
    back = {r["rid"]: r["ids"] for r in X.repad(X.unpad(b, "ids", "rid"), "rid").collect()}
    mx = {}
    for r in b.collect():
        mx[r["batch"]] = max(mx.get(r["batch"], 0), len(r["ids"]))
    for r in b.collect():
        assert back[r["rid"]] == r["ids"] + [0] * (mx[r["batch"]] - len(r["ids"]))
