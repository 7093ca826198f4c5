"""Letters, numbers and token pairs counted in Arrow batches, against plain Python."""

import random
from collections import Counter
from itertools import zip_longest

from pyspark.sql import functions as F

from chromatide.functions import letters as L
from chromatide.operators import evaluate as EV
from chromatide.operators import examples as X
from chromatide.operators import sequences as Q
from chromatide.plans.fixtures import BASES, LETTERS, Inputs

TEXTS = ["", None, "The quick\nbrown Fox", "ACGTN acgtn 123", "café 中文 \U0001f600x", "é" * 5, "Z"]


def test_letters_are_replaced_as_translate_and_regexp_replace_do(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id int, text string").repartition(2)
    old = F.regexp_replace(F.translate("text", LETTERS, BASES), "[^ACGT]", "N")
    got = df.select(L.replaced("text", LETTERS, BASES, "N").alias("a"), old.alias("b"),
                    L.replaced("text", "aeiourst", "ACGTacgt").alias("c"), F.translate("text", "aeiourst", "ACGTacgt").alias("d")).collect()
    assert len(got) == 21 and all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)


def test_numbers_of_letters_and_their_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    ids = {None: None} | {t: [{"A": 7, "C": 8, "G": 9, "T": 10, "N": 11}.get(c, 6) for c in t] for t in TEXTS if t is not None}
    for r in df.select("s", Q.char_ids("s").alias("ids"), L.number_text(Q.char_ids("s")).alias("text")).collect():
        assert r["ids"] == ids[r["s"]]
        assert r["text"] == (None if r["s"] is None else ",".join(map(str, ids[r["s"]])))
    w = spark.createDataFrame([(c, i, t) for c in range(3) for i, t in enumerate(TEXTS)], "cell int, rank int, window string")
    for eos in (True, False):
        st = X.stack_windows(w, "cell", eos=eos)
        want = [[0, *ids[t], *([1] if eos else [])] for t in TEXTS if t is not None]
        for r in st.select("input_ids_of_seqs", L.number_lists_text("input_ids_of_seqs").alias("t")).collect():
            assert r[0] == want and r["t"] == "|".join(",".join(map(str, x)) for x in want)
    mixed = spark.createDataFrame([([1, None, 3],), ([],), (None,), ([-5],)], "a array<bigint>")
    assert [r[0] for r in mixed.select(L.number_text("a")).collect()] == ["1,3", "", None, "-5"]


def test_chunks_of_any_letters(spark):
    rnd = random.Random(3)
    seqs = ["".join(rnd.choice(abc) for _ in range(n)) for abc in ("ACGT", "ACé中") for n in (0, 1, 7, 8, 9, 64, 100)]
    df = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(seqs)] + [("none", None)], "contig string, seq string")
    got = {(r["contig"], r["chunk_id"]): r["seq"] for r in Q.chunk_contigs(df, 8).collect()}
    assert got == {(f"c{i}", j // 8): s[j:j + 8] for i, s in enumerate(seqs) for j in range(0, len(s), 8)}


def test_token_pairs_are_counted_inside_rows(spark):
    rnd = random.Random(5)
    rows = [(f"s{i % 30}" if i else None, [-100] * 2 + [rnd.choice(a) for _ in range(n)], [0] * 2 + [rnd.choice(a) for _ in range(n + m)])
            for i, (a, n, m) in enumerate((a, n, m) for a in ([7, 8, 9], [1, 10**6, -4]) for n in (1, 2, 3, 40, 300) for m in (0, 0, 3, -2) if n + m >= 0)]
    df = spark.createDataFrame(rows, "sample string, labels array<int>, preds array<int>")
    want = Counter()
    for s, y, p in rows:
        want.update((s, a, b) for a, b in zip_longest(y[2:-1], p[1:len(y) - 2]))
    counts = EV.token_pair_counts(df, "sample")
    assert {(r["sample"], r["y"], r["p"]): r["c"] for r in counts.collect()} == dict(want)
    tp = EV.token_pairs(df, "sample")
    key = lambda r: str([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r])
    assert sorted(map(key, EV.token_correlations(df, "sample").collect())) == sorted(map(key, EV.correlations(tp, "sample").collect()))
    assert sorted(map(key, EV.token_macro(df, "sample").collect())) == sorted(map(key, EV.macro_metrics(tp, "y", "p", ["sample"]).collect()))


def test_contigs_are_lettered_in_batches_and_once(spark):
    plan = Q.chunk_contigs(Inputs(spark, "/root/testdata/sf0.001").contigs, 64)._jdf.queryExecution().executedPlan().toString()
    assert "translate(" not in plan and "regexp_replace(" not in plan and plan.count("look_up(") <= 2 and "ArrowEvalPython" in plan


def test_bytes_of_features_beyond_unicode(spark):
    """As the text of ``symbols`` up to its last feature, and bytes of their own for those beyond."""
    from chromatide.operators.sentences import symbol_bytes, symbols
    rng = random.Random(5)
    lists = [[rng.choice([0, 7, 35_000, 35_329, 60_000, 1_092_095, rng.randrange(1_092_096)]) for _ in range(rng.randrange(6))] for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "i int, t array<long>").repartition(3)
    assert df.select((symbol_bytes("t") == F.encode(symbols("t"), "UTF-8")).alias("same")).distinct().collect() == [(True,)]
    far = [1_092_095, 1_092_096, 2_075_135, 2_075_136, 67_000_000, 68_000_000, 1 << 31, 1 << 35, 1 << 40, (1 << 40) + 1]
    rows = [(i, [f, None, f]) for i, f in enumerate(far)] + [(100, None), (101, [])]
    got = dict(spark.createDataFrame(rows, "i int, t array<long>").repartition(2).select("i", symbol_bytes("t")).collect())
    assert got[100] is None and got[101] == b""
    assert len({bytes(got[i]) for i in range(len(far))}) == len(far)
    assert [len(got[i]) for i in range(len(far))] == [8, 8, 8, 10, 10, 12, 14, 14, 26, 26]


def test_compression_distance_of_features_beyond_unicode(spark):
    from chromatide.functions import strdist
    from chromatide.operators import distance as D
    from chromatide.operators.sentences import symbol_bytes
    rows = [(1, [5, 9_000_000]), (2, [9_000_000, 9_000_001, 9_000_001]), (3, [])]
    coded = spark.createDataFrame(rows, "cell long, t array<long>").select("cell", symbol_bytes("t").alias("s"))
    text = dict(coded.collect())
    got = {(r["i"], r["j"]): r["dist"] for r in D.distance_matrix(coded, "cell", "s", "zlib_ncd", 2).collect()}
    assert got == {(i, j): strdist.zlib_ncd_row(bytes(text[i]), [bytes(text[j])], [strdist.compressed(bytes(text[j]))])[0] for i in text for j in text}


def test_batches_are_worked_on_in_parts(monkeypatch):
    import hashlib
    import tracemalloc

    import pyarrow as pa
    rnd = random.Random(8)
    texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("ACé中\U0001f600") for _ in range(rnd.choice([0, 0, 1, 3, 40]))) for _ in range(200)]
    lists = [None if t is None else [ord(c) % 12 for c in t] for t in texts]
    nested = [None if i % 7 == 3 else [x or [] for x in lists[i:i + i % 4]] for i in range(200)]
    for part in (1, 7, 1 << 20):
        monkeypatch.setattr(L, "PART", part)
        data, places = L._characters(pa.array(texts, pa.string())[3:])
        first = [[c.encode()[0] for c in t or ""] for t in texts[3:]]
        assert [data[a:b].tolist() for a, b in zip(places, places[1:])] == first
        numbers = pa.array(lists, pa.list_(pa.int32()))[3:]
        assert L._in_parts(numbers, L._places(numbers), lambda p: L._joined(p, ",")).to_pylist() == [None if x is None else ",".join(map(str, x)) for x in lists[3:]]
        groups = pa.array(nested, pa.list_(pa.list_(pa.int32())))
        want = [None if g is None else "|".join(",".join(map(str, x)) for x in g) for g in nested]
        assert L._in_parts(groups, L._places(groups.flatten())[L._places(groups)], L._lists_text).to_pylist() == want
        assert L.number_lists_md5(groups).to_pylist() == [None if t is None else hashlib.md5(t.encode()).hexdigest() for t in want]
    long = pa.array(["ACGTé" * 1000] * 800)
    tracemalloc.start()
    L._characters(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6        # 4.8 MB of text; an eight-byte place for each byte, twice, would be 77 MB


def test_token_lists_of_few_cells_are_held_at_once(spark):
    import pyarrow as pa
    from pyspark.sql import types as T
    w = spark.range(40).selectExpr("id AS cell", "1 AS rank", "repeat('ACGT', 50000) AS window").coalesce(1)
    held = (lambda groups: pa.array([len(groups)] * len(groups), pa.int64()), T.LongType())
    got = X.stack_windows(w, "cell", then=held).coalesce(1).collect()
    assert len(got) == 40 and {r["n_seqs"] for r in got} == {1} and max(r["input_ids_of_seqs"] for r in got) <= 8
