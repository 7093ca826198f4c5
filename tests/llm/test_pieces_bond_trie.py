"""Piece encoding, vertical vector scan and prefix trie against the library and brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as E
from chromatide.llm import bond, pieces, trie

SMALL = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(MODEL)


def _encode(model, texts, end_id=None):
    flat, sizes = pieces.TextEncoder(model).encode(texts, end_id)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []


@given(st.lists(st.text(st.sampled_from(list("abcdeth in▁\n\té漢字😀\x00́<s>0x0A.,'ÀABZ‍٣")), max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_encode_as_the_library(library, model, texts):
    want = [[*ids, 2] for ids in library.encode(texts, num_threads=1)] if texts else []
    assert _encode(model, texts, 2) == want
    flat, sizes = pieces.TextEncoder(model).encode(texts, 2)
    assert model.decode(flat, sizes) == [library.decode(ids) for ids in want]


@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 13, 197, 172, 230, 31, 162, 259, 28705, 28708, 31999, 264]), max_size=9), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_decode_any_ids_as_the_library(library, model, lists):
    flat = np.array([i for x in lists for i in x], np.int32)
    assert model.decode(flat, np.array([len(x) for x in lists])) == [library.decode(x) for x in lists]


def test_long_words_and_slices(library, model, monkeypatch):
    rng = random.Random(3)
    texts = [" " * n for n in (1, 2, 3, 17, 33, 1000)] + ["a" * 3000, "".join(rng.choice("abcdefghij") for _ in range(5000)), "x " * 4000 + " " * 50 + "y"]
    want = library.encode(texts, num_threads=1)
    assert _encode(model, texts) == want
    monkeypatch.setattr(pieces, "SLICE_CHARS", 64)
    monkeypatch.setattr(pieces, "SLICE_IDS", 50)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 500)
    assert _encode(model, texts) == want
    flat, sizes = pieces.TextEncoder(model).encode(texts)
    assert model.decode(flat, sizes) == texts


@given(st.text("abcd", min_size=1, max_size=14), st.permutations(["ab", "bc", "cd", "abc", "bcd", "abcd", "ca", "cab", "aa", "aaa", "da"]), st.booleans())
@settings(max_examples=300, deadline=None)
def test_merge_order_of_any_vocabulary(text, order, ties):
    """Also vocabularies in which a longer piece comes before its parts, and pieces of equal scores."""
    names = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), *"abcd", *order]
    kinds = [2, *[6] * 256, *[1] * (4 + len(order))]
    scores = [0.0, *[0.0] * 256, *[-100.0] * 4, *(-float(k // 3 if ties else k) for k in range(len(order)))]
    m = pieces.PieceModel.of(names, scores, kinds, dummy_prefix=False)
    score = dict(zip(names, scores))
    symbols = list(text)
    while True:
        pairs = [(-score[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in score]
        if not pairs:
            break
        k = min(pairs)[1]
        symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
    assert _encode(m, [text, text + text]) [0] == [names.index(s) for s in symbols]


def test_other_models_are_refused(tmp_path):
    other = tmp_path / "m"
    other.write_bytes(b"\x0a\x03\x0a\x01a")
    with pytest.raises(ValueError):
        pieces.PieceModel(str(other))


def test_encode_frame(spark, library):
    texts = ["the quick fox", None, "", "the quick fox", "é\n" * 30, " "]
    df = spark.createDataFrame([(i, t, "x", [1.5]) for i, t in enumerate(texts)] + [(None, "a", None, None)], "doc_id long, text string, IDS string, decoded array<double>")
    got = pieces.decode_ids(pieces.encode_texts(df, MODEL), MODEL).collect()
    assert [r["ids"] for r in got] == [library.encode(t or "") + [2] for t in [*texts, "a"]]
    assert [r["decoded"] for r in got] == [*[t or "" for t in texts], "a"]
    assert pieces.encode_texts(df, MODEL).columns == ["doc_id", "text", "decoded", "ids"]
    assert pieces.encode_texts(df.limit(0), MODEL).count() == 0
    lists = spark.createDataFrame([(None,), ([],), ([2],), ([28705, 13],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode_ids(lists, MODEL).collect()] == [None, "", "", library.decode([28705, 13])]


def test_op11(spark, library):
    got = {r["doc_id"]: r for r in E.queries()["op11_piece_rounds"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "") + [2]
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# ---- vertical scan --------------------------------------------------------------

def _negatives(rows, every, positives=5, negatives=10):
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in rows if i % every == 0}
    for a, label, vec in anchors:
        scored = [(-sum(x * y for x, y in zip(vec, v)), i, other) for i, other, v in rows if i != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(a, pid, k, i, -p, -s) for k, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_negatives_against_brute_force(spark, seed):
    rng = random.Random(seed)
    dims = rng.choice([1, 9, 20])
    rows = [(i, rng.randrange(3), [rng.randrange(-4, 9) for _ in range(dims)]) for i in range(150)]
    rows += rows[:20] + [(200, 0, [5] * (dims // 2)), (201, 1, []), (202, 7, [3] * dims), (300, 2, [10**8] * dims)]
    df = spark.createDataFrame(rows, "id long, label long, q array<long>")
    got = bond.hard_negatives(df, F.col("id") % 10 == 0, block_rows=40, block_anchors=5)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == _negatives(rows, 10)


def test_scan_clears_rows_early():
    rng = np.random.default_rng(0)
    q = np.floor(rng.normal(0, 20, (400, 64)) * np.linspace(3, 0.1, 64)).astype(np.int64)
    block = bond.Block({"ids": np.arange(400).tobytes(), "labels": np.zeros(400, np.int64).tobytes(), "kind": "i8", "dims": np.ascontiguousarray(q.T).tobytes()})
    block.ready(q)
    scan = bond._steps(block, q[0], np.arange(400))
    rows, score, least, most = next(scan)
    left = []
    while least != most:
        top = np.partition(score, len(score) - 5)[len(score) - 5] + least
        rows, score, least, most = scan.send(score + most >= top)
        left.append(len(rows))
    assert left[-1] < 100 and set(np.argsort(-(q @ q[0]), kind="stable")[:5]) <= set(rows.tolist())


def test_quantized(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, -0.001], 3, "z"), (2, None, 3, "z"), (3, [None, 1.0], 3, "z"), (4, [nan, 1.0], 3, "z"), (5, [1.0, -inf], 3, "z"), (6, [1.0], None, "z"), (None, [1.0], 1, "z"), (7, [], 1, None), (1, [0.5, -0.001], 3, "z")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, q string")
    got = sorted(tuple(r) for r in bond.quantized(df, "vec_id", "embedding", F.col("label")).collect())
    assert got == [(1, 3, [128, -1]), (1, 3, [128, -1]), (7, 1, [])]
    empty = bond.quantized(df.limit(0), "vec_id", "embedding", F.col("label"))
    assert bond.hard_negatives(empty, F.col("id") % 100 == 0).count() == 0
    no_anchor = bond.quantized(df, "vec_id", "embedding", F.col("label"))
    assert bond.hard_negatives(no_anchor, F.lit(False)).count() == 0


# ---- prefix trie ------------------------------------------------------------------

def _forest(rng, n):
    bits, depth = [], 0
    while len(bits) < n or depth:
        up = len(bits) < n and (depth == 0 or rng.random() < 0.52)
        bits.append(up)
        depth += 1 if up else -1
    return np.array(bits, bool)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 500, 5000])
def test_findclose(n):
    bits = _forest(random.Random(n), n)
    want, stack = {}, []
    for k, up in enumerate(bits):
        if up:
            stack.append(k)
        else:
            want[stack.pop()] = k
    tree = trie.Parentheses(bits)
    got = tree.findclose(tree.opens)
    assert dict(zip(tree.opens.tolist(), got.tolist())) == want


def test_findclose_of_a_deep_path():
    n = 20_000
    tree = trie.Parentheses(np.repeat([True, False], n))
    assert (tree.findclose(tree.opens) == np.arange(2 * n - 1, n - 1, -1)).all()


def _trie(turns):
    """Nodes of the rebuilt conversations, by path."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{role or ''}\0{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + x[h:]
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        under = [p for p in members if p[:len(path)] == path]
        words = {p: len(p[-1][1].split()) if p else 0 for p in under}
        ends = ",".join(map(str, sorted(c for c in ids if len(built[c]) == len(path))))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), sum(len(p) == len(path) + 1 for p in under),
                    sum(not any(q[:len(p)] == p and len(q) > len(p) for q in under) for p in under),
                    sum((len(members[p]) - 1) * words[p] for p in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _turns(seed):
    rng = random.Random(seed)
    out = []
    for c in range(0, 90):
        same = rng.random() < 0.5
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            out.append((c, t, "user" if t % 2 == 0 else None, "a b" if same else f"{rng.choice('pqr')} word {rng.randrange(2)}"))
    out += [(7, 2, "user", "again"), (7, 2, "user", "again"), (7, None, None, None), (None, 1, "user", "x"), (13, 1, "", "")]
    out += [(400, t, "user", f"long {t}") for t in range(150)] + [(420, t, "user", f"long {t}") for t in range(150)]
    return out


@pytest.mark.parametrize("spine_rows,shard_rows", [(1, 10), (12, 40), (100_000, 100_000)])
def test_trie_against_brute_force(spark, spine_rows, shard_rows, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    turns = _turns(1)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(0))
    rows = trie.shared_openings(trie.numbered_turns(df))
    got = trie.prefix_trie(rows, spine_rows=spine_rows, shard_rows=shard_rows)
    assert got.columns == trie.NODE
    assert sorted((tuple(r) for r in got.collect()), key=str) == _trie(turns)


def test_trie_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.shared_openings(trie.numbered_turns(df))).count() == 0


def test_batches_given_back_in_parts(monkeypatch):
    """A worker holds ids and texts of a bounded number of rows; sliced lists are decoded as whole ones."""
    monkeypatch.setattr(pieces, "ROWS_OUT", 10)
    texts = [None if i % 7 == 3 else "" if i % 5 == 1 else f"row {i} é" * (i % 4) for i in range(34)]

    class Table:
        def __init__(self, *fields):
            self.schema, self.columns = T.StructType([T.StructField(n, k) for n, k in fields]), [n for n, _ in fields]

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    encoded = list(pieces.encode_texts(Table(("text", T.StringType())), MODEL)(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in encoded] == [10, 10, 10, 4]
    whole = pa.Table.from_batches(encoded).combine_chunks().to_batches()[0]
    decode = pieces.decode_ids(Table(("text", T.StringType()), ("ids", T.ArrayType(T.IntegerType()))), MODEL)
    decoded = list(decode(iter([whole])))
    assert [b.num_rows for b in decoded] == [10, 10, 10, 4]
    assert [x for b in decoded for x in b.column(2).to_pylist()] == [t or "" for t in texts]
