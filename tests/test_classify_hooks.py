"""The fitted classifier against numpy, the batched hook on nulls, empty tables and clashing names."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chromatide.operators import classify as K
from chromatide.operators.hooks import map_batches

SCHEMA = "id long, y string, v array<double>, _j int"


def _numpy_fit(x, y, n_classes, l2):
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros((n_classes, x.shape[1] + 1))
    step = 1 / (np.linalg.eigvalsh(x.T @ x / (2 * len(x))).max() + l2)
    for _ in range(60_000):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p.T @ x / len(x) + l2 * w
        if np.abs(g).max() < 1e-9:
            break
        w -= step * g
    return w


def test_softmax_fit_equals_numpy(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 4))
    y = rng.integers(0, 3, 120)
    x = centres[y] + rng.normal(size=(120, 4))
    rows = [(i, "abc"[c], [float(a) for a in v], i) for i, (c, v) in enumerate(zip(y, x))]
    odd = [(200, None, [1.0] * 4, 0), (201, "a", None, 0), (202, "a", [], 0), (203, "b", [1.0, 2.0], 0),
           (204, "c", [1.0, None, 2.0, 3.0], 0), (205, "c", [1.0, float("nan"), 2.0, 3.0], 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    model = K.fit_softmax(df, "y", "v", l2=0.01, tol=1e-7)
    assert model.classes == ["a", "b", "c"] and len(model.losses) < 60
    assert np.allclose(model.weights, _numpy_fit(x, y, 3, 0.01), atol=1e-5)
    assert all(b <= a for a, b in zip(model.losses, model.losses[1:]))
    got = {r["id"]: r for r in K.score_softmax(df, model, "v").collect()}
    z = np.hstack([x, np.ones((120, 1))]) @ model.weights.T
    assert [got[i]["pred"] for i in range(120)] == ["abc"[c] for c in z.argmax(axis=1)]
    assert all(got[i]["_j"] == i for i in range(120))
    assert got[200]["pred"] is not None
    assert all(got[i]["pred"] is None and got[i]["p_max"] is None for i in range(201, 206))


def test_softmax_of_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = K.fit_softmax(none, "y", "v")
    assert model.classes == []
    one = spark.createDataFrame([(1, "a", [1.0, 2.0], 0)] * 3, SCHEMA)
    assert [tuple(r) for r in K.score_softmax(one, model, "v").select("pred", "p_max").collect()] == [(None, None)] * 3
    single = K.fit_softmax(one, "y", "v")
    assert [r["pred"] for r in K.score_softmax(one, single, "v").collect()] == ["a"] * 3


def test_hook_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 9), (2**60, 5, None, None), (3, 7, "", 8)], "a long, b long, N string, n long").drop("n")

    def fn(batch):
        assert list(batch.columns) == ["b", "a"]
        return pd.DataFrame({"n": batch["b"] + 1, "twice": batch["a"].map(lambda v: [v, v])})
    got = map_batches(df, fn, ["b", "a"], "n long, twice array<long>")
    assert got.columns == ["a", "b", "n", "twice"]
    assert sorted(map(tuple, got.collect())) == [(1, None, None, [1, 1]), (3, 7, 8, [3, 3]), (2**60, 5, 6, [2**60, 2**60])]
    assert map_batches(df.limit(0), fn, ["b", "a"], "n long, twice array<long>").count() == 0


def test_hook_rows_and_errors(spark):
    df = spark.range(10).coalesce(1)
    even = map_batches(df, lambda b: b[b["id"] % 2 == 0], ["id"], "id long", keep=False)
    assert sorted(r["id"] for r in even.collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError):
        map_batches(df, lambda b: b, ["other"], "id long")
    with pytest.raises(ValueError):
        map_batches(df, lambda b: b, ["id"], "x long, X long")
    for bad in (lambda b: b[:3], lambda b: b.rename(columns={"id": "z"}), lambda b: b.assign(id="text")):
        with pytest.raises(Exception):  # noqa: B017
            map_batches(df, bad, ["id"], "id long").agg(F.sum("id")).collect()
