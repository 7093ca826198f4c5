"""Truncated SVD of a sparse matrix by randomised subspace iteration over blocks.

The matrix lies in written blocks by (cell block, feature block); tall panels,
one for each block of cells, hold as many columns as components are sought and a
few more. A step is one pass: all blocks of some features meet the panels of
their cells in one task, which multiplies by the matrix's transpose and at once
by the matrix again, so the long side's panels are never written or sent. The
parts of a cell block are summed. Panels are made orthonormal by QR factors that
are reduced in a tree, so the driver holds square matrices of the panels' width
only, whatever the matrix's size. There is one path for all sizes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatide.operators.common import materialize

CELLS, FEATURES = 4096, 65_536   # rows of a panel of cells, features of a task
LEAST = 4096                     # features of a task where there are fewer tasks than cores
FAN = 16                         # factors stacked at once in the tree of QR factors
PANEL = "block int, ids binary, panel binary"


def _blocked(values: DataFrame, cells: int, features: int) -> DataFrame:
    """Matrix blocks: the ids of their rows and columns, and the entries by place among these."""
    n = values.agg(F.countDistinct("cell"), F.countDistinct("feature")).first()
    cores = values.sparkSession.sparkContext.defaultParallelism
    nc, nf = max(1, -(-n[0] // cells)), max(1, -(-n[1] // features), min(cores, -(-n[1] // LEAST)))
    dealt = values.select("*", F.pmod(F.xxhash64("cell"), F.lit(nc)).cast("int").alias("cb"), F.pmod(F.xxhash64("feature"), F.lit(nf)).cast("int").alias("fb"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(part["cell"].to_numpy(np.int64), return_inverse=True)
        cols, c = np.unique(part["feature"].to_numpy(np.int64), return_inverse=True)
        return pd.DataFrame([(part["cb"].iat[0], part["fb"].iat[0], rows.tobytes(), cols.tobytes(), r.astype(np.int32).tobytes(),
                              c.astype(np.int32).tobytes(), part["x"].to_numpy(float).tobytes())], columns=["cb", "fb", "rows", "cols", "r", "c", "x"])

    return materialize(dealt.groupBy("cb", "fb").applyInPandas(pack, "cb int, fb int, rows binary, cols binary, r binary, c binary, x binary"))


def _open(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["panel"]).reshape(len(ids), -1)


def _feature_blocks(batches: Iterator[pd.DataFrame], start) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """(number, feature ids, their panel, matrix blocks) of each feature block of a partition sorted by (fb, cb, side).

    The panel is the matrix's transpose times the panels of the cells, or what the
    function ``start`` makes of the ids. One panel of cells is held at a time.
    """
    number, ids, z, blocks, cells = None, None, None, [], None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.fb != number:
                if number is not None:
                    yield number, ids, z if start is None else start(ids), blocks
                number, ids, z, blocks = row.fb, np.zeros(0, np.int64), None, []
            if row.panel is not None:
                cells = np.frombuffer(row.ids, np.int64), np.frombuffer(row.panel).reshape(len(row.ids) // 8, -1)
                continue
            rows, cols, r, c, x = np.frombuffer(row.rows, np.int64), np.frombuffer(row.cols, np.int64), np.frombuffer(row.r, np.int32), np.frombuffer(row.c, np.int32), np.frombuffer(row.x)
            blocks.append((row.cb, rows, cols, r, c, x))
            every = np.union1d(ids, cols)
            if start is None:
                y = cells[1][np.searchsorted(cells[0], rows)]
                total = np.zeros((len(every), y.shape[1]))
                if z is not None:
                    total[np.searchsorted(every, ids)] = z
                z, at = total, np.searchsorted(every, cols)
                for k in range(y.shape[1]):
                    z[at, k] += np.bincount(c, x * y[r, k], len(cols))
            ids = every
    if number is not None:
        yield number, ids, z if start is None else start(ids), blocks


def _by_features(matrix: DataFrame, panels: DataFrame | None) -> DataFrame:
    """Each feature block's matrix blocks and, before each of them, the panel of its cells, in order in one partition."""
    blocks = matrix.select("fb", "cb", F.lit(1).alias("side"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("panel"), "rows", "cols", "r", "c", "x")
    if panels is not None:
        empty = [F.lit(None).cast("binary").alias(c) for c in ("rows", "cols", "r", "c", "x")]
        sent = matrix.select("cb", "fb").join(panels.withColumnRenamed("block", "cb"), "cb")
        blocks = blocks.unionByName(sent.select("fb", "cb", F.lit(0).alias("side"), "ids", "panel", *empty))
    return blocks.repartition("fb").sortWithinPartitions("fb", "cb", "side")


def _pass(matrix: DataFrame, panels: DataFrame | None, weights: np.ndarray | None, width: int, seed: int) -> DataFrame:
    """Panels of the matrix times its transpose times ``panels`` times ``weights``; in blocks below 0 the QR factors of the inner product.

    Without ``panels``, of the matrix times normal numbers for every feature, seeded by its id.
    """
    def draw(ids: np.ndarray) -> np.ndarray:
        return np.stack([np.random.default_rng([seed, int(i) & (2**63 - 1)]).normal(size=width) for i in ids])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, _ids, z, blocks in _feature_blocks(batches, draw if weights is None else None):
            z = z if weights is None else z @ weights
            yield pd.DataFrame([(-1 - number // 256, b"", np.linalg.qr(z, mode="r").tobytes())], columns=["block", "ids", "panel"])
            for cb, rows, cols, r, c, x in blocks:
                y = z[np.searchsorted(_ids, cols)]
                out = np.stack([np.bincount(r, x * y[c, k], len(rows)) for k in range(y.shape[1])], axis=1)
                yield pd.DataFrame([(cb, rows.tobytes(), out.tobytes())], columns=["block", "ids", "panel"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        block, across = parts["block"].iat[0], width if weights is None else weights.shape[1]
        if block < 0:
            stacked = np.concatenate([np.frombuffer(p).reshape(-1, across) for p in parts["panel"]])
            return pd.DataFrame([(block, b"", np.linalg.qr(stacked, mode="r").tobytes())], columns=["block", "ids", "panel"])
        ids = np.unique(np.concatenate([np.frombuffer(i, np.int64) for i in parts["ids"]]))
        total = np.zeros((len(ids), across))
        for i, z in zip(parts["ids"], parts["panel"]):
            total[np.searchsorted(ids, np.frombuffer(i, np.int64))] += np.frombuffer(z).reshape(-1, across)
        return pd.DataFrame([(block, ids.tobytes(), total.tobytes())], columns=["block", "ids", "panel"])

    parts = _by_features(matrix, panels).mapInPandas(multiply, PANEL)
    return materialize(parts.groupBy("block").applyInPandas(add, PANEL))


def _let_go(spark) -> None:
    """Shuffle files of past steps go when the driver collects its garbage; else they would stay for the whole run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def triangle(panels: DataFrame) -> np.ndarray:
    """R of the QR factors of all panels stacked, reduced ``FAN`` factors at a time."""
    def factor(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"block": part["block"], "r": [np.linalg.qr(_open(p)[1], mode="r").tobytes() for _, p in part.iterrows()]})

    factors = panels.mapInPandas(factor, "block int, r binary")
    width = None

    def stack(blobs) -> np.ndarray:
        return np.linalg.qr(np.concatenate([np.frombuffer(b).reshape(-1, width) for b in blobs]), mode="r")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(part["block"].iat[0], stack(part.sort_values("from")["r"]).tobytes())], columns=["block", "r"])

    first = panels.select(F.octet_length("panel"), F.octet_length("ids")).first()
    width = first[0] // first[1]
    left = panels.agg(F.max("block")).first()[0] + 1
    while left > FAN:
        factors = factors.select(F.floor(F.col("block") / FAN).cast("int").alias("block"), F.col("block").alias("from"), "r")
        factors = materialize(factors.groupBy("block").applyInPandas(merge, "block int, r binary"))
        left = -(-left // FAN)
    return stack([r["r"] for r in factors.orderBy("block").collect()])


def _inverse(r: np.ndarray) -> np.ndarray:
    """Turns panels with the factor ``r`` into orthonormal ones; directions without weight are left out."""
    u, s, vt = np.linalg.svd(r, full_matrices=False)
    keep = s > 1e-12 * max(s[0], 1e-300)
    return vt[keep].T / s[keep]


def truncated_svd(values: DataFrame, k: int, cell: str = "cell", feature: str = "feature_idx", value: str = "tfidf", oversample: int | None = None,
                  tolerance: float = 1e-6, most_steps: int = 30, seed: int = 42, cells: int = CELLS, features: int = FEATURES) -> DataFrame:
    """(cell, component, value) with value = (U S)[cell, component], components from 1 by falling singular value.

    Steps end when no singular value sought changes by more than ``tolerance``
    of itself, or after ``most_steps``.  A component's sign makes its feature
    loading of the greatest size positive (ties: smallest feature).  Null values
    and zeros are no entries; no entries give no rows.  Ids are integers.
    """
    width = k + (max(10, k) if oversample is None else oversample)
    x = F.col(value).cast("double")
    matrix = _blocked(values.where(F.col(cell).isNotNull() & F.col(feature).isNotNull() & (x != 0)).select(
        F.col(cell).cast("long").alias("cell"), F.col(feature).cast("long").alias("feature"), x.alias("x")), cells, features)
    if matrix.isEmpty():
        return matrix.select(F.col("cb").cast("long").alias("cell"), F.col("fb").alias("component"), F.lit(0.0).alias("value"))
    y, before, weights = _pass(matrix, None, None, width, seed), None, np.eye(width)
    for step in range(most_steps):
        panels = y.where("block >= 0")
        turned = weights @ _inverse(np.linalg.qr(triangle(panels) @ weights, mode="r"))
        ahead = _pass(matrix, panels, turned, width, seed)
        factors = [np.frombuffer(f["panel"]).reshape(-1, turned.shape[1]) for f in ahead.where("block < 0").orderBy("block").collect()]  # one for 256 feature blocks
        r = np.linalg.qr(np.concatenate(factors), mode="r")
        u, s, vt = np.linalg.svd(r, full_matrices=False)
        now = s[:k]
        if before is not None and len(before) == len(now) and (np.abs(now - before) <= tolerance * np.maximum(now, 1e-12 * s[0])).all():
            break
        if step + 1 < most_steps:
            before, weights, y = now, _inverse(r), ahead
            _let_go(values.sparkSession)
    keep = min(k, int((s > 1e-12 * s[0]).sum()))
    vs, s = vt[:keep].T, s[:keep]

    def loads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, ids, z, _ in _feature_blocks(batches, None):
            v = z @ turned @ vs
            top = np.abs(v).argmax(axis=0)
            yield pd.DataFrame({"component": np.arange(keep), "size": np.abs(v).max(axis=0), "feature": ids[top], "up": v[top, np.arange(keep)] >= 0})

    largest = _by_features(matrix, panels).mapInPandas(loads, "component int, size double, feature long, up boolean").groupBy("component").agg(
        F.max_by("up", F.struct("size", -F.col("feature"))).alias("up"))
    signs = np.ones(keep)
    for row in largest.collect():                        # one row for each component
        signs[row["component"]] = 1.0 if row["up"] else -1.0
    turn = turned @ vs * (s * signs)

    def scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, p in part.iterrows():
                ids, panel = _open(p)
                yield pd.DataFrame({"cell": np.repeat(ids, keep), "component": np.tile(np.arange(1, keep + 1), len(ids)), "value": (panel @ turn).ravel()})

    return panels.mapInPandas(scores, "cell long, component int, value double")
