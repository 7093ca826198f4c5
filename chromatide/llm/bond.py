"""Hard negatives by a vertical scan over columnar vector blocks.

The vectors lie in written blocks, one array for each dimension. An anchor reads
a block's dimensions in the order of its own falling magnitudes, a few at a
time. What the dimensions not yet read can still add lies between sums of their
minima and maxima in the block; these bounds clear rows from the candidate
bitmap until the scores of the few that are left are exact. All rows and anchors
meet once, block by block: no pair of rows is ever shuffled, and a block pair
returns its best few rows for each anchor only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components in a block of rows or anchors, the most rows and anchors in one, and dimensions read between two prunings.
BLOCK_COMPONENTS, BLOCK_ROWS, BLOCK_ANCHORS, STEP = 1 << 22, 65_536, 16_384, 8
#: Tasks for each core at least, where the rows allow it.
TASKS_A_CORE = 4


def quantized(df: DataFrame, id_col: str, vec: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part; q is floor(scale * x) of every component.

    A null id, label or vector and any null or non-finite component leave a row out.
    """
    return (df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec).alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
            .where(F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
            .where(F.forall("v", lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
            .select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q")))


def _matrix(vectors: list) -> np.ndarray:
    """One row for each dimension; short vectors end in zeros."""
    dims = max(map(len, vectors), default=0)
    if all(len(v) == dims for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), dims).T
    out = np.zeros((dims, len(vectors)), np.int64)
    for k, v in enumerate(vectors):
        out[:len(v), k] = v
    return out


def _packed(matrix: np.ndarray) -> tuple[str, bytes]:
    most = int(np.abs(matrix).max()) if matrix.size else 0
    kind = next(k for k, top in (("i1", 127), ("i2", 32_767), ("i4", 2**31 - 1), ("i8", 2**63)) if most <= top)
    return kind, np.ascontiguousarray(matrix.astype(f"<{kind}")).tobytes()


def _pack_rows(part: pd.DataFrame) -> pd.DataFrame:
    """A block's rows as one row of columnar arrays, in the order of label and id."""
    part = part.sort_values(["label", "id"], kind="stable")
    kind, dims = _packed(_matrix(part["q"].tolist()))
    return pd.DataFrame([(part["block"].iat[0], part["id"].to_numpy(np.int64).tobytes(), part["label"].to_numpy(np.int64).tobytes(), kind, dims)],
                        columns=["block", "ids", "labels", "kind", "dims"])


class Block:
    """The columnar arrays of a block, its labels' ranges, and each dimension's least and greatest value."""

    def __init__(self, row: pd.Series):
        self.ids = np.frombuffer(row["ids"], np.int64)
        labels = np.frombuffer(row["labels"], np.int64)
        self.n = len(self.ids)
        dims = np.frombuffer(row["dims"], f"<{row['kind']}").reshape(-1, self.n)
        self.most = int(np.abs(dims.astype(np.int64)).max()) if dims.size else 0
        self.low, self.high = dims.min(axis=1).astype(np.int64), dims.max(axis=1).astype(np.int64)
        self.dims = dims
        names, first = np.unique(labels, return_index=True)
        self.of_label = {int(v): (int(a), int(b)) for v, a, b in zip(names, first, [*first[1:], self.n])}

    def ready(self, anchors: np.ndarray) -> type:
        """Sets the arrays' type: doubles while all sums are exact in them, else 64-bit integers."""
        most = int(np.abs(anchors).max()) if anchors.size else 0
        bound = max(1, len(self.dims)) * most * self.most
        if bound >= 2**62:
            raise OverflowError("scores of these vectors do not fit in 64 bits")
        kind = np.float64 if bound < 2**51 else np.int64
        if self.dims.dtype != kind:
            self.dims = self.dims.astype(kind)
        return kind


def _steps(block: Block, anchor: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(rows, partial scores, least rest, greatest rest) after every few dimensions; ``send`` the mask of rows to keep."""
    size = min(len(anchor), len(block.dims))
    anchor = anchor[:size]
    order = np.argsort(-np.abs(anchor), kind="stable")
    a, b = anchor[order] * block.low[order], anchor[order] * block.high[order]
    least = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], 0)
    most = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], 0)
    weights = anchor.astype(block.dims.dtype)
    score = np.zeros(len(rows), block.dims.dtype)
    for at in range(0, max(size, 1), STEP):
        read = order[at:at + STEP]
        whole = len(rows) == block.n
        for d in read:
            score += weights[d] * (block.dims[d] if whole else block.dims[d][rows])
        end = min(at + STEP, size)
        keep = yield rows, score, int(least[end]), int(most[end])
        if keep is not None and not keep.all():
            rows, score = rows[keep], score[keep]
    yield rows, score, 0, 0


def _best(block: Block, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the first ``k`` rows by falling score, then id."""
    order = np.lexsort((block.ids[rows], -score))[:k]
    return block.ids[rows[order]], score[order].astype(np.int64)


def first_of_label(block: Block, anchor: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` rows of the anchor's label but the anchor itself."""
    rows = np.arange(*block.of_label.get(label, (0, 0)))
    rows = rows[block.ids[rows] != own]
    scan = _steps(block, anchor, rows)
    rows, score, least, most = next(scan)
    while least != most or least:
        keep = None
        if len(rows) > k:
            sure = np.partition(score, len(score) - k)[len(score) - k] + least
            keep = score + most >= sure
        rows, score, least, most = scan.send(keep)
    for rows, score, _, _ in scan:
        pass
    return _best(block, rows, score, k)


def first_in_windows(block: Block, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window, its first ``k`` rows of another label whose score lies in it, ends included."""
    open_windows = [(a, b) for a, b in windows if a <= b]
    a, b = block.of_label.get(label, (0, 0))
    other = np.ones(block.n, bool)
    other[a:b] = False
    rows, score = np.zeros(0, np.int64), np.zeros(0)
    if open_windows:
        scan = _steps(block, anchor, np.arange(block.n))
        rows, score, least, most = next(scan)
        while True:
            keep = (score >= min(a for a, _ in open_windows) - most) & (score <= max(b for _, b in open_windows) - least)
            if other is not None:
                keep &= other
                other = None
            inside = np.flatnonzero(keep)
            own = score[inside]
            need = np.zeros(len(inside), bool)
            for a, b in set(open_windows):
                floor = a
                sure = own[(own >= a - least) & (own <= b - most)]
                if len(sure) >= k:
                    floor = max(a, int(np.partition(sure, len(sure) - k)[len(sure) - k]) + least)
                need |= (own >= floor - most) & (own <= b - least)
            keep[inside] = need
            try:
                rows, score, least, most = scan.send(keep)
            except StopIteration:
                rows, score = rows[keep], score[keep]
                break
    out = []
    for a, b in windows:
        hit = (score >= a) & (score <= b)
        out.append(_best(block, rows[hit], score[hit], k))
    return out


def _blocks_of(n: int, each: int, least: int) -> int:
    return max(1, math.ceil(n / each), min(least, n))


def _meet(blocks: DataFrame, n_blocks: int, anchors: DataFrame, n_anchor_blocks: int, work, schema: str) -> DataFrame:
    """``work(Block, anchors)`` for every pair of a block of rows and one of anchors, each in a group of its own."""
    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = [work(Block(r), own) for _, r in rows.iterrows()] if len(own) else []
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    tasks = min(n_blocks * n_anchor_blocks, 10_000)
    left = blocks.withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1)))).repartition(tasks, "block", "ablock")
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, "block", "ablock")
    return left.groupBy("block", "ablock").cogroup(right.groupBy("block", "ablock")).applyInPandas(run, schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, of: int = 100,
                   block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """Negatives of every anchor whose scores lie within shares of its positives' scores.

    ``rows`` holds (id long, label long, q array<long>), see :func:`quantized`; a
    score is the inner product with the anchor. Higher scores come first, ties by
    id. A positive is one of an anchor's first ``positives`` rows of its label with
    another id. For each, the first ``negatives`` rows of other labels with
    low * p <= of * score <= high * p are returned: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score. Short vectors count as
    ending in zeros. A repeated row is a candidate as often as it occurs; anchors
    that are equal in all are one. No rows or no anchors give none.
    """
    spark = rows.sparkSession
    n, n_anchors, dims = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("q"))).first()
    each = max(1, BLOCK_COMPONENTS // max(1, dims or 1))
    n_anchor_blocks = _blocks_of(n_anchors, min(block_anchors, each), 1)
    busy = math.ceil(TASKS_A_CORE * spark.sparkContext.defaultParallelism / n_anchor_blocks)
    n_blocks = _blocks_of(n, min(block_rows, each), busy)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    blocks = written(dealt.repartition(n_blocks, "block").groupBy("block").applyInPandas(
        _pack_rows, "block int, ids binary, labels binary, kind string, dims binary"))
    anchors = (rows.where(is_anchor).select(F.col("id").alias("anchor_id"), "label", "q", F.xxhash64("id", "label", "q").alias("akey"))
               .dropDuplicates(["anchor_id", "akey"])
               .withColumn("ablock", F.pmod("akey", F.lit(n_anchor_blocks)).cast("int")))

    def find_positives(block: Block, own: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(own["q"].tolist()).T
        block.ready(vectors)
        best = [first_of_label(block, v, a, label, positives) for a, v, label in zip(own["anchor_id"], vectors, own["label"])]
        times = [len(ids) for ids, _ in best]
        return pd.DataFrame({"anchor_id": np.repeat(own["anchor_id"], times), "akey": np.repeat(own["akey"], times),
                             "positive_id": np.concatenate([ids for ids, _ in best]), "positive_score": np.concatenate([scores for _, scores in best])})

    found = _meet(blocks, n_blocks, anchors, n_anchor_blocks, find_positives, "anchor_id long, akey long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "akey").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = (found.withColumn("slot", place).where(F.col("slot") <= positives)
              .groupBy("anchor_id", "akey").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_id", "positive_score"))).alias("own")))
    ready = written(anchors.join(chosen, ["anchor_id", "akey"]).select(
        "anchor_id", "akey", "ablock", "label", "q", F.col("own.positive_id").alias("pids"), F.col("own.positive_score").alias("pscores")))

    def find_negatives(block: Block, own: pd.DataFrame) -> pd.DataFrame:
        vectors = _matrix(own["q"].tolist()).T
        block.ready(vectors)
        best = []
        for vector, label, scores in zip(vectors, own["label"], own["pscores"]):
            best += first_in_windows(block, vector, label, [(-(-low * int(p) // of), high * int(p) // of) for p in scores], negatives)
        pairs = own[["anchor_id", "akey"]].assign(slot=[range(len(p)) for p in own["pids"]], positive_id=own["pids"], positive_score=own["pscores"])
        pairs = pairs.explode(["slot", "positive_id", "positive_score"], ignore_index=True)
        found = pairs.loc[np.repeat(np.arange(len(pairs)), [len(ids) for ids, _ in best])]
        return found.assign(negative_id=np.concatenate([ids for ids, _ in best]), negative_score=np.concatenate([scores for _, scores in best]))

    found = _meet(blocks, n_blocks, ready, n_anchor_blocks, find_negatives,
                  "anchor_id long, akey long, slot int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "akey", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
