"""Quality classifier by co-training: a text view and a metadata view teach each other.

Each view is a logistic regression over hashed binary features. In every round
each view labels all unlabelled documents that it is sure of, and the other
view learns from those labels: feature counts and gradients are summed in
tasks, the driver holds weights only. At the end both views are calibrated on
labelled rows that neither was fitted on, and their log-odds are added.
"""

from __future__ import annotations

import math
import re
import string
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatide.session import scratch_path

from .common import free_name, written

BITS = 18
WORD = re.compile(r"[^\W\d_]+")
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
#: ASCII characters that are no letters become blanks.
BLANKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
UPPER, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
#: Bound of the labelled sample: this many ids, the least hashes of doc_id. The unlabelled documents are not sampled.
LABELLED = 8_000
#: Rounds of exchange; a view is sure of a document from this probability of its label.
ROUNDS, CONFIDENT = 3, 0.95
#: Steps over the labelled sample before the first round, and passes over all unlabelled documents in each round.
STEPS, PASSES, RIDGE = 150, 5, 1e-4
#: Residuals are summed as whole multiples of 1 / UNIT, so that sums do not depend on the order of the tasks.
UNIT = 1 << 24
#: Only features whose 2 x 2 chi-square against the label is at least this carry weight.
LEAST_CHI2 = 25.0
STEPS_OF_SHARE = [k / 100 for k in range(10)] + [k / 20 for k in range(2, 20)]


@lru_cache(1 << 12)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def text_features(text: str | None) -> list[int]:
    """Slots of the words and of the binned statistics of a whole text, each once."""
    text = text or ""
    words = _words(text)
    chars, parts = max(1, len(text)), text.split()
    count = Counter(parts)
    lines = [x for x in text.split("\n") if x.strip()]
    data, others = text.encode("utf-8", "surrogatepass"), _not_ascii(text)
    upper, digits = (len(data) - len(data.translate(None, plain)) + sum(text.count(c) for c in others if kind(c))
                     for plain, kind in ((UPPER, str.isupper), (DIGITS, str.isdigit)))
    share = {
        "symbol": sum(map(text.count, "#*$%&|<>")) / chars, "bang": text.count("!") / chars,
        "upper": upper / chars, "digit": digits / chars,
        "top": max(count.values(), default=0) / max(1, len(parts)), "distinct": len(count) / max(1, len(parts)),
        "lines": 1 - len(set(lines)) / max(1, len(lines)), "short": sum(len(x) < 20 for x in lines) / max(1, len(lines)),
    }
    # a slot for each step that a share reaches: hundredths up to 0.1, then twentieths
    found = {zlib.crc32(x) & ((1 << BITS) - 1) for x in set(words)}
    found.add(_slot(f"~words:{len(words).bit_length()}"))
    for k, v in share.items():
        found.update(_step_slots(k)[:bisect_left(STEPS_OF_SHARE, v)])
    return sorted(found)


@lru_cache(None)
def _step_slots(share: str) -> list[int]:
    return [_slot(f"~{share}>{step}") for step in STEPS_OF_SHARE]


def _words(text: str) -> list[bytes]:
    """The runs of ``WORD`` of the lower-cased text, in UTF-8: all else becomes blanks, then the bytes are split."""
    text = text.lower()
    for c in _not_ascii(text):
        if not WORD.match(c):
            text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(BLANKS).split()


def _not_ascii(text: str) -> set[str]:
    return set() if text.isascii() else set(NOT_ASCII.findall(text))


def page_features(lang: str | None, source: str | None, n_chars: float | None) -> list[int]:
    """Slots of a document's metadata; its text is not looked at."""
    size = "none" if n_chars is None or n_chars != n_chars else int(2 * math.log2(max(1.0, n_chars)))
    return sorted({_slot(f"lang:{lang}"), _slot(f"source:{source}"), _slot(f"size:{size}"), _slot(f"lang:{lang} source:{source}")})


class Csr:
    """Rows of slot numbers; every feature is 0 or 1."""

    def __init__(self, index: np.ndarray, size: np.ndarray):
        self.index, self.size = index, size
        self.row = np.repeat(np.arange(len(size), dtype=np.int32), size)

    @classmethod
    def of(cls, rows: list) -> Csr:
        index = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        return cls(index, np.array([len(r) for r in rows], np.int64))

    @classmethod
    def packed(cls, rows: list[bytes]) -> Csr:
        """Rows whose slots stand as 32-bit numbers in bytes."""
        return cls(np.frombuffer(b"".join(rows), np.int32), np.array([len(r) // 4 for r in rows], np.int64))

    @classmethod
    def short(cls, rows: list[bytes]) -> Csr:
        """Rows written by :func:`shortened`."""
        high = np.frombuffer(b"".join([r[:16] for r in rows]), np.uint32).reshape(-1, 4).astype(np.int64)
        low = np.frombuffer(b"".join([r[16:] for r in rows]), np.uint16).astype(np.int32)
        return cls(low + (np.repeat(np.tile(np.arange(4, dtype=np.int32), len(high)), high.ravel()) << 16), high.sum(1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=len(self.size))

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=e[self.row], minlength=1 << BITS)


def shortened(slots: list[int]) -> bytes:
    """Ascending slots in half the bytes: how many have each value of the two high bits, then the 16 low bits of all."""
    all_bits = np.array(slots, np.uint32)
    return np.bincount(all_bits >> 16, minlength=4).astype(np.uint32).tobytes() + all_bits.astype(np.uint16).tobytes()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class View:
    """Logistic regression; ``a`` and ``b`` calibrate its log-odds."""
    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def logit(self, x: Csr) -> np.ndarray:
        return x.dot(self.weights) + self.bias


def block_sums(xs: list[Csr], teachers: list[View], students: list[View] | None = None, used: list[np.ndarray] | None = None) -> np.ndarray:
    """[view, label, slot] over the rows that the other view's teacher is sure of; the last slot stands for the rows themselves.

    Counts of the features, or with ``students`` the sums of their residuals
    (probability less label, in units of 1 / UNIT) over the ``used`` features.
    """
    total = np.zeros((2, 2, (1 << BITS) + 1), np.int64)
    bad = [_sigmoid(t.logit(x)) for t, x in zip(teachers, xs)]
    for k, x in enumerate(xs):
        other = bad[1 - k]
        own = None if students is None else _sigmoid(students[k].logit(x))
        for label, sure in enumerate((other <= 1 - CONFIDENT, other >= CONFIDENT)):
            e = sure.astype(float) if own is None else np.where(sure, np.rint((own - label) * UNIT), 0.0)
            sums = x.back(e)
            total[k, label, :-1] = sums if used is None else np.where(used[k], sums, 0.0)
            total[k, label, -1] = e.sum()
    return total


def pool_sums(pool: DataFrame, teachers: list[View], students: list[View] | None = None, used: list[np.ndarray] | None = None) -> np.ndarray:
    """:func:`block_sums` over all rows of ``pool`` (t, p: slots as :func:`unlabelled` packs them), summed in tasks and then by slot: 2**20 rows at most come back."""
    shared = pool.sparkSession.sparkContext.broadcast((teachers, students, used))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + block_sums([opened(batch.column(c).to_pylist()) for c, opened in (("t", Csr.short), ("p", Csr.packed))], *shared.value)
        if not isinstance(total, int):
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["place", "n"])

    found = pool.select("t", "p").mapInArrow(add, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    total = np.zeros(2 * 2 * ((1 << BITS) + 1), np.int64)
    total[found["place"].to_numpy()] = found["n"].to_numpy()
    return total.reshape(2, 2, -1)


class Fit:
    """Ridge logistic regression of one view by Adam; features without a clear link to the label stay 0.

    The labelled sample counts in full. A pseudo-labelled document never weighs
    more than a labelled one, and those of a label together no more than the
    sample's rows of that label, however many there are.
    """

    def __init__(self, x: Csr, y: np.ndarray):
        self.x, self.y = x, y
        # without any label everything counts as clean
        prior = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        self.w, self.b = np.zeros(1 << BITS), math.log(prior / (1 - prior))
        self.bad, self.seen = x.back(y), x.back(np.ones(len(y)))
        self.teach(np.zeros((2, (1 << BITS) + 1)))

    def view(self) -> View:
        return View(self.w.copy(), self.b)

    def teach(self, counts: np.ndarray) -> None:
        """Take in the feature counts of the pseudo-labelled rows of both labels: their weight, and the features that carry weight."""
        own, rows = np.bincount(self.y.astype(int), minlength=2), counts[:, -1]
        self.share = np.minimum(1.0, own / np.maximum(rows, 1))
        soft = self.share[:, None] * counts
        self.total = len(self.y) + soft[:, -1].sum()
        self.used = _chi2(self.bad + soft[1, :-1], self.seen + soft[:, :-1].sum(0), self.y.sum() + soft[1, -1], self.total) >= LEAST_CHI2
        self.w[~self.used] = 0.0
        self.t, self.m, self.v = 0, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def step(self, residuals: np.ndarray | float = 0.0) -> None:
        """One step along the gradient of the sample and of ``residuals``, the sums over the pseudo-labelled rows of both labels."""
        e = _sigmoid(self.x.dot(self.w) + self.b) - self.y
        g = np.append(self.x.back(e), e.sum()) + self.share @ (np.zeros((2, 1)) + residuals) / UNIT
        g /= max(1.0, self.total)
        g[:-1] = np.where(self.used, g[:-1] + RIDGE * self.w, 0.0)
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        move = 0.1 * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-8)
        self.w -= move[:-1]
        self.b -= float(move[-1])


def _chi2(bad: np.ndarray, seen: np.ndarray, n_bad: float, n: float) -> np.ndarray:
    """Chi-square of each feature's 2 x 2 table with the label (each cell half a count more): rows with it, bad ones among them."""
    n, n_bad, a, df = n + 2.0, n_bad + 1.0, bad + 0.5, seen + 1.0
    return n * (a * (n - df - n_bad + a) - (df - a) * (n_bad - a)) ** 2 / (df * (n - df) * n_bad * (n - n_bad))


def _fit_line(columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on a few dense columns (the last is the constant) by Newton steps, slightly shrunk."""
    w = np.zeros(columns.shape[1])
    for _ in range(30):
        p = _sigmoid(columns @ w)
        h = columns.T @ (columns * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, columns.T @ (y - p) - 1e-2 * w)
    return w


@dataclass
class CoTrained:
    """The two views and the weights of their calibrated log-odds (text, page, constant)."""
    text: View
    page: View
    mix: np.ndarray

    def combine(self, text_logit: np.ndarray, page_logit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, p = self.text.a * text_logit + self.text.b, self.page.a * page_logit + self.page.b
        return _sigmoid(t), _sigmoid(p), _sigmoid(self.mix[0] * t + self.mix[1] * p + self.mix[2])


def co_train(text_rows: list, page_rows: list, y: np.ndarray, sums: Callable[..., np.ndarray]) -> CoTrained:
    """Fit from labelled rows (``y`` 0 or 1) and ``sums``, :func:`block_sums` over all unlabelled rows. Every fourth labelled row calibrates only."""
    known = np.arange(len(y))
    hold, learn = known[3::4], np.setdiff1d(known, known[3::4])
    rows = (text_rows, page_rows)
    csr = lambda view, ids: Csr.of([rows[view][i] for i in ids])
    fits = [Fit(csr(k, learn), y[learn]) for k in (0, 1)]
    for _ in range(STEPS if len(learn) else 0):
        for fit in fits:
            fit.step()
    for _ in range(ROUNDS if len(learn) else 0):   # what a view is sure of teaches the other view
        teachers = [fit.view() for fit in fits]
        for fit, counts in zip(fits, sums(teachers)):
            fit.teach(counts)
        for _ in range(PASSES):
            residuals = sums(teachers, [fit.view() for fit in fits], [fit.used for fit in fits])
            for fit, own in zip(fits, residuals):
                fit.step(own)
    views = [View(fit.w.astype(np.float32), fit.b) for fit in fits]
    calibrate = hold if len(hold) else known
    logits = [v.logit(csr(k, calibrate)) for k, v in enumerate(views)]
    mix = np.array([1.0, 0.0, 0.0])
    if len(calibrate) and len(np.unique(y[calibrate])) == 2:
        for view, z in zip(views, logits):
            view.a, view.b = _fit_line(np.stack([z, np.ones_like(z)], 1), y[calibrate])
        z = np.stack([v.a * x + v.b for v, x in zip(views, logits)] + [np.ones(len(calibrate))], 1)
        mix = _fit_line(z, y[calibrate])
    return CoTrained(*views, mix)


def bad_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, bad): 1 if any row says toxic or of low quality, 0 if all say neither, null where a value is missing."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1.0).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 0.0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))


def _whole(slots: list[int]) -> bytes:
    return np.array(slots, np.int32).tobytes()


def _featured(docs: DataFrame, pack: Callable[[list[int]], bytes] = _whole) -> DataFrame:
    """(doc_id, x): the packed slots of both views (t, p) of every row; ``pack`` packs those of the text."""
    @F.pandas_udf("t binary, p binary")
    def features(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang, source, n_chars in parts:
            yield pd.DataFrame({"t": [pack(text_features(x)) for x in text],
                                "p": [_whole(page_features(*x)) for x in zip(lang, source, n_chars)]})

    return docs.select("doc_id", features("text", "lang", "source", F.col("n_chars").cast("double")).alias("x"))


def _marked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, x, bad): the slots of every row, the text's shortened, with the label of its doc_id in ``known`` or null.

    Few known ids are joined as many are: a join that broadcasts them up to some
    size and then shuffles the slots would need much more disk from there on.
    """
    return _featured(docs, shortened).hint("merge").join(known, "doc_id", "left")


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Packed slots (t, p) of every row of ``docs`` whose doc_id is not in ``known`` (doc_id, bad), written once; texts are not shuffled."""
    path = scratch_path(docs.sparkSession, "unlabelled")
    # A left join with a filter: an anti-join would be moved below the features, and shuffle texts.
    _marked(docs, known).where("bad is null").select("x.t", "x.p").write.parquet(path)
    return docs.sparkSession.read.schema("t binary, p binary").parquet(path)


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Fit on at most LABELLED labelled documents (the least hashes of doc_id; of rows that share an id one counts) and all unlabelled rows.

    Null and unknown ids are unlabelled. Without any label every document gets
    the probability 0.01.
    """
    # The labelled ids are written first: their size is known when Spark plans the joins, and no text but the sample's moves.
    known = written(bad_labels(labels).where("bad is not null"))
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = F.broadcast(present.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(LABELLED))   # LABELLED ids at most
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").join(chosen.select("doc_id"), "doc_id", "left_semi")
    sample = (_featured(own).groupBy("doc_id").agg(F.min("x").alias("x")).join(chosen, "doc_id")
              .select(F.col("doc_id").cast("string").alias("doc_id"), "bad", "x.t", "x.p").toPandas().sort_values("doc_id", kind="stable"))
    order = np.random.default_rng(4).permutation(len(sample))
    rows = [[np.frombuffer(sample[c].iloc[i], np.int32) for i in order] for c in ("t", "p")]
    pool = unlabelled(docs, known) if len(sample) else None
    return co_train(*rows, sample["bad"].to_numpy(float)[order], lambda *args: pool_sums(pool, *args))


def _judged(docs: DataFrame, model: CoTrained) -> tuple[DataFrame, str]:
    """``docs`` with a struct of both views' probabilities and the combined one, and that column's name, which ``docs`` has not."""
    name = free_name(docs, "judged")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text_score double, page_score double, score double")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for text, lang, source, n_chars in parts:
            t = m.text.logit(Csr.of([text_features(x) for x in text]))
            p = m.page.logit(Csr.of([page_features(*x) for x in zip(lang, source, n_chars)]))
            yield pd.DataFrame(dict(zip(("text_score", "page_score", "score"), m.combine(t, p))))

    return docs.withColumn(name, judge("text", "lang", "source", F.col("n_chars").cast("double"))), name


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """Add ``text_score``, ``page_score`` and ``score``: probabilities that the document is bad.

    Every row is scored from its whole text and its metadata; nulls count as
    empty values. Columns of those names are replaced, others pass through.
    """
    judged, name = _judged(docs.drop("text_score", "page_score", "score"), model)
    return judged.select("*", f"{name}.*").drop(name)


def drop_bad(docs: DataFrame, model: CoTrained, reject_from: float) -> DataFrame:
    """``docs`` without the rows whose combined probability of being bad reaches ``reject_from``; all columns stay."""
    judged, name = _judged(docs, model)
    return judged.where(F.col(f"{name}.score") < reject_from).drop(name)
