"""Evaluation: nearest-label matching, classification metrics, token metrics, losses.

Class statistics come from one ``groupBy(gt, pred)`` (at most classes^2
rows); everything after that works on that small table.  Per-sample token
metrics group by sample, then by sample and token.  Labels are matched by
joins; no class list is collected.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromatide.operators.common import running_sum
from chromatide.operators.distance import pairs

NAN = float("nan")
GRAM = 2  # length of the letter groups that labels and predictions meet by


def _classes(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct values of ``cols`` but null, as a table with the column ``c``."""
    return df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("c")).where(F.col("c").isNotNull()).distinct()


def _given(df: DataFrame, values: list | None, *cols: str) -> DataFrame:
    if values is None:
        return _classes(df, *cols)
    return df.sparkSession.createDataFrame([(v,) for v in values if v is not None], "c string").distinct()


def nearest_label(preds: DataFrame, labels: list | None = None, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Map each prediction to the ground-truth label with least edit distance (ties: label text asc).

    Works on the distinct predictions and labels.  1. Labels that share a letter
    pair with the prediction are compared.  2. A label without a common pair
    differs in at least (longer length - 1) / 2 letters, and any label by the
    difference of the lengths; only predictions whose best distance so far leaves
    room for that meet the labels of the lengths still possible.  The shortest
    label bounds predictions without any common pair.  A null prediction, or no
    label at all, gives a null ``nearest``.
    """
    known = _given(preds, labels, gt).select(F.col("c").alias("l"))
    asked = preds.select(F.col(pred).alias("p")).where(F.col("p").isNotNull()).distinct()

    def grams(c: str) -> Column:
        places = F.when(F.length(c) >= GRAM, F.sequence(F.lit(1), F.length(c) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
        return F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col(c), i, F.lit(GRAM)))))

    scored = F.struct(F.levenshtein("p", "l").alias("d"), F.col("l").alias("l"))
    met = asked.select("p", grams("p").alias("g")).join(known.select("l", grams("l").alias("g")), "g").select("p", "l").distinct()
    first = met.groupBy("p").agg(F.min(scored).alias("_near"))
    shortest = known.agg(F.min(F.length("l"))).first()[0]
    if shortest is None:
        return preds.withColumn("nearest", F.lit(None).cast("string"))
    longest = F.greatest(F.length("p"), F.lit(shortest))
    bounds = asked.join(first, "p", "left").withColumn("_d", F.least(F.coalesce("_near.d", longest), longest))
    reach = GRAM * F.col("_d") + GRAM - 1  # longest strings without a common group at this distance
    low, high = F.greatest(F.length("p") - F.col("_d"), F.lit(0)), F.least(F.length("p") + F.col("_d"), reach)
    open_ = bounds.where((F.length("p") <= reach) & (low <= high))
    second = (open_.select("p", F.explode(F.sequence(low, high)).alias("n")).join(known.withColumn("n", F.length("l")), "n")
              .groupBy("p").agg(F.min(scored).alias("_far")))
    found = bounds.join(second, "p", "left").select(F.col("p").alias("_p"), F.least("_near", "_far")["l"].alias("nearest"))
    return preds.join(found, preds[pred] == found["_p"], "left").drop("_p")


def pair_counts(df: DataFrame, gt: str = "gt", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Rows per (by, truth, prediction): the one pass over the input every class metric starts from."""
    return df.groupBy(*(by or []), gt, pred).agg(F.count(F.lit(1)).alias("_n"))


def class_stats(df: DataFrame, gt: str = "gt", pred: str = "pred", by: list[str] | None = None,
                pair: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn per class over the union of true and predicted classes."""
    by = by or []
    pair = pair if pair is not None else pair_counts(df, gt, pred, by)
    as_pred = pair.select(*by, F.col(pred).alias("cls"),
                          F.when(F.col(gt) == F.col(pred), F.col("_n")).otherwise(0).alias("tp"),
                          F.when(F.col(gt) != F.col(pred), F.col("_n")).otherwise(0).alias("fp"),
                          F.lit(0).cast("bigint").alias("fn"))
    as_true = pair.select(*by, F.col(gt).alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                          F.lit(0).cast("bigint").alias("fp"),
                          F.when(F.col(gt) != F.col(pred), F.col("_n")).otherwise(0).alias("fn"))
    return as_pred.unionByName(as_true).groupBy(*by, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(None).cast("double")).otherwise(a / b)


def macro_metrics(df: DataFrame, gt: str = "gt", pred: str = "pred", by: list[str] | None = None,
                  pair: DataFrame | None = None) -> DataFrame:
    """Accuracy; macro precision/recall (undefined classes leave the mean); macro F1 (undefined = 0)."""
    by = by or []
    pair = pair if pair is not None else pair_counts(df, gt, pred, by)
    st = class_stats(df, gt, pred, by, pair)
    macro = st.groupBy(*by).agg(
        F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        F.avg(_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
        F.avg(F.coalesce(_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).alias("macro_f1"))
    hit = F.when(F.col(gt) == F.col(pred), F.col("_n")).otherwise(0)
    acc = pair.groupBy(*by).agg((F.sum(hit) / F.sum("_n")).alias("accuracy"))
    return acc.join(macro, by) if by else _join_one(acc, macro)


def _join_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row aggregates on a constant key (both sides have exactly one row)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def confusion(df: DataFrame, classes: list | None = None, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Dense confusion counts over all classes (rows = truth).

    The grid of all class pairs is the result itself; it is made block by block.
    """
    counts = df.groupBy(F.col(gt).alias("truth"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    seen = _given(counts, classes, "truth", "predicted")
    grid = pairs(seen, "c", symmetric=False).select(F.col("c_i").alias("truth"), F.col("c_j").alias("predicted"))
    return grid.join(counts, ["truth", "predicted"], "left").fillna(0, ["n"])


def per_class(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Per-class precision, recall and accuracy (= recall, one-vs-rest hits on the class)."""
    st = class_stats(df, gt, pred)
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return st.select("cls", "tp", "fp", "fn", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     rec.alias("recall"), rec.alias("accuracy"))


def mcc(df: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    """Multiclass Matthews correlation from class margins."""
    st = class_stats(df, gt, pred).select("cls", "tp", (F.col("tp") + F.col("fp")).alias("p"),
                                          (F.col("tp") + F.col("fn")).alias("t"))
    agg = st.agg(F.sum("tp").cast("double").alias("c"), F.sum("t").cast("double").alias("s"),
                 F.sum(F.col("p") * F.col("t")).cast("double").alias("pt"),
                 F.sum(F.col("p") * F.col("p")).cast("double").alias("pp"),
                 F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"))
    den = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return agg.select(F.when(den == 0, F.lit(0.0)).otherwise(
        (F.col("c") * F.col("s") - F.col("pt")) / den).alias("mcc"))


def first_seen_ids(df: DataFrame, label: str, order: str) -> DataFrame:
    """Label ids numbered by first appearance (0-based)."""
    from chromatide.operators.common import global_position
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    return global_position(first, [F.col("_first"), F.col(label)], "label_id", 0).drop("_first")


# ---- token-level metrics ------------------------------------------------------------------

def unmask(labels: Column) -> Column:
    """drop -100 positions, then the last kept one (EOS)."""
    kept = F.filter(labels, lambda x: x != -100)
    return F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))


def shift_preds(labels: Column, preds: Column) -> Column:
    """Prediction n-1 aligned with label n: preds[first_kept-1 : last_kept-1] (0-based)."""
    kept = F.transform(labels, lambda x: x != -100)
    first = F.array_position(kept, True) - 1                           # 0-based first kept
    last = F.size(labels) - F.array_position(F.reverse(kept), True)    # 0-based last kept
    return F.when(F.array_position(kept, True) == 0, F.slice(preds, 1, 0)).otherwise(F.slice(preds, first, last - first))


def token_pairs(df: DataFrame, sample: str, labels: str = "labels", preds: str = "preds") -> DataFrame:
    """(sample, pos, y, p) rows of the aligned label and prediction tokens."""
    x = df.select(sample, unmask(F.col(labels)).alias("_y"), shift_preds(F.col(labels), F.col(preds)).alias("_p"))
    return x.select(sample, F.posexplode(F.arrays_zip(F.col("_y").alias("y"), F.col("_p").alias("p"))).alias("pos", "z")) \
        .select(sample, "pos", F.col("z.y").alias("y"), F.col("z.p").alias("p"))


def _listed_pairs(y: list, p: list) -> list[tuple]:
    """(y, p, count) of each distinct pair of two lists, the pair in first place first; the shorter list goes on with nulls."""
    return [(*pair, n) for pair, n in Counter(itertools.zip_longest(y, p)).items()]


def _counted_pairs(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_listed_pairs` of two arrays of whole numbers of equal length."""
    (y0, y1), (p0, p1) = (y.min(), y.max()), (p.min(), p.max())
    wide = int(p1) - int(p0) + 1
    if (int(y1) - int(y0) + 1) * wide > 4 * len(y) + 4096:          # few of many numbers
        (ys, yc), (ps, pc) = np.unique(y, return_inverse=True), np.unique(p, return_inverse=True)
    else:
        ys, yc, ps, pc = np.arange(int(y0), int(y1) + 1), y.astype(np.int64) - int(y0), np.arange(int(p0), int(p1) + 1), p.astype(np.int64) - int(p0)
    codes = yc * len(ps) + pc
    found, n = np.unique(codes, return_counts=True) if len(ys) * len(ps) > 4 * len(y) + 4096 else (None, np.bincount(codes))
    if found is None:
        found = np.flatnonzero(n)
        n = n[found]
    first = np.flatnonzero(found == codes[0])[0]
    order = np.append(first, np.delete(np.arange(len(found)), first))
    found, n = found[order], n[order]
    return ys[found // len(ps)], ps[found % len(ps)], n


def token_pair_counts(df: DataFrame, sample: str, labels: str = "labels", preds: str = "preds") -> DataFrame:
    """(sample, y, p, c, f) of the aligned tokens: rows per pair, and for how many samples the pair is in first place.

    The tokens of a row are counted where they lie; no row for each token is made.
    """
    x = df.select(sample, unmask(F.col(labels)).alias("_y"), shift_preds(F.col(labels), F.col(preds)).alias("_p"))
    y_type, p_type = x.schema["_y"].dataType.elementType, x.schema["_p"].dataType.elementType
    pair = T.StructType([T.StructField("y", y_type), T.StructField("p", p_type), T.StructField("c", T.LongType())])
    whole = isinstance(y_type, T.IntegralType) and isinstance(p_type, T.IntegralType)

    @F.arrow_udf(T.ArrayType(pair))
    def count(ys: pa.Array, ps: pa.Array) -> pa.Array:
        fields = list(zip(("y", "p", "c"), (ys.type.value_type, ps.type.value_type, pa.int64())))
        ends, parts = [0], []
        both = np.asarray(ys.is_valid()) & np.asarray(ps.is_valid())
        even = whole and not ys.flatten().null_count and not ps.flatten().null_count
        for i in range(len(ys)):
            n = 0
            if both[i]:
                y, p = ys[i].values, ps[i].values
                if even and len(y) == len(p):
                    got = _counted_pairs(np.asarray(y), np.asarray(p)) if len(y) else ((), (), ())
                else:
                    got = list(zip(*_listed_pairs(y.to_pylist(), p.to_pylist()))) or ((), (), ())
                n = len(got[0])
                if n:
                    parts.append([pa.array(v, t) for v, (_, t) in zip(got, fields)])
            ends.append(ends[-1] + n)
        columns = [pa.concat_arrays([part[j] for part in parts]) if parts else pa.array([], t) for j, (_, t) in enumerate(fields)]
        values = pa.StructArray.from_arrays(columns, fields=[pa.field(name, t) for name, t in fields])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    listed = x.select(sample, F.posexplode(count("_y", "_p")).alias("_at", "z"))
    return listed.groupBy(sample, F.col("z.y").alias("y"), F.col("z.p").alias("p")).agg(
        F.sum("z.c").alias("c"), F.sum((F.col("_at") == 0).cast("bigint")).alias("f"))


def token_macro(df: DataFrame, sample: str, labels: str = "labels", preds: str = "preds") -> DataFrame:
    """Accuracy and macro precision, recall, F1 of each sample's aligned tokens."""
    pair = token_pair_counts(df, sample, labels, preds).select(sample, "y", "p", F.col("c").alias("_n"))
    return macro_metrics(pair, "y", "p", [sample], pair)


def token_correlations(df: DataFrame, sample: str, labels: str = "labels", preds: str = "preds") -> DataFrame:
    """:func:`correlations` of each sample's aligned tokens."""
    return _correlations(token_pair_counts(df, sample, labels, preds), sample)


def token_metrics(df: DataFrame, sample: str, labels: str = "labels", preds: str = "preds") -> DataFrame:
    """Per-sample accuracy, macro P/R/F1, Pearson, Spearman, R^2/len (short-sample fallback)."""
    return token_macro(df, sample, labels, preds).join(token_correlations(df, sample, labels, preds), sample)


def correlations(tp: DataFrame, sample: str) -> DataFrame:
    """Pearson, Spearman (Pearson of mid-ranks), R^2 / n; n < 2 falls back to first-token equality.

    Token ids come from a small alphabet, so every statistic is a function of
    the pair counts per (sample, y, p): the token rows are aggregated map-side
    into at most |alphabet|^2 rows per sample before anything is shuffled.
    """
    return _correlations(tp.groupBy(sample, "y", "p").agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("pos") == 0).cast("bigint")).alias("f")), sample)


def _correlations(pc: DataFrame, sample: str) -> DataFrame:
    """:func:`correlations` from rows (sample, y, p, c, f): the pair's count and the number of times it comes first.

    A value's mid-rank is (#smaller values) + (its count + 1) / 2, from running
    sums over the few distinct values of a sample.  All sums are of integers or
    halves, so they are exact whatever the summation order.  A pair with a null
    counts for the ranks of its other value only.
    """
    def rank(col: str) -> Column:
        upto = F.sum("c").over(Window.partitionBy(sample).orderBy(col))
        own = F.sum("c").over(Window.partitionBy(sample, col))
        return upto - own + (own + 1) / 2.0

    x = pc.where(F.col(sample).isNotNull()).withColumn("ry", rank("y")).withColumn("rp", rank("p"))
    known = F.col("y").isNotNull() & F.col("p").isNotNull()
    equal = F.when(F.col("y") == F.col("p"), F.lit(1)).when(known, F.lit(0)).otherwise(F.lit(-1))
    c = F.when(known, F.col("c").cast("double"))
    y, p = F.col("y").cast("double"), F.col("p").cast("double")
    ry, rp = F.col("ry"), F.col("rp")
    agg = x.groupBy(sample).agg(
        F.sum(c).alias("n"),
        F.sum(c * p).alias("sx"), F.sum(c * y).alias("sy"), F.sum(c * p * p).alias("sxx"),
        F.sum(c * y * y).alias("syy"), F.sum(c * p * y).alias("sxy"),
        F.sum(c * rp).alias("rx"), F.sum(c * ry).alias("ry_"), F.sum(c * rp * rp).alias("rxx"),
        F.sum(c * ry * ry).alias("ryy"), F.sum(c * rp * ry).alias("rxy"),
        F.sum(c * (y - p) * (y - p)).alias("sse"),
        *[F.sum(F.when(equal == e, F.col("f")).otherwise(0)).cast("int").alias(f"_f{i}") for i, e in enumerate((1, 0, -1))]).where("n IS NOT NULL")

    def pearson(sx, sy, sxx, syy, sxy):
        n = F.col("n")
        vx = n * F.col(sxx) - F.col(sx) ** 2
        vy = n * F.col(syy) - F.col(sy) ** 2
        return F.when((vx <= 0) | (vy <= 0), F.lit(NAN)).otherwise(
            (n * F.col(sxy) - F.col(sx) * F.col(sy)) / F.sqrt(vx * vy))

    sst = F.col("syy") - F.col("sy") ** 2 / F.col("n")
    r2 = F.when(sst == 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("sse") / sst) / F.col("n")
    # a sample given more than once has a row for each of its first tokens
    first = F.explode(F.concat(*[F.array_repeat(F.lit(v).cast("double"), F.col(f"_f{i}")) for i, v in enumerate((1.0, 0.0, None))]))
    out = agg.select(sample, "n", pearson("sx", "sy", "sxx", "syy", "sxy").alias("pearson"),
                     pearson("rx", "ry_", "rxx", "ryy", "rxy").alias("spearman"), r2.alias("r2"), first.alias("first_eq"))
    short = F.col("n") < 2
    return out.select(sample, *[F.when(short, F.col("first_eq")).otherwise(F.col(col)).alias(col)
                                for col in ["pearson", "spearman", "r2"]])


# ---- scores, losses, AUROC ------------------------------------------------------------------

def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, not once for each element that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_sum_exp(a: Column) -> Column:
    return _bind(F.array_max(a), lambda m: m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.exp(v - m))))


def softmax(arr: Column) -> Column:
    """Softmax of a score array (max-shifted), in one pass for each of maximum, sum and result."""
    return _bind(arr.cast("array<double>"), lambda a: _bind(_log_sum_exp(a), lambda z: F.transform(a, lambda x: F.exp(x - z))))


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(arr, F.array_max(arr)) - 1


def cross_entropy(scores: Column, label: Column, double_softmax: bool = False) -> Column:
    """-log softmax(scores)[label]; with ``double_softmax`` the scores are softmax outputs first."""
    a = softmax(scores) if double_softmax else scores.cast("array<double>")
    return _bind(a, lambda x: _log_sum_exp(x) - F.element_at(x, label + 1))


def mse(a: Column, b: Column) -> Column:
    """E13 per row: mean squared difference of two vectors."""
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size(d)


def perplexity(losses: DataFrame, loss: str = "loss") -> DataFrame:
    """exp(mean token loss) and the number of tokens."""
    return losses.agg(F.exp(F.avg(loss)).alias("perplexity"), F.count(F.lit(1)).alias("n_tokens"))


def auroc(df: DataFrame, cls: str, score: str, positive: str) -> DataFrame:
    """ROC area per class by the mid-rank form (R+ - n+(n+ + 1)/2) / (n+ n-).

    Per (class, score) the positive and negative counts are aggregated, the
    negatives below each score come from a distributed running sum (a class
    holding most rows is split over partitions), ties count one half.
    """
    per = df.groupBy(cls, score).agg(F.sum(F.col(positive).cast("bigint")).alias("_pos"),
                                     F.sum((~F.col(positive)).cast("bigint")).alias("_neg"))
    below = running_sum(per, [cls], score, "_neg", "_negbelow", exclusive=True)
    part = below.groupBy(cls).agg(
        F.sum(F.col("_pos") * (F.col("_negbelow") + 0.5 * F.col("_neg"))).alias("_u"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return part.select(cls, "n_pos", "n_neg",
                       F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None).cast("double"))
                       .otherwise(F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def mean_pool(df: DataFrame, by: str, vec: str) -> DataFrame:
    """Element-wise mean of the vectors per group, as an ordered array."""
    x = df.select(by, F.posexplode(F.col(vec).cast("array<double>")).alias("_d", "_v"))
    m = x.groupBy(by, "_d").agg(F.avg("_v").alias("_m"))
    return m.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias(vec))


def fit_centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """M12 fit: one centroid per class (mean vector); the model is classes x dims."""
    return mean_pool(df, label, vec)


def score_centroids(df: DataFrame, centroids: DataFrame, label: str, vec: str) -> DataFrame:
    """M12 score: nearest centroid by Euclidean distance, ties to the smaller class.

    The fitted model (one row of classes x dims) is a scalar subquery of the
    plan, computed once. Without a centroid ``pred`` is null.
    """
    model = F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), F.col(vec).cast("array<double>").alias("v"))))
    df = df.withColumn("pred", centroids.where(F.col(label).isNotNull()).agg(model.alias("model")).scalar())
    x = F.col(vec).cast("array<double>")

    def dist(s):
        d = F.zip_with(x, s["v"], lambda a, b: (a - b) * (a - b))
        return F.struct(F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v)).alias("d"), s["c"].alias("c"))
    return df.withColumn("pred", F.array_min(F.transform("pred", dist))["c"])
