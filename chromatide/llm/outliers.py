"""Robust outlier rule: minimum covariance determinant per language and source, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_words, written

SEPARATORS = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Transformed statistics, and the spread that is added to each one's scale: a statistic
#: that is constant in most of a group (no symbol at all, say) must not make it singular.
VECTOR = {"v1": 0.15, "v2": 0.08, "v3": 0.5, "v4": 0.15}
NAMES = list(VECTOR)
#: Share of a group's rows that the estimate covers (half: up to half of a group may be outliers); least fall of a log
#: determinant that calls for another concentration step; smallest group with an estimate of its own.
COVER, LEAST_FALL, LEAST_GROUP = 0.5, 1e-6, 50
BROADCAST_GROUPS = 20_000
#: Rows beyond this quantile of the chi-square distribution of squared distances are rejected.
CONFIDENCE = 0.9999


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words in windows that occur twice or more (the first occurrence included)."""
    windows = F.when(F.size(words) >= REPEAT_WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - REPEAT_WINDOW),
        lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, REPEAT_WINDOW)).alias("h"), i.alias("i"))))
    windows = F.coalesce(windows, F.array().cast("array<struct<h:bigint,i:int>>"))

    def starts(s):
        def again(x, k):
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))

    def step(a, i):
        return F.struct((a["n"] + i + REPEAT_WINDOW - F.greatest(a["end"], i)).alias("n"), (i + REPEAT_WINDOW).alias("end"))
    return F.aggregate(_let(F.sort_array(windows), starts), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed; null text has no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    found = docs.withColumn("_w", _let(split_words(t, SEPARATORS), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r"))))
    found = found.withColumns({
        "n_words": F.col("_w")["n"].cast("long"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_w")["r"].cast("long")}).drop("_w")
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, dof) < p else (low, mid)
    return low


def _squared_distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor l_ij and the centre m_i."""
    z: list[Column] = []
    for i, v in enumerate(NAMES):
        rest = F.col(v) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _products() -> dict[str, Column]:
    p = len(NAMES)
    out = {f"s{i}": F.col(v) for i, v in enumerate(NAMES)}
    return out | {f"q{i}{j}": F.col(NAMES[i]) * F.col(NAMES[j]) for i in range(p) for j in range(i + 1)}


def _sums(rows: DataFrame) -> DataFrame:
    """Per group and start: the number of rows ``m`` and the sums of the variables and of their products."""
    return rows.groupBy("g", "start").agg(F.count(F.lit(1)).cast("double").alias("m"), *[F.sum(c).alias(k) for k, c in _products().items()])


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Per group and start: centre, Cholesky factor of the scatter (times ``factor``, floors added) and log determinant."""
    p = len(NAMES)
    m = [F.col(f"s{i}") / F.col("m") for i in range(p)]
    moments = [c.alias(f"m{i}") for i, c in enumerate(m)]
    for i in range(p):
        for j in range(i + 1):
            scatter = F.col(f"q{i}{j}") / F.col("m") - m[i] * m[j]
            moments.append((F.greatest(scatter, F.lit(0.0)) * factor + VECTOR[NAMES[i]] ** 2 if i == j else scatter * factor).alias(f"c{i}{j}"))
    # one row each: the aggregate only keeps these terms out of the nested ones below, whose code would pass the JVM's limit
    out = sums.select("g", "start", *moments)
    out = out.groupBy("g", "start").agg(*[F.first(c).alias(c) for c in out.columns[2:]])
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("log_det", sum((F.log(f"l{i}{i}") for i in range(1, p)), F.log("l00"))).drop(*[f"c{i}{j}" for i in range(p) for j in range(i + 1)])


def _nearest(rows: DataFrame, side) -> DataFrame:
    """Sums over the share COVER of each group's and start's rows with the least ``d2``.

    Rows that tie at the cut (exact copies) count with the weight that gives
    the covered part its size, however many they are.
    """
    cut = rows.groupBy("g", "start").agg(F.percentile_approx("d2", COVER, 10_000).alias("cut"), F.count(F.lit(1)).alias("n"))
    near = rows.join(side(cut), ["g", "start"]).where("d2 <= cut").withColumn("tie", F.col("d2") == F.col("cut"))
    terms = {"m": F.lit(1.0), **_products()}
    both = near.groupBy("g", "start").agg(F.first("n").alias("n"), *[F.sum(F.when(F.col("tie") == tie, c).otherwise(0.0)).alias(f"{name}_{int(tie)}")
                                                                   for name, c in terms.items() for tie in (False, True)])
    size = COVER * F.col("n")
    both = both.withColumn("w0", F.least(F.lit(1.0), size / F.greatest("m_0", F.lit(1.0))))
    both = both.withColumn("w1", F.least(F.lit(1.0), F.greatest(F.lit(0.0), size - F.col("m_0")) / F.greatest("m_1", F.lit(1.0))))
    return both.select("g", "start", *[(F.col("w0") * F.col(f"{c}_0") + F.col("w1") * F.col(f"{c}_1")).alias(c) for c in terms])


def _groups(rows: DataFrame) -> DataFrame:
    """Add ``g``: language and source; sources with few rows share their language's group, and such languages one group."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("lang", "source")]
    rows = rows.withColumn("_l", F.xxhash64(name[0])).withColumn("_s", F.xxhash64(*name))
    size = rows.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n"))
    small = size.where(F.col("n") < LEAST_GROUP).groupBy("_l").agg(F.sum("n").alias("pooled"))
    g = F.when(F.col("n") >= LEAST_GROUP, F.col("_s")).when(F.col("pooled") >= LEAST_GROUP, F.col("_l")).otherwise(F.lit(0).cast("long"))
    return rows.join(size.join(small, "_l", "left").select("_s", g.alias("g")), "_s").drop("_l", "_s")


def mcd_distances(rows: DataFrame) -> DataFrame:
    """Add ``d2``: squared robust distance of each row's vector (v1..v4) from its group's estimate.

    Two deterministic starts (medians and median deviations; mean and
    covariance) take concentration steps, until the determinant of no group
    falls any more: estimate from the half of the rows nearest to the last
    estimate, measure again. The start with the smaller determinant counts. Groups are only ever aggregated, so one of any size is
    spread over the tasks; estimates are one row for each group and start.
    """
    factor = COVER / _chi2_cdf(chi2_quantile(COVER, len(NAMES)), len(NAMES) + 2)
    # Tables of one row for each group are broadcast while there are few groups, else joined by a shuffle.
    side = F.broadcast if rows.select("g").distinct().count() <= BROADCAST_GROUPS else lambda x: x
    middle = rows.groupBy("g").agg(*[F.percentile_approx(v, 0.5, 10_000).alias(f"m{i}") for i, v in enumerate(NAMES)])
    spread = rows.join(side(middle), "g").groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 10_000).alias(f"s{i}") for i, v in enumerate(NAMES)])
    diagonal = middle.join(spread, "g").withColumn("start", F.lit(0))
    for i, v in enumerate(NAMES):
        for j in range(i + 1):
            diagonal = diagonal.withColumn(f"l{i}{j}", F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + VECTOR[v] ** 2) if i == j else F.lit(0.0))
    classic = _estimate(_sums(rows.withColumn("start", F.lit(1))), 1.0)
    estimate = written(diagonal.withColumn("log_det", F.lit(0.0)).select(*classic.columns).unionByName(classic))

    def step(last: DataFrame) -> DataFrame:
        measured = rows.join(side(last), "g").select("g", "start", *NAMES, _squared_distance().alias("d2"))
        return _estimate(_nearest(measured, side), factor)

    last = written(step(estimate).withColumn("moving", F.lit(True)))
    values = [c for c in estimate.columns if c not in ("g", "start")]
    falls = F.col("moving") & F.coalesce(F.col("_log_det") < F.col("log_det") - LEAST_FALL, F.lit(False))
    while not last.where("moving").isEmpty():   # only groups and starts that still move are measured again
        new = step(last.where("moving").drop("moving")).select("g", "start", *[F.col(c).alias(f"_{c}") for c in values])
        last = written(last.join(side(new), ["g", "start"], "left")
                       .select("g", "start", *[F.when(falls, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values], falls.alias("moving")))
    estimate = last.drop("moving")
    best = estimate.groupBy("g").agg(F.min_by(F.struct(*[c for c in estimate.columns if c != "g"]), F.struct("log_det", "start")).alias("e")).select("g", "e.*")
    return rows.join(side(best), "g").withColumn("d2", _squared_distance()).select(*rows.columns, "d2")


def judge(docs: DataFrame) -> DataFrame:
    """Base statistics of every row of ``docs`` (doc_id, text, lang, source), ``d2`` and ``kept``.

    A row is kept if it passes the base rule and its squared robust distance
    is within the chi-square quantile CONFIDENCE. Rows that fail the base rule
    take no part in the estimates and have a null ``d2``. Null language or
    source are values of their own; repeated rows count as often as they
    occur; an empty table gives an empty result.
    """
    base = written(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    n = F.greatest("n_words", F.lit(1)).cast("double")
    vectors = base.where("not base_failed").withColumns({
        "v1": F.log(F.col("word_chars") / n), "v2": F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "v3": F.log1p("n_dup_lines"), "v4": F.sqrt(F.col("n_repeat_words") / n)})
    vectors = written(_groups(vectors))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = mcd_distances(vectors).select(*out, "d2")
    failed = base.where("base_failed").select(*out, F.lit(None).cast("double").alias("d2"))
    limit = chi2_quantile(CONFIDENCE, len(NAMES))
    return passed.unionByName(failed).withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("d2") <= limit), F.lit(False)))
