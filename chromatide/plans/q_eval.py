"""Registered queries: nearest-label matching, classification and token metrics, losses, AUROC, vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chromatide.operators import classify as K
from chromatide.operators import evaluate as E
from chromatide.operators.sequences import char_ids
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

STEP = 24          # classifier batch size
SHORT = "CAST(2 + length(seq) % 3 AS INT)"


def mapped(i: Inputs):
    p = i.preds
    return E.nearest_label(p).select("sample_id", "gt", F.col("nearest").alias("pred"), F.col("pred").alias("raw_pred"))


MAPPED = """SELECT sample_id, gt, label AS pred, raw_pred FROM (
  SELECT p.sample_id, p.gt, p.pred AS raw_pred, l.label,
         row_number() OVER (PARTITION BY p.sample_id ORDER BY levenshtein(p.pred, l.label), l.label) AS r
  FROM preds p, (SELECT DISTINCT gt AS label FROM preds) l) WHERE r = 1"""


def stats_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    jb = f"USING ({by})" if by else "ON TRUE"
    return f"""WITH m AS ({src}),
 cls AS (SELECT {b}gt AS c FROM m UNION SELECT {b}pred FROM m),
 st AS (SELECT {('cls.' + by + ', ') if by else ''}c, SUM(CASE WHEN gt = c AND pred = c THEN 1 ELSE 0 END) AS tp,
          SUM(CASE WHEN pred = c AND gt <> c THEN 1 ELSE 0 END) AS fp,
          SUM(CASE WHEN gt = c AND pred <> c THEN 1 ELSE 0 END) AS fn FROM cls JOIN m {jb} GROUP BY {b}c)"""


def macro_sql(src: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return stats_sql(src, by) + f""",
 mac AS (SELECT {b}avg(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END) AS precision,
            avg(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END) AS recall,
            avg(COALESCE(CASE WHEN 2 * tp + fp + fn = 0 THEN NULL ELSE 2 * tp / (2 * tp + fp + fn) END, 0.0)) AS macro_f1
          FROM st {g}),
 acc AS (SELECT {b}avg(CASE WHEN gt = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM m {g})"""


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("join_nearest_label", views=("preds",), sql=MAPPED)
def join_nearest_label(spark, sf):
    return mapped(Inputs(spark, sf))


@query("eval_accuracy", views=("preds",), sql=f"{macro_sql(MAPPED)} SELECT round(accuracy, 6) AS accuracy FROM acc")
def eval_accuracy(spark, sf):
    return _r6(E.macro_metrics(mapped(Inputs(spark, sf))).select("accuracy"), ["accuracy"])


@query("eval_macro_precision", views=("preds",), sql=f"{macro_sql(MAPPED)} SELECT round(precision, 6) AS precision FROM mac")
def eval_macro_precision(spark, sf):
    return _r6(E.macro_metrics(mapped(Inputs(spark, sf))).select("precision"), ["precision"])


@query("eval_macro_recall", views=("preds",), sql=f"{macro_sql(MAPPED)} SELECT round(recall, 6) AS recall FROM mac")
def eval_macro_recall(spark, sf):
    return _r6(E.macro_metrics(mapped(Inputs(spark, sf))).select("recall"), ["recall"])


@query("eval_macro_f1", views=("preds",), sql=f"{macro_sql(MAPPED)} SELECT round(macro_f1, 6) AS macro_f1 FROM mac")
def eval_macro_f1(spark, sf):
    return _r6(E.macro_metrics(mapped(Inputs(spark, sf))).select("macro_f1"), ["macro_f1"])


@query("eval_llm_report", views=("preds",), sql=f"""{macro_sql(MAPPED)}
SELECT (SELECT COUNT(DISTINCT gt) FROM preds) AS n_labels, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(macro_f1, 6) AS macro_f1 FROM acc, mac""")
def eval_llm_report(spark, sf):
    i = Inputs(spark, sf)
    m = E.macro_metrics(mapped(i))
    n = i.preds.agg(F.countDistinct("gt").alias("n_labels"))
    return _r6(E._join_one(n, m), ["accuracy", "precision", "recall", "macro_f1"])


@query("eval_llm_table", views=("preds",), sql=MAPPED)
def eval_llm_table(spark, sf):
    """The report's table: truth, matched label and raw prediction of every sample."""
    return mapped(Inputs(spark, sf))


@query("eval_confusion", views=("preds",), sql=f"""WITH m AS ({MAPPED}), c AS (SELECT gt AS x FROM m UNION SELECT pred FROM m)
SELECT a.x AS truth, b.x AS predicted, COUNT(m.sample_id) AS n FROM c a CROSS JOIN c b
LEFT JOIN m ON m.gt = a.x AND m.pred = b.x GROUP BY 1, 2""")
def eval_confusion(spark, sf):
    return E.confusion(mapped(Inputs(spark, sf)))


@query("eval_per_class", views=("preds",), sql=f"""{stats_sql(MAPPED)}
SELECT c AS cls, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 6) AS accuracy FROM st""")
def eval_per_class(spark, sf):
    return _r6(E.per_class(mapped(Inputs(spark, sf))), ["precision", "recall", "accuracy"])


@query("eval_mcc", views=("preds",), sql=f"""{stats_sql(MAPPED)},
 a AS (SELECT CAST(SUM(tp) AS DOUBLE) AS c, CAST(SUM(tp + fn) AS DOUBLE) AS s, CAST(SUM((tp + fp) * (tp + fn)) AS DOUBLE) AS pt,
          CAST(SUM((tp + fp) * (tp + fp)) AS DOUBLE) AS pp, CAST(SUM((tp + fn) * (tp + fn)) AS DOUBLE) AS tt FROM st)
SELECT round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0.0 ELSE (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM a""")
def eval_mcc(spark, sf):
    return _r6(E.mcc(mapped(Inputs(spark, sf))), ["mcc"])


@query("eval_step_epoch", views=("preds",), sql=f"""{macro_sql(f"SELECT sample_id // {STEP} AS step, gt, pred FROM ({MAPPED})", "step")},
 ep AS (SELECT * FROM ({macro_sql(MAPPED)} SELECT accuracy, precision, recall, macro_f1 FROM acc, mac))
SELECT step, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(macro_f1, 6) AS macro_f1 FROM acc JOIN mac USING (step)
UNION ALL SELECT -1, round(accuracy, 6), round(precision, 6), round(recall, 6), round(macro_f1, 6) FROM ep""")
def eval_step_epoch(spark, sf):
    m = mapped(Inputs(spark, sf)).withColumn("step", F.floor(F.col("sample_id") / STEP).cast("bigint"))
    per_step = E.macro_metrics(m, by=["step"])
    epoch = E.macro_metrics(m).withColumn("step", F.lit(-1).cast("bigint"))
    cols = ["step", "accuracy", "precision", "recall", "macro_f1"]
    return _r6(per_step.select(*cols).unionByName(epoch.select(*cols)), cols[1:])


@query("win_first_seen_label_id", views=("preds",), sql="""
SELECT gt, row_number() OVER (ORDER BY first, gt) - 1 AS label_id FROM (SELECT gt, min(sample_id) AS first FROM preds GROUP BY gt)""")
def win_first_seen_label_id(spark, sf):
    return E.first_seen_ids(Inputs(spark, sf).preds, "gt", "sample_id")


# ---- token metrics -------------------------------------------------------------------

def token_samples(i: Inputs):
    """Whole contigs as samples: labels = all tokens behind a -100 question mask,
    predictions = the same tokens shifted by one (then PAD), as a next-token model would emit."""
    # tokenise once (a separate projection: Catalyst does not duplicate a costly expression into the next one)
    c = i.contigs.select("contig", (F.length("seq") % 4 + 1).cast("int").alias("_q"), char_ids("seq").alias("_t"))
    t, q = F.col("_t"), F.col("_q")
    return c.select(F.col("contig").alias("sample"),
                    F.concat(F.array_repeat(F.lit(-100), q), t).alias("labels"),
                    F.concat(F.array_repeat(F.lit(0), q), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                             F.array(F.lit(4))).alias("preds"))


TOK = ("list_transform(string_split({c}, ''), lambda x: CASE x WHEN 'A' THEN 7 WHEN 'C' THEN 8 "
       "WHEN 'G' THEN 9 WHEN 'T' THEN 10 WHEN 'N' THEN 11 ELSE 6 END)")


def samples_sql() -> str:
    return f"""SELECT contig AS sample, list_concat(list_resize([]::INT[], CAST(length(seq) % 4 + 1 AS INT), -100), t) AS labels,
  list_concat(list_resize([]::INT[], CAST(length(seq) % 4 + 1 AS INT), 0), t[2:], [4]) AS preds
  FROM (SELECT contig, seq, {TOK.format(c='seq')} AS t FROM contigs)"""


def short_samples_sql() -> str:
    """Short samples (2-4 label tokens) for the fallback rule."""
    t = TOK.format(c="rpad(seq, 25, 'N')")
    return f"""SELECT contig AS sample, list_concat(list_resize([]::INT[], CAST(length(seq) % 4 + 1 AS INT), -100), t[1:{SHORT}]) AS labels,
  list_concat(list_resize([]::INT[], CAST(length(seq) % 4 + 1 AS INT), 0), t[2:25]) AS preds
  FROM (SELECT contig, seq, {t} AS t FROM contigs)"""


def aligned_sql(src: str) -> str:
    return f"""SELECT sample, y, p, pos FROM (
  SELECT sample, unnest(y) AS y, unnest(p) AS p, unnest(range(0, len(y))) AS pos FROM (
   SELECT sample, list_filter(labels, lambda x: x <> -100)[1:len(list_filter(labels, lambda x: x <> -100)) - 1] AS y,
          preds[list_min(ix) : list_max(ix) - 1] AS p FROM (
     SELECT *, list_filter(list_transform(labels, lambda x, i: CASE WHEN x <> -100 THEN i - 1 ELSE -1 END), lambda i: i >= 0) AS ix
     FROM ({src}))))"""


@query("filter_masked_tokens", views=("contigs",), sql=f"""
SELECT sample, array_to_string(list_filter(labels, lambda x: x <> -100)[1:len(list_filter(labels, lambda x: x <> -100)) - 1], ',') AS labels
FROM ({samples_sql()})""")
def filter_masked_tokens(spark, sf):
    s = token_samples(Inputs(spark, sf))
    return s.select("sample", F.array_join(E.unmask(F.col("labels")).cast("array<string>"), ",").alias("labels"))


@query("eval_label_shift", views=("contigs",), sql=f"""
SELECT sample, array_to_string(preds[list_min(ix) : list_max(ix) - 1], ',') AS preds FROM (
  SELECT *, list_filter(list_transform(labels, lambda x, i: CASE WHEN x <> -100 THEN i - 1 ELSE -1 END), lambda i: i >= 0) AS ix
  FROM ({samples_sql()}))""")
def eval_label_shift(spark, sf):
    s = token_samples(Inputs(spark, sf))
    return s.select("sample", F.array_join(E.shift_preds(F.col("labels"), F.col("preds")).cast("array<string>"), ",").alias("preds"))


def corr_sql(src: str) -> str:
    al = aligned_sql(src)
    pear = """CASE WHEN (n * sxx - sx * sx) <= 0 OR (n * syy - sy * sy) <= 0 THEN 'NaN'::DOUBLE
      ELSE (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END"""
    return f"""WITH al AS ({al}),
 rk AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY y) + (COUNT(*) OVER (PARTITION BY sample, y) - 1) / 2.0 AS ry,
               rank() OVER (PARTITION BY sample ORDER BY p) + (COUNT(*) OVER (PARTITION BY sample, p) - 1) / 2.0 AS rp FROM al),
 pe AS (SELECT sample, {pear} AS pearson FROM (SELECT sample, COUNT(*) AS n, SUM(p::DOUBLE) AS sx, SUM(y::DOUBLE) AS sy,
        SUM(p::DOUBLE * p) AS sxx, SUM(y::DOUBLE * y) AS syy, SUM(p::DOUBLE * y) AS sxy FROM al GROUP BY sample)),
 sp AS (SELECT sample, {pear} AS spearman FROM (SELECT sample, COUNT(*) AS n, SUM(ry) AS sx, SUM(rp) AS sy,
        SUM(ry * ry) AS sxx, SUM(rp * rp) AS syy, SUM(ry * rp) AS sxy FROM rk GROUP BY sample)),
 r2 AS (SELECT sample, n, first_eq, CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sse / sst END / n AS r2
        FROM (SELECT sample, COUNT(*) AS n, SUM((y::DOUBLE - p) * (y::DOUBLE - p)) AS sse,
              SUM(y::DOUBLE * y) - SUM(y::DOUBLE) * SUM(y::DOUBLE) / COUNT(*) AS sst,
              arg_min(CASE WHEN y = p THEN 1.0 ELSE 0.0 END, pos) AS first_eq FROM al GROUP BY sample)),
 c AS (SELECT r2.sample, CASE WHEN n < 2 THEN first_eq ELSE pearson END AS pearson,
          CASE WHEN n < 2 THEN first_eq ELSE spearman END AS spearman, CASE WHEN n < 2 THEN first_eq ELSE r2 END AS r2
       FROM r2 JOIN pe USING (sample) JOIN sp USING (sample))"""


@query("eval_token_metrics", views=("contigs",), sql=f"""{macro_sql(f"SELECT sample, y AS gt, p AS pred FROM ({aligned_sql(samples_sql())})", "sample")}
SELECT sample, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(macro_f1, 6) AS macro_f1 FROM acc JOIN mac USING (sample)""")
def eval_token_metrics(spark, sf):
    m = E.token_macro(token_samples(Inputs(spark, sf)), "sample")
    return _r6(m.select("sample", "accuracy", "precision", "recall", "macro_f1"),
               ["accuracy", "precision", "recall", "macro_f1"])


def _corr(spark, sf, col):
    return _r6(E.token_correlations(token_samples(Inputs(spark, sf)), "sample").select("sample", col), [col])


@query("eval_pearson", views=("contigs",), sql=corr_sql(samples_sql()) + " SELECT sample, round(pearson, 6) AS pearson FROM c")
def eval_pearson(spark, sf):
    return _corr(spark, sf, "pearson")


@query("eval_spearman", views=("contigs",), sql=corr_sql(samples_sql()) + " SELECT sample, round(spearman, 6) AS spearman FROM c")
def eval_spearman(spark, sf):
    return _corr(spark, sf, "spearman")


@query("eval_r2", views=("contigs",), sql=corr_sql(samples_sql()) + " SELECT sample, round(r2, 6) AS r2 FROM c")
def eval_r2(spark, sf):
    return _corr(spark, sf, "r2")


def _mean_sql(cols):
    return ", ".join(f"round(avg(CASE WHEN isnan({c}) THEN NULL ELSE {c} END), 6) AS {c}" for c in cols)


MACRO, CORR = ["accuracy", "precision", "recall", "macro_f1"], ["pearson", "spearman", "r2"]


@query("eval_token_means", views=("contigs",), sql=f"""SELECT * FROM
({macro_sql(f"SELECT sample, y AS gt, p AS pred FROM ({aligned_sql(samples_sql())})", "sample")}
 SELECT COUNT(*) AS n_samples, {_mean_sql(MACRO)} FROM acc JOIN mac USING (sample)) a,
({corr_sql(samples_sql())} SELECT {_mean_sql(CORR)} FROM c) b""")
def eval_token_means(spark, sf):
    """E06-E09 as the report gives them: each metric's mean over the samples (undefined ones left out)."""
    samples = token_samples(Inputs(spark, sf))
    per = E.token_macro(samples, "sample").join(E.token_correlations(samples, "sample"), "sample", "left")
    return per.agg(F.count(F.lit(1)).alias("n_samples"),
                   *[F.round(F.avg(F.when(~F.isnan(c), F.col(c))), 6).alias(c) for c in MACRO + CORR])


@query("eval_short_fallback", views=("contigs",), sql=corr_sql(short_samples_sql()) +
       " SELECT sample, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(r2, 6) AS r2 FROM c")
def eval_short_fallback(spark, sf):
    i = Inputs(spark, sf)
    c = i.contigs
    t = char_ids(F.rpad("seq", 25, "N"))
    q = (F.length("seq") % 4 + 1).cast("int")
    n = (F.length("seq") % 3 + 2).cast("int")
    s = c.select(F.col("contig").alias("sample"), F.concat(F.array_repeat(F.lit(-100), q), F.slice(t, 1, n)).alias("labels"),
                 F.concat(F.array_repeat(F.lit(0), q), F.slice(t, 2, 24)).alias("preds"))
    tp = E.token_pairs(s, "sample")
    return _r6(E.correlations(tp, "sample"), ["pearson", "spearman", "r2"])


# ---- scores and vectors on the embeddings ------------------------------------------------

SCORES = "CAST(embedding AS DOUBLE[])"      # one score for each dimension


def softmax_sql(src: str) -> str:
    """Rows of ``src`` (with scores ``s``) plus ``lse`` and the softmax ``sm``."""
    return f"""SELECT *, list_transform(s, lambda x: exp(x - lse)) AS sm FROM (
  SELECT *, mx + ln(list_sum(list_transform(s, lambda x: exp(x - mx)))) AS lse FROM (SELECT *, list_max(s) AS mx FROM ({src})))"""


LOSS_SQL = softmax_sql(f"SELECT vec_id, label, {SCORES} AS s FROM logits")


def _scores(i):
    return i.logits.select("vec_id", "cell", "label", F.col("embedding").cast("array<double>").alias("s"))


@query("cls_softmax_argmax", views=("logits",), sql=f"""
SELECT vec_id, CAST(list_position(s, mx) - 1 AS INTEGER) AS pred, round(list_max(sm), 6) AS p_max FROM ({LOSS_SQL})""")
def cls_softmax_argmax(spark, sf):
    x = _scores(Inputs(spark, sf))
    return x.select("vec_id", E.argmax(F.col("s")).alias("pred"), F.round(F.array_max(E.softmax(F.col("s"))), 6).alias("p_max"))


@query("eval_cross_entropy", views=("logits",), sql=f"""
SELECT round(avg(once), 6) AS ce, round(avg(lse - s[label + 1]), 6) AS ce_double_softmax
FROM ({softmax_sql(f"SELECT label, sm AS s, lse - s[label + 1] AS once FROM ({LOSS_SQL})")})""")
def eval_cross_entropy(spark, sf):
    x = _scores(Inputs(spark, sf))
    return x.agg(F.round(F.avg(E.cross_entropy(F.col("s"), F.col("label"))), 6).alias("ce"),
                 F.round(F.avg(E.cross_entropy(F.col("s"), F.col("label"), True)), 6).alias("ce_double_softmax"))


@query("eval_mse", views=("logits",), sql="""
SELECT round(avg(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(a)), 6) AS mse
FROM (SELECT CAST(embedding AS DOUBLE[]) AS a, list_reverse(CAST(embedding AS DOUBLE[])) AS b FROM logits)""")
def eval_mse(spark, sf):
    x = _scores(Inputs(spark, sf))
    return x.agg(F.round(F.avg(E.mse(F.col("s"), F.reverse("s"))), 6).alias("mse"))


@query("eval_perplexity", views=("logits",), sql=f"""
SELECT round(exp(avg(lse - s[label + 1])), 6) AS perplexity, COUNT(*) AS n_tokens FROM ({LOSS_SQL})""")
def eval_perplexity(spark, sf):
    x = _scores(Inputs(spark, sf)).select(E.cross_entropy(F.col("s"), F.col("label")).alias("loss"))
    return _r6(E.perplexity(x), ["perplexity"])


@query("eval_auroc", views=("logits",), sql=f"""
WITH x AS (SELECT c, s[c + 1] AS score, label = c AS pos FROM (SELECT label, {SCORES} AS s FROM logits),
           (SELECT unnest(range(0, (SELECT max(len(embedding)) FROM logits))) AS c)),
 r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY score) + (COUNT(*) OVER (PARTITION BY c, score) - 1) / 2.0 AS mr FROM x)
SELECT c AS cls, SUM(CASE WHEN pos THEN 1 ELSE 0 END) AS n_pos, SUM(CASE WHEN pos THEN 0 ELSE 1 END) AS n_neg,
  round((SUM(CASE WHEN pos THEN mr ELSE 0 END) - SUM(CASE WHEN pos THEN 1 ELSE 0 END) * (SUM(CASE WHEN pos THEN 1 ELSE 0 END) + 1) / 2.0)
   / nullif(SUM(CASE WHEN pos THEN 1 ELSE 0 END) * SUM(CASE WHEN pos THEN 0 ELSE 1 END), 0), 6) AS auroc FROM r GROUP BY c""")
def eval_auroc(spark, sf):
    x = _scores(Inputs(spark, sf))
    long = x.select("label", F.posexplode("s").alias("cls", "score")).select(
        F.col("cls").cast("bigint").alias("cls"), "score", (F.col("label") == F.col("cls")).alias("pos"))
    return _r6(E.auroc(long, "cls", "score", "pos"), ["auroc"])


@query("emb_mean_pool", views=("logits",), sql="""
SELECT cell, d AS dim, round(avg(v), 6) AS value FROM (
  SELECT cell, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(0, len(embedding))) AS d FROM logits) GROUP BY cell, d""")
def emb_mean_pool(spark, sf):
    pooled = E.mean_pool(Inputs(spark, sf).logits, "cell", "embedding")
    return pooled.select("cell", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("cls_centroid", views=("logits",), sql="""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM logits),
 cen AS (SELECT label AS c, list(m ORDER BY d) AS cv FROM (
   SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS d FROM e) GROUP BY label, d) GROUP BY label),
 dd AS (SELECT e.vec_id, e.label, cen.c, sqrt(list_sum(list_transform(list_zip(e.v, cen.cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
        FROM e, cen)
SELECT vec_id, label, c AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS r FROM dd) WHERE r = 1""")
def cls_centroid(spark, sf):
    e = Inputs(spark, sf).logits.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    cents = E.fit_centroids(e, "label", "embedding")
    return E.score_centroids(e, cents, "label", "embedding").select("vec_id", "label", "pred")


GRADIENT_SQL = """
WITH e AS (SELECT label, list_concat(CAST(embedding AS DOUBLE[]), [1.0::DOUBLE]) AS v FROM logits
           WHERE label IS NOT NULL AND embedding IS NOT NULL),
 x AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS d FROM e),
 per AS (SELECT label, d, SUM(x) AS s FROM x GROUP BY label, d),
 tot AS (SELECT d, SUM(s) AS s FROM per GROUP BY d),
 k AS (SELECT COUNT(DISTINCT label) AS k, COUNT(*) AS n FROM e)
SELECT per.label, per.d AS dim, round((tot.s / k - per.s) / n, 6) AS value, round(ln(k), 6) AS loss FROM per JOIN tot USING (d), k"""


@query("cls_softmax_gradient", views=("logits",), sql=GRADIENT_SQL)
def cls_softmax_gradient(spark, sf):
    """First pass of the fit: loss and gradient at zero weights, by class and dimension (the last is the intercept)."""
    classes, rows, dims = K.usable_rows(Inputs(spark, sf).logits, "label", "embedding")
    loss, grad = K.loss_and_gradient(rows, np.zeros((len(classes), dims + 1)), rows.count(), 0.0)
    out = [(c, d, float(v)) for c, row in zip(classes, grad) for d, v in enumerate(row)]
    return spark.createDataFrame(out, "label bigint, dim bigint, value double").select(
        "label", "dim", F.round("value", 6).alias("value"), F.round(F.lit(loss), 6).alias("loss"))


@query("cls_softmax_fit")
def cls_softmax_fit(spark, sf):
    """Fitted on the vectors of four fifths of the cells, applied to all of them."""
    e = Inputs(spark, sf).logits
    model = K.fit_softmax(e.where(F.col("cell") % 5 != 0), "label", "embedding")
    scored = K.score_softmax(e, model, "embedding")
    return scored.select("vec_id", "label", (F.col("cell") % 5 == 0).alias("held_out"), "pred", F.round("p_max", 4).alias("p_max"))
