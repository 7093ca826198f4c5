"""Cell sentences: ranked feature lists per cell and what is computed on them.

A sentence is ``(cell, tokens ARRAY<BIGINT>)`` of feature indices, most
expressed first.  Work is per cell (one row, bounded by the features a cell
has) or per feature after a ``posexplode``; vocabularies are joined, not
collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromatide.functions.letters import code_point_bytes
from chromatide.functions.seeded import seeded_hash
from chromatide.operators.common import global_position, materialize

# Fixed value: marker for generated names outside the dictionary.
NONSENSE = "NOT_A_GENE"
CHAR_BASE = 19968  # first code point used for one-character feature codes
SURROGATES, SURROGATE_COUNT, LAST_CODE_POINT = 0xD800, 0x800, 0x10FFFF


def sentences(counts: DataFrame, seed: int = 42, cell: str = "cell", feature: str = "feature_idx",
              value: str = "n") -> DataFrame:
    """Nonzero features per cell by value desc; ties in a seeded order."""
    key = F.struct((-F.col(value)).alias("v"), seeded_hash(seed, cell, feature).alias("t"), F.col(feature).alias("f"))
    return (counts.where(F.col(value) != 0).groupBy(cell)
            .agg(F.sort_array(F.collect_list(key)).alias("_k"))
            .select(cell, F.transform("_k", lambda s: s["f"]).alias("tokens")))


def prefix(df: DataFrame, n: int, col: str = "tokens") -> DataFrame:
    """first n tokens."""
    return df.withColumn(col, F.slice(col, 1, n))


def exploded(sent: DataFrame, col: str = "tokens") -> DataFrame:
    """(cell, pos 0-based, feature_idx, slen)."""
    return sent.select("cell", F.size(col).alias("slen"), F.posexplode(col).alias("pos", "feature_idx"))


def rank_matrix(sent: DataFrame) -> DataFrame:
    """score = sentence length - 0-based position; absent features are implicit zeros."""
    x = exploded(sent)
    return x.select("cell", "feature_idx", (F.col("slen") - F.col("pos")).cast("bigint").alias("score"))


def feature_rank(sent: DataFrame, feature_idx: int, invert: bool = False) -> DataFrame:
    """1-based rank of one feature per cell (NULL if absent); ``invert`` gives len - position."""
    p = F.array_position("tokens", F.lit(feature_idx))
    r = (F.size("tokens") - p + 1) if invert else p
    return sent.select("cell", F.when(p > 0, r).cast("double").alias("rank"))


def symbols(col) -> Column:
    """Feature indices as a string with one character per feature.

    Code points from 19968 on, the surrogate range left out, so all planes are
    used: 1,092,096 features. A larger index raises an error instead of sharing
    a character with another feature.
    """
    c = F.col(col) if isinstance(col, str) else col

    def char(x):
        code = x + CHAR_BASE + F.when(x + CHAR_BASE >= SURROGATES, SURROGATE_COUNT).otherwise(0)
        code = F.when(code <= LAST_CODE_POINT, code).otherwise(F.raise_error(F.lit("feature index above 1092095")).cast("int"))
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.array_join(F.transform(c, char), "")


def symbol_bytes(col) -> Column:
    """The bytes of :func:`symbols` in UTF-8, which go on by the same rule for features beyond the last code point: any index has bytes of its own."""
    c = F.col(col) if isinstance(col, str) else col

    def code(x):
        return x.cast("bigint") + CHAR_BASE + F.when(x + CHAR_BASE >= SURROGATES, SURROGATE_COUNT).otherwise(0)
    return code_point_bytes(F.transform(c, code))


def with_names(sent: DataFrame, vocab: DataFrame, col: str = "tokens") -> DataFrame:
    """(cell, pos, feature) with names from the vocabulary (a join, not a collected map)."""
    return exploded(sent, col).join(vocab.select("feature_idx", "feature"), "feature_idx")


def check_delim(vocab: DataFrame, delim: str) -> DataFrame:
    """Feature names holding the delimiter (empty when the delimiter is safe)."""
    return vocab.where(F.instr(F.col("feature"), delim) > 0)


def sentence_lists(sent: DataFrame, vocab: DataFrame) -> DataFrame:
    """Names in sentence order."""
    named = with_names(sent, vocab)
    return named.groupBy("cell").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "feature"))), lambda s: s["feature"]).alias("names"))


def sentence_strings(sent: DataFrame, vocab: DataFrame, delim: str = " ", check: bool = True) -> DataFrame:
    """Names joined by ``delim``; fails when a name holds the delimiter."""
    if check and check_delim(vocab, delim).limit(1).count():
        raise ValueError(f"feature names contain the delimiter {delim!r}")
    return sentence_lists(sent, vocab).select("cell", F.array_join("names", delim).alias("sentence"))


def rank_to_value(rank, slope: float, intercept: float) -> Column:
    """Intercept + slope * log10(1 + rank), rank 0-based."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.lit(intercept) + F.lit(slope) * F.log10(F.lit(1) + r)


def min_pct_features(sent: DataFrame, min_pct: float = 0.1) -> DataFrame:
    """features present in strictly more than ``min_pct`` of all cells."""
    n_cells = sent.count()
    pres = exploded(sent).groupBy("feature_idx").agg(F.countDistinct("cell").alias("n_present"))
    return pres.where(F.col("n_present") > F.lit(min_pct * n_cells))


def group_mean_rank(rm: DataFrame, group1: DataFrame, group2: DataFrame, features: DataFrame) -> DataFrame:
    """Mean score per feature in each of two groups, absent cells counted as 0.

    Group sizes come from the group tables, so zeros are never materialised;
    features with no entry in a group get mean 0.
    """
    n1, n2 = group1.count(), group2.count()
    g = group1.select("cell", F.lit(1).alias("grp")).unionByName(group2.select("cell", F.lit(2).alias("grp")))
    sums = (rm.join(g, "cell").groupBy("feature_idx")
            .agg(F.sum(F.when(F.col("grp") == 1, F.col("score")).otherwise(0)).alias("_s1"),
                 F.sum(F.when(F.col("grp") == 2, F.col("score")).otherwise(0)).alias("_s2")))
    out = features.select("feature_idx").join(sums, "feature_idx", "left").fillna(0, ["_s1", "_s2"])
    return out.select("feature_idx", (F.col("_s1") / F.lit(n1)).alias("mean_rank_group_1"),
                      (F.col("_s2") / F.lit(n2)).alias("mean_rank_group_2"))


def midrank_table(rm: DataFrame, n_cells: int, features: DataFrame | None = None, counts: str | None = None) -> DataFrame:
    """Mid-rank of every (feature, score) value over ``n_cells`` cells, absent cells scoring 0.

    Built from counts per (feature, score) - never from a window over one
    feature's cells, so a feature present in most cells is not one task.  The
    cells below a score come from a distributed running sum; absent cells form
    the lowest block: z = n_cells - nnz cells with mid-rank (z + 1) / 2.
    ``counts`` names a precomputed count column (else rows are counted).
    """
    from chromatide.operators.common import running_sum
    x = rm if features is None else rm.join(features.select("feature_idx"), "feature_idx", "left_semi")
    per = x if counts else x.groupBy("feature_idx", "score").agg(F.count(F.lit(1)).alias("_k"))
    k = counts or "_k"
    cum = running_sum(per, ["feature_idx"], "score", k, "_less", exclusive=True)
    nnz = per.groupBy("feature_idx").agg(F.sum(k).alias("_nnz"))
    z = F.lit(n_cells) - F.col("_nnz")
    return cum.join(nnz, "feature_idx").select(
        "*", (z + F.col("_less") + (F.col(k) + 1) / 2.0).alias("midrank"),
        ((z + 1) / 2.0).alias("zero_midrank"), z.cast("bigint").alias("n_zero")).drop("_less", "_nnz")


def midranks(rm: DataFrame, n_cells: int, features: DataFrame | None = None) -> DataFrame:
    """Mid-ranks (ties averaged) of each feature's scores over all cells.

    Output rows are the present entries with their mid-rank, the feature's
    ``zero_midrank`` and ``n_zero`` (from :func:`midrank_table`).
    """
    x = rm if features is None else rm.join(features.select("feature_idx"), "feature_idx", "left_semi")
    t = midrank_table(x, n_cells).select("feature_idx", "score", "midrank", "zero_midrank", "n_zero")
    return x.select("cell", "feature_idx", "score").join(t, ["feature_idx", "score"])


def rank_sum_test(rm: DataFrame, group1: DataFrame, group2: DataFrame, min_pct: float = 0.1,
                  sent: DataFrame | None = None) -> DataFrame:
    """Wilcoxon rank-sum z per feature between two cell groups (no tie correction).

    Features tested: present in more than ``min_pct`` of all cells.  Ranks are
    over the cells of both groups.  Everything comes from counts per
    (feature, score, group): the rank sum of group 1 is the sum of count x
    mid-rank plus its absent cells at the zero block's mid-rank.  Also the mean
    score per group (zeros counted) and the two-sided p-value (:func:`with_pvalue`).
    """
    g = group1.select("cell", F.lit(1).alias("grp")).unionByName(group2.select("cell", F.lit(2).alias("grp")))
    universe = rm.select("cell").distinct() if sent is None else sent.select("cell")
    # one job for the three sizes
    row = universe.join(g, "cell", "full").agg(
        F.count(F.when(F.col("grp") == 1, 1)).alias("n1"), F.count(F.when(F.col("grp") == 2, 1)).alias("n2"),
        F.countDistinct("cell").alias("n_all")).first()
    n1, n2, all_cells = int(row["n1"]), int(row["n2"]), int(row["n_all"])
    n = n1 + n2
    pres = rm.groupBy("feature_idx").agg(F.count(F.lit(1)).alias("_np"))
    feats = pres.where(F.col("_np") > F.lit(min_pct * all_cells)).select("feature_idx")
    per = (rm.join(feats, "feature_idx", "left_semi").join(g, "cell")
           .groupBy("feature_idx", "score")
           .agg(F.count(F.when(F.col("grp") == 1, 1)).alias("_k1"), F.count(F.lit(1)).alias("_k")))
    mr = midrank_table(per, n, counts="_k")
    agg = mr.groupBy("feature_idx").agg(
        F.sum(F.col("_k1") * F.col("midrank")).alias("_r1p"), F.sum("_k1").alias("_c1"),
        F.sum(F.col("_k1") * F.col("score")).alias("_s1"),
        F.sum((F.col("_k") - F.col("_k1")) * F.col("score")).alias("_s2"),
        F.max("zero_midrank").alias("_zm"))
    agg = feats.join(agg, "feature_idx", "left").fillna(0, ["_r1p", "_c1", "_s1", "_s2"]) \
        .withColumn("_zm", F.coalesce("_zm", F.lit((n + 1) / 2.0)))
    r1 = F.col("_r1p") + (F.lit(n1) - F.col("_c1")) * F.col("_zm")
    z = (r1 - F.lit(n1 * (n + 1) / 2.0)) / F.lit((n1 * n2 * (n + 1) / 12.0) ** 0.5)
    out = agg.select("feature_idx", r1.alias("rank_sum_1"), z.alias("w_stat"),
                     (F.col("_s1") / F.lit(n1)).alias("mean_rank_group_1"),
                     (F.col("_s2") / F.lit(n2)).alias("mean_rank_group_2"))
    return with_pvalue(out)


# Coefficients of the published Chebyshev fit of the complementary error function
# (relative error below 1.2e-7 for every argument), lowest power first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function of a number >= 0; relative error below 1.2e-7."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


def with_pvalue(df: DataFrame, z: str = "w_stat") -> DataFrame:
    """Two-sided normal p-value erfc(|z| / sqrt(2)) as a built-in expression; a null or NaN z keeps its kind."""
    return df.withColumn("p_val", erfc(F.abs(F.col(z)) / 2 ** 0.5))


def word_tokens(col) -> Column:
    """Split on single blanks, upper-case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(F.split(c, " "), lambda x: F.upper(x))


def mark_nonsense(df: DataFrame, vocab_words: DataFrame, id_cols: list[str], col: str = "tokens",
                  marker: str = NONSENSE) -> DataFrame:
    """Tokens outside the dictionary become the marker; ``n_replaced`` counts them.

    Tokens are exploded, left-joined to the dictionary (Catalyst broadcasts it
    when small) and gathered back in position order per row.
    """
    x = df.select(*id_cols, F.posexplode(col).alias("_pos", "_tok"))
    v = vocab_words.select(F.col("word").alias("_tok"), F.lit(True).alias("_in"))
    j = x.join(v, "_tok", "left")
    tok = F.when(F.col("_in"), F.col("_tok")).otherwise(F.lit(marker))
    back = j.groupBy(*id_cols).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", tok.alias("t")))), lambda s: s["t"]).alias(col),
        F.count(F.when(F.col("_in").isNull(), 1)).alias("n_replaced"))
    empty = df.where(F.size(col) == 0).select(*id_cols, F.col(col), F.lit(0).cast("bigint").alias("n_replaced"))
    return back.unionByName(empty)


def dedupe_average_position(col, exempt: str | None = None) -> Column:
    """Collapse each duplicated token to one copy at int(mean of its positions).

    Sequential, in first-occurrence order, with positions measured in the
    list as already shortened (higher-order ``aggregate`` over the duplicated
    tokens).  Inserting past the end appends.
    """
    c = F.col(col) if isinstance(col, str) else col
    dups = F.array_distinct(F.filter(c, lambda x: F.size(F.filter(c, lambda y: y == x)) > 1))
    if exempt is not None:
        dups = F.filter(dups, lambda x: x != F.lit(exempt))

    def step(acc, g):
        pos = F.filter(F.transform(acc, lambda x, i: F.when(x == g, i).otherwise(-1)), lambda p: p >= 0)
        avg = F.floor(F.aggregate(pos, F.lit(0).cast("bigint"), lambda a, p: a + p) / F.size(pos)).cast("int")
        rest = F.filter(acc, lambda x: x != g)
        return F.array_insert(rest, F.least(avg, F.size(rest)) + 1, g)

    return F.aggregate(dups, c, step)


def postprocess(df: DataFrame, vocab_words: DataFrame, id_cols: list[str], text: str = "sentence") -> DataFrame:
    """Upper-case tokens, mark nonsense, count, collapse duplicates (marker exempt)."""
    t = df.select(*id_cols, word_tokens(text).alias("tokens"))
    m = mark_nonsense(t, vocab_words, id_cols)
    return m.withColumn("tokens", dedupe_average_position("tokens", NONSENSE))


def reconstruct(names: DataFrame, dictionary: DataFrame, slope: float, intercept: float) -> DataFrame:
    """(cell, feature_idx, value) from a ranked name list; last duplicate wins; unknown skipped.

    ``names`` is (cell, pos 0-based, feature); ``dictionary`` is (feature_idx, feature).
    """
    j = names.join(dictionary.select("feature", "feature_idx"), "feature")
    v = rank_to_value(F.col("pos"), slope, intercept)
    return j.groupBy("cell", "feature_idx").agg(F.max_by(v, F.col("pos")).alias("value"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _filled(size: pa.Array, at: pa.Array, value: pa.Array) -> pa.Array:
    """Arrays of ``size`` zeros with ``value`` at the places ``at`` (null: none)."""
    sizes, filled = np.asarray(size), np.asarray(at.value_lengths().fill_null(0))
    ends = np.cumsum(sizes, dtype=np.int64)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0)
    flat[np.repeat(ends - sizes, filled) + np.asarray(at.flatten())] = np.asarray(value.flatten())
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(flat)).cast(pa.list_(pa.float64()))


#: Dictionary entries of one array of :func:`densify` by blocks.
DENSE_BLOCK = 2048


def densify(values: DataFrame, dictionary: DataFrame, cells: DataFrame, block: int | None = None, cells_per_part: int = 2000) -> DataFrame:
    """Dense vector per cell over the whole dictionary, 0 where absent (feature_idx order).

    With ``block``, rows (cell, block, ids, vector): the vector in parts of that
    many entries, beside their feature indices. Emits cells x dictionary entries
    by definition, but only the entries of ``values`` and one row for each cell
    and block are shuffled: the zeros are laid out where these meet the block's
    indices.
    """
    size = block or DENSE_BLOCK
    pos = global_position(dictionary.select("feature_idx"), [F.col("feature_idx")], "_slot", 0)
    pos = materialize(pos.select("feature_idx", F.floor(F.col("_slot") / size).cast("int").alias("block"), (F.col("_slot") % size).cast("int").alias("_at")))
    n_blocks = -(-pos.count() // size)
    cells = materialize(cells.select("cell").distinct())
    salts = max(1, -(-cells.count() // cells_per_part))
    n = max(1, min(n_blocks * salts, 8 * values.sparkSession.sparkContext.defaultParallelism + n_blocks * salts // 64))
    found = values.where(F.col("value").isNotNull() & ~F.isnan("value")).join(pos, "feature_idx").groupBy("cell", "block").agg(
        F.collect_list(F.struct("_at", F.col("value").cast("double").alias("value"))).alias("_has"))
    grid = cells.withColumn("block", F.explode(F.slice(F.sequence(F.lit(0), F.lit(n_blocks)), 1, n_blocks)))
    grid = grid.join(found, ["cell", "block"], "left").withColumn("_salt", F.pmod(F.xxhash64("cell"), F.lit(salts)))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_at", "feature_idx"))), lambda s: s["feature_idx"])
    lists = pos.groupBy("block").agg(ids.alias("ids")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    met = grid.repartition(n, "block", "_salt").join(lists.repartition(n, "block", "_salt").hint("merge"), ["block", "_salt"])
    parts = met.select("cell", "block", "ids", _filled(F.size("ids"), F.col("_has._at"), F.col("_has.value")).alias("vector"))
    if block:
        return parts
    return parts.groupBy("cell").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "vector"))), lambda s: s["vector"])).alias("vector"))


def feature_index(names: DataFrame, vocab: DataFrame) -> DataFrame:
    """Feature name -> 0-based position in the vocabulary; unknown names fail."""
    pos = global_position(vocab.select("feature_idx", "feature"), [F.col("feature_idx")], "vocab_index", 0)
    j = names.join(pos.select("feature", "vocab_index"), "feature", "left")
    err = F.raise_error(F.concat(F.lit("invalid feature not found in vocabulary: "), F.col("feature")))
    return j.withColumn("vocab_index", F.coalesce(F.col("vocab_index"), err.cast("bigint")))
