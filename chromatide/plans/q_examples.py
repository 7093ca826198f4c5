"""Registered queries: prompts, prompt mixing, packing, padding, unpad/repad, nested examples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chromatide.functions import prompts as P
from chromatide.functions.labels import strip_numbers
from chromatide.functions.seeded import sql_seeded_hash
from chromatide.operators import examples as X
from chromatide.operators import sentences as S
from chromatide.functions.letters import number_lists_md5, number_text
from chromatide.operators.common import arr_text
from chromatide.operators.labels import add_class_id, class_ids_from_labels
from chromatide.operators.matrix import topk
from chromatide.operators.sequences import char_ids, window_fixed, window_variable
from chromatide.plans import q_sequences as QS
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

SEED = 11
GENES = 100        # gene_length: names per prompt
K_SEQ = 100        # sequences per example (dataset config)
BATCH = 24         # classifier batch size
UNPAD_BATCH = 8

STRIP = "regexp_replace(regexp_replace({c}, '\\b\\d+\\b', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _arr(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _pick_sql(xs, salt, key):
    return f"{_arr(xs)}[{sql_seeded_hash(f'{SEED}:{salt}', key)} % {len(xs)} + 1]"


def gen_sql(ct_expr, key, noun="genes"):
    s = STRIP.format(c=ct_expr)
    art = f"CASE WHEN regexp_matches({s}, '^[aeiouAEIOU]') THEN 'n ' || {s} ELSE ' ' || {s} END"
    return f"replace({_pick_sql(P.for_noun(P.CELL_TYPE_TEMPLATES, noun), 'gen', key)}, '{{}}', {art})"


def pred_sql(genes, key):
    return (f"{_pick_sql(P.INSTRUCTIONS, 'ins', key)} || ' ' || {genes} || ' ' || "
            f"{_pick_sql(P.ANSWER_LEADS, 'ans', key)}")


EXPL = "SELECT cell, unnest(tokens) AS feature_idx, unnest(range(0, len(tokens))) AS pos FROM sentences"
GENES_SQL = f"""SELECT x.cell, string_agg(f.feature, ' ' ORDER BY x.pos) AS genes FROM ({EXPL}) x
JOIN features f ON f.feature_idx = x.feature_idx WHERE x.pos < {GENES} GROUP BY x.cell"""
VOCAB_SQL = "SELECT word, row_number() OVER (ORDER BY word) + 2 AS word_id FROM (SELECT DISTINCT word FROM vocab_words)"


def ids_sql(src: str, key: str, text: str) -> str:
    """DuckDB word ids of ``text`` per ``key`` (same rule as ``examples.word_ids``)."""
    return f"""SELECT s.{key}, COALESCE(i.ids, []::BIGINT[]) AS ids FROM ({src}) s LEFT JOIN (
  SELECT {key}, list(COALESCE(v.word_id, 2) ORDER BY p) AS ids FROM (
    SELECT {key}, unnest(string_split({text}, ' ')) AS w, unnest(range(0, len(string_split({text}, ' ')))) AS p FROM ({src})
    WHERE {text} IS NOT NULL) t LEFT JOIN ({VOCAB_SQL}) v ON v.word = upper(regexp_replace(t.w, '[^A-Za-z]', '', 'g'))
  GROUP BY {key}) i ON i.{key} = s.{key}"""


def genes(i: Inputs):
    names = S.with_names(S.prefix(i.sentences, GENES), i.features)
    return names.groupBy("cell").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "feature"))),
                                                              lambda s: s["feature"]), " ").alias("genes"))


@query("article_prompt", views=("cells",), sql=f"SELECT cell, {gen_sql('cell_type', 'cell')} AS prompt FROM cells")
def article_prompt(spark, sf):
    return Inputs(spark, sf).cells.select("cell", P.generation_prompt("cell_type", SEED, "cell").alias("prompt"))


@query("prediction_prompt", views=("sentences", "features"),
       sql=f"SELECT cell, {pred_sql('genes', 'cell')} AS prompt FROM ({GENES_SQL})")
def prediction_prompt(spark, sf):
    return genes(Inputs(spark, sf)).select("cell", P.prediction_prompt("genes", SEED, "cell").alias("prompt"))


PARTS_SQL = (f"SELECT cell, {_pick_sql(P.for_noun(P.INSTRUCTIONS, P.SEQ_NOUN), 'ins', 'cell')} || ' ' AS prefix, "
             f"' ' || {_pick_sql(P.for_noun(P.ANSWER_LEADS, P.SEQ_NOUN), 'ans', 'cell')} AS suffix FROM cells")


@query("prompt_prefix_suffix", views=("cells",), sql=PARTS_SQL)
def prompt_prefix_suffix(spark, sf):
    pre, suf = P.prompt_parts(SEED, "cell")
    return Inputs(spark, sf).cells.select("cell", pre.alias("prefix"), suf.alias("suffix"))


MIX_SQL = f"""SELECT c.cell, CAST({sql_seeded_hash(f'{SEED}:task', 'c.cell')} % 3 AS INTEGER) AS task,
  CASE CAST({sql_seeded_hash(f'{SEED}:task', 'c.cell')} % 3 AS INTEGER) WHEN 0 THEN {gen_sql('c.cell_type', 'c.cell')}
    WHEN 1 THEN {gen_sql("'PBMC'", 'c.cell')} ELSE {pred_sql('g.genes', 'c.cell')} END AS question,
  CASE WHEN CAST({sql_seeded_hash(f'{SEED}:task', 'c.cell')} % 3 AS INTEGER) = 2 THEN {STRIP.format(c='c.cell_type')}
    ELSE g.genes END AS answer
FROM cells c JOIN ({GENES_SQL}) g ON g.cell = c.cell"""


def mixed(i: Inputs):
    df = i.cells.join(genes(i), "cell")
    return X.prompt_mix(df, "cell_type", "genes", SEED, "cell").select("cell", "task", "question", "answer")


@query("seq_prompt_mix", views=("cells", "sentences", "features"), sql=MIX_SQL)
def seq_prompt_mix(spark, sf):
    return mixed(Inputs(spark, sf))


CAUSAL_SQL = f"""WITH m AS ({MIX_SQL}), q AS ({ids_sql('SELECT * FROM m', 'cell', 'question')}),
 a AS ({ids_sql('SELECT * FROM m', 'cell', 'answer')}),
 p AS (SELECT q.cell, list_concat(q.ids, a.ids, [1]) AS input_ids,
         list_concat(list_resize([]::BIGINT[], len(q.ids), -100), a.ids, [1]) AS labels FROM q JOIN a USING (cell))"""


def causal(i: Inputs):
    m = mixed(i)
    v = X.word_vocab(i.vocab_words)
    m = X.word_ids(m, "question", v, ["cell"], "q_ids")
    m = X.word_ids(m, "answer", v, ["cell"], "a_ids")
    return m.select("cell", X.pack_causal(F.col("q_ids"), F.col("a_ids")).alias("e")).select("cell", "e.*")


@query("seq_pack_causal", views=("cells", "sentences", "features", "vocab_words"), sql=f"""{CAUSAL_SQL}
SELECT cell, array_to_string(input_ids, ',') AS input_ids, array_to_string(labels, ',') AS labels,
  len(input_ids) AS n_attended FROM p""")
def seq_pack_causal(spark, sf):
    p = causal(Inputs(spark, sf))
    return p.select("cell", arr_text("input_ids").alias("input_ids"), arr_text("labels").alias("labels"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"))


PADDED_SQL = f"""{CAUSAL_SQL},
 b AS (SELECT *, (row_number() OVER (ORDER BY cell) - 1) // {BATCH} AS batch FROM p),
 m2 AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY batch) AS max_len FROM b)"""


@query("seq_left_pad_batch", views=("cells", "sentences", "features", "vocab_words"), sql=f"""{PADDED_SQL}
SELECT cell, batch, max_len,
  array_to_string(list_concat(list_resize([]::BIGINT[], max_len - len(input_ids), 0), input_ids), ',') AS input_ids,
  array_to_string(list_concat(list_resize([]::INT[], max_len - len(input_ids), 0), list_resize([]::INT[], len(input_ids), 1)), ',') AS attention_mask,
  array_to_string(list_concat(list_resize([]::BIGINT[], max_len - len(input_ids), -100), labels), ',') AS labels FROM m2""")
def seq_left_pad_batch(spark, sf):
    p = X.batches(causal(Inputs(spark, sf)), "cell", BATCH)
    out = X.left_pad(p.drop("row_in_batch"), "batch", None)
    return out.select("cell", "batch", "max_len", arr_text("input_ids").alias("input_ids"),
                      arr_text("attention_mask").alias("attention_mask"), arr_text("labels").alias("labels"))


@query("agg_max_length", views=("cells", "sentences", "features", "vocab_words"),
       sql=f"{PADDED_SQL} SELECT DISTINCT batch, max_len FROM m2")
def agg_max_length(spark, sf):
    p = X.batches(causal(Inputs(spark, sf)), "cell", BATCH)
    return X.max_len(p, "input_ids").select("batch", "max_len").distinct()


SLOTS_SQL = f"""WITH pp AS ({PARTS_SQL}), t AS (SELECT cell, {STRIP.format(c='cell_type')} AS target FROM cells),
 pi AS ({ids_sql('SELECT * FROM pp', 'cell', 'prefix')}), si AS ({ids_sql('SELECT * FROM pp', 'cell', 'suffix')}),
 ti AS ({ids_sql('SELECT * FROM t', 'cell', 'target')}),
 z AS (SELECT pi.cell, pi.ids[1:len(pi.ids) - 1] AS pre, si.ids[1:len(si.ids) - 1] AS suf, list_concat(ti.ids, [1]) AS tgt
       FROM pi JOIN si USING (cell) JOIN ti USING (cell)),
 s AS (SELECT cell, list_concat(pre, list_resize([]::BIGINT[], {K_SEQ}, 1), suf, tgt) AS input_ids,
         list_concat(list_resize([]::BIGINT[], len(pre) + {K_SEQ} + len(suf), -100), tgt) AS target_ids, len(pre) AS start_index_of_seq FROM z)"""


def slots(i: Inputs):
    pre, suf = P.prompt_parts(SEED, "cell")
    v = X.word_vocab(i.vocab_words)
    df = i.cells.select("cell", pre.alias("prefix"), suf.alias("suffix"), strip_numbers("cell_type").alias("target"))
    for c in ["prefix", "suffix", "target"]:
        df = X.word_ids(df, c, v, ["cell"], f"{c}_ids")
    return df.select("cell", X.pack_slots(F.col("prefix_ids"), F.col("suffix_ids"), F.col("target_ids"), K_SEQ).alias("e")) \
        .select("cell", "e.*")


@query("seq_pack_slots", views=("cells", "vocab_words"), sql=f"""{SLOTS_SQL}
SELECT cell, array_to_string(input_ids, ',') AS input_ids, array_to_string(target_ids, ',') AS target_ids, start_index_of_seq FROM s""")
def seq_pack_slots(spark, sf):
    s = slots(Inputs(spark, sf))
    return s.select("cell", arr_text("input_ids").alias("input_ids"), arr_text("target_ids").alias("target_ids"),
                    "start_index_of_seq")


# ---- nested sequence examples --------------------------------------------------------

def cell_windows(i: Inputs):
    """(cell, rank, window) for each cell's top-K regions: the bases of the val window (Q01)."""
    orders = topk(i.counts, K_SEQ).select("cell", "rank", F.col("feature_idx").alias("region_id"))
    w = window_fixed(i.regions, QS.chunks(i), QS.L, size=QS.CHUNK)
    return orders.join(w.select("region_id", "window"), "region_id").select("cell", "rank", "window")


TOK = QS.TOK_SQL.format(c="w")
SEQS_SQL = f"""WITH o AS (SELECT * FROM (SELECT cell, feature_idx AS region_id,
   row_number() OVER (PARTITION BY cell ORDER BY n DESC, feature_idx) AS rank FROM counts WHERE n <> 0) WHERE rank <= {K_SEQ}),
 w AS (SELECT r.region_id, rpad(COALESCE(substr(c.seq, r.start_pos + 1, least(r.end_pos - r.start_pos, {QS.L})), ''), {QS.L}, 'N') AS w
       FROM regions r LEFT JOIN contigs c ON c.contig = r.contig),
 sq AS (SELECT o.cell, o.rank, list_concat([0], {TOK}, [1]) AS ids FROM o JOIN w USING (region_id)),
 nest AS (SELECT cell, COUNT(*) AS n_seqs, md5(string_agg(array_to_string(ids, ','), '|' ORDER BY rank)) AS seqs_md5
          FROM sq GROUP BY cell)"""


def nested(i: Inputs):
    return X.stack_windows(cell_windows(i), "cell", then=(number_lists_md5, T.StringType())) \
        .withColumnRenamed("input_ids_of_seqs", "seqs_md5")


@query("agg_sequences_per_cell", views=("counts", "regions", "contigs"), sql=f"{SEQS_SQL} SELECT * FROM nest")
def agg_sequences_per_cell(spark, sf):
    return nested(Inputs(spark, sf))


@query("seq_example_cls", views=("counts", "regions", "contigs", "cells"), sql=f"""{SEQS_SQL},
 ids AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_id FROM
   (SELECT DISTINCT cell_type AS label FROM cells WHERE cell_type IS NOT NULL))
SELECT c.cell, ids.class_id, nest.n_seqs, nest.seqs_md5 FROM cells c JOIN ids ON ids.label = c.cell_type
JOIN nest ON nest.cell = c.cell""")
def seq_example_cls(spark, sf):
    i = Inputs(spark, sf)
    lab = i.cells.where(F.col("cell_type").isNotNull()).select("cell", "cell_type")
    ex = add_class_id(lab, class_ids_from_labels(lab), "cell_type")
    return ex.join(nested(i), "cell").select("cell", "class_id", "n_seqs", "seqs_md5")


@query("seq_example_llm", views=("counts", "regions", "contigs", "cells", "vocab_words"), sql=f"""{SEQS_SQL},
 sl AS (SELECT * FROM ({SLOTS_SQL} SELECT * FROM s))
SELECT sl.cell, array_to_string(sl.input_ids, ',') AS input_ids, array_to_string(sl.target_ids, ',') AS target_ids,
  sl.start_index_of_seq, nest.n_seqs, nest.seqs_md5 FROM sl JOIN nest USING (cell)""")
def seq_example_llm(spark, sf):
    i = Inputs(spark, sf)
    s = slots(i)
    return s.join(nested(i), "cell").select("cell", arr_text("input_ids").alias("input_ids"),
                                            arr_text("target_ids").alias("target_ids"), "start_index_of_seq",
                                            "n_seqs", "seqs_md5")


# ---- unpad / repad / offsets over variable-length windows ----------------------------

VAR_SQL = QS._random_sql(f"({QS.VAR_LO} + {sql_seeded_hash(f'{QS.SEED}:len', 'region_id')} % {QS.VAR_HI - QS.VAR_LO + 1})", QS.SEED)
VT_SQL = f"""WITH vw AS ({VAR_SQL}),
 vt AS (SELECT region_id, {QS.TOK_SQL.format(c='"window"')} AS ids, (row_number() OVER (ORDER BY region_id) - 1) // {UNPAD_BATCH} AS batch,
        CAST((row_number() OVER (ORDER BY region_id) - 1) % {UNPAD_BATCH} AS INTEGER) AS row_in_batch FROM vw),
 vm AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS max_len FROM vt)"""


def var_tokens(i: Inputs):
    w = window_variable(i.regions, QS.chunks(i), QS.VAR_LO, QS.VAR_HI, QS.SEED, size=QS.CHUNK)
    t = w.select("region_id", char_ids("window").cast("array<bigint>").alias("ids"))
    return X.batches(t, "region_id", UNPAD_BATCH)


@query("win_cu_seqlens", views=("regions", "contigs"), sql=f"""{VT_SQL}
SELECT batch, region_id, CAST(SUM(len(ids)) OVER (PARTITION BY batch ORDER BY row_in_batch ROWS UNBOUNDED PRECEDING) - len(ids) AS BIGINT) AS seq_start,
  CAST(SUM(len(ids)) OVER (PARTITION BY batch ORDER BY row_in_batch ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seq_end FROM vt""")
def win_cu_seqlens(spark, sf):
    return X.cu_seqlens(var_tokens(Inputs(spark, sf)), "ids").select("batch", "region_id", "seq_start", "seq_end")


@query("seq_unpad", views=("regions", "contigs"), sql=f"""{VT_SQL}
SELECT batch, region_id, pos, token, row_in_batch * max_len + pos AS flat_index FROM (
  SELECT batch, region_id, row_in_batch, max_len, unnest(ids) AS token, unnest(range(0, len(ids))) AS pos FROM vm)""")
def seq_unpad(spark, sf):
    return X.unpad(var_tokens(Inputs(spark, sf)), "ids", "region_id")


@query("seq_repad", views=("regions", "contigs"), sql=f"""{VT_SQL}
SELECT batch, region_id, array_to_string(list_concat(ids, list_resize([]::BIGINT[], max_len - len(ids), 0)), ',') AS ids FROM vm""")
def seq_repad(spark, sf):
    flat = X.unpad(var_tokens(Inputs(spark, sf)), "ids", "region_id")
    return X.repad(flat, "region_id").select("batch", "region_id", number_text("ids").alias("ids"))
