"""Registered queries: genome chunks, region fetch, windows, reverse complement, tokens."""

from __future__ import annotations


from chromatide.functions.letters import number_text
from chromatide.functions.seeded import sql_seeded_hash
from chromatide.operators import sequences as S
from chromatide.plans.fixtures import Inputs
from chromatide.plans.registry import query

CHUNK = 4096          # small chunks so fetches cross chunk borders at test scale
L = 1024              # bases per sequence (dataset config)
SEED = 7
VAR_LO, VAR_HI = 128, 1024

TOK_SQL = ("list_transform(string_split({c}, ''), lambda x: CASE x WHEN 'A' THEN 7 WHEN 'C' THEN 8 WHEN 'G' THEN 9 "
           "WHEN 'T' THEN 10 WHEN 'N' THEN 11 ELSE 6 END)")
DETOK_SQL = ("list_transform({a}, lambda x: ['[CLS]', '[SEP]', '[BOS]', '[MASK]', '[PAD]', '[RESERVED]', '[UNK]', "
             "'A', 'C', 'G', 'T', 'N'][x + 1])")


def chunks(i: Inputs):
    return S.chunk_contigs(i.contigs, CHUNK)


@query("join_region_sequence", views=("regions", "contigs"), sql="""
SELECT r.region_id, COALESCE(substr(c.seq, r.start_pos + 1, r.end_pos - r.start_pos), '') AS bases
FROM regions r LEFT JOIN contigs c ON c.contig = r.contig""")
def join_region_sequence(spark, sf):
    i = Inputs(spark, sf)
    r = i.regions.withColumnRenamed("start_pos", "fetch_start").withColumnRenamed("end_pos", "fetch_end")
    return S.fetch(r, chunks(i), "region_id", size=CHUNK)


@query("seq_window_fixed", views=("regions", "contigs"), sql=f"""
SELECT region_id, rpad(b, {L}, 'N') AS "window", length(b) < want AS truncated FROM (
  SELECT r.region_id, least(r.end_pos - r.start_pos, {L}) AS want,
         COALESCE(substr(c.seq, r.start_pos + 1, least(r.end_pos - r.start_pos, {L})), '') AS b
  FROM regions r LEFT JOIN contigs c ON c.contig = r.contig)""")
def seq_window_fixed(spark, sf):
    i = Inputs(spark, sf)
    return S.window_fixed(i.regions, chunks(i), L, size=CHUNK)


def _random_sql(length_sql: str, seed) -> str:
    h = sql_seeded_hash(seed, "region_id")
    return f"""WITH r0 AS (SELECT r.*, COALESCE(length(c.seq), 0) AS clen, c.seq, r.end_pos - r.start_pos AS ilen,
    {h} AS h, {length_sql} AS wl FROM regions r LEFT JOIN contigs c ON c.contig = r.contig),
 s AS (SELECT *, CASE WHEN ilen < wl THEN start_pos - (h % (wl - ilen + 1)) ELSE start_pos + h % (ilen - wl + 1) END AS s0 FROM r0),
 t AS (SELECT *, CASE WHEN ilen < wl AND s0 < 0 THEN -s0 ELSE 0 END AS lp,
                 CASE WHEN ilen < wl THEN greatest(s0, 0) ELSE s0 END AS s1 FROM s),
 u AS (SELECT *, s1 + wl - lp AS e1 FROM t),
 v AS (SELECT *, (s1 >= clen OR e1 <= 0) AS oor FROM u)
SELECT region_id, rpad(CASE WHEN oor THEN '' ELSE repeat('N', CAST(lp AS BIGINT)) || substr(seq, s1 + 1, least(e1, clen) - s1) END,
       CAST(wl AS INTEGER), 'N') AS "window", oor AS out_of_range FROM v"""


@query("seq_window_random", views=("regions", "contigs"), sql=_random_sql(str(L), SEED))
def seq_window_random(spark, sf):
    i = Inputs(spark, sf)
    return S.window_random(i.regions, chunks(i), L, SEED, size=CHUNK)


@query("seq_window_out_of_range", views=("regions", "contigs"),
       sql=f"SELECT * FROM ({_random_sql(str(L), SEED)}) WHERE out_of_range")
def seq_window_out_of_range(spark, sf):
    i = Inputs(spark, sf)
    return S.window_random(i.regions, chunks(i), L, SEED, size=CHUNK).where("out_of_range")


@query("seq_variable_length", views=("regions", "contigs"), sql=_random_sql(
    f"({VAR_LO} + {sql_seeded_hash(f'{SEED}:len', 'region_id')} % {VAR_HI - VAR_LO + 1})", SEED))
def seq_variable_length(spark, sf):
    i = Inputs(spark, sf)
    return S.window_variable(i.regions, chunks(i), VAR_LO, VAR_HI, SEED, size=CHUNK)


@query("seq_reverse_complement", views=("contigs",),
       sql="SELECT contig, translate(reverse(raw_seq), 'ACGTacgt', 'TGCAtgca') AS rc FROM contigs")
def seq_reverse_complement(spark, sf):
    return Inputs(spark, sf).contigs.select("contig", S.revcomp("raw_seq").alias("rc"))


@query("seq_rc_augment", views=("contigs",), sql=f"""
SELECT contig, {sql_seeded_hash(SEED, 'contig')} % 2 = 1 AS flipped,
       CASE WHEN {sql_seeded_hash(SEED, 'contig')} % 2 = 1 THEN translate(reverse(raw_seq), 'ACGTacgt', 'TGCAtgca')
       ELSE raw_seq END AS raw_seq FROM contigs""")
def seq_rc_augment(spark, sf):
    c = Inputs(spark, sf).contigs.select("contig", "raw_seq")
    return S.rc_augment(c, "raw_seq", SEED, "contig")


@query("seq_char_tokenize", views=("contigs",),
       sql=f"SELECT contig, array_to_string({TOK_SQL.format(c='raw_seq')}, ',') AS ids FROM contigs")
def seq_char_tokenize(spark, sf):
    return Inputs(spark, sf).contigs.select("contig", number_text(S.char_ids("raw_seq")).alias("ids"))


@query("seq_add_specials", views=("contigs",), sql=f"""
SELECT contig, array_to_string([0] || {TOK_SQL.format(c='seq')} || [1], ',') AS ids,
       array_to_string([0] || {TOK_SQL.format(c='seq')}, ',') AS ids_no_eos FROM contigs""")
def seq_add_specials(spark, sf):
    ids = S.char_ids("seq")
    return Inputs(spark, sf).contigs.select("contig", number_text(S.add_specials(ids, True)).alias("ids"),
                                            number_text(S.add_specials(ids, False)).alias("ids_no_eos"))


@query("seq_special_masks", views=("contigs",), sql=f"""
SELECT contig,
  array_to_string(list_resize([]::INT[], length(seq), 0) || [1] || list_resize([]::INT[], length(raw_seq), 0) || [1], ',') AS special_mask,
  array_to_string(list_resize([]::INT[], length(seq) + 2, 0) || list_resize([]::INT[], length(raw_seq) + 1, 1), ',') AS type_ids
FROM contigs""")
def seq_special_masks(spark, sf):
    c = Inputs(spark, sf).contigs
    a, b = S.char_ids("seq", short=True), S.char_ids("raw_seq", short=True)
    return c.select("contig", number_text(S.special_mask(a, b)).alias("special_mask"),
                    number_text(S.type_ids(a, b)).alias("type_ids"))


@query("seq_detokenize", views=("contigs",), sql=f"""
SELECT contig, array_to_string({DETOK_SQL.format(a='[0] || ' + TOK_SQL.format(c='raw_seq') + ' || [1]')}, '') AS text FROM contigs""")
def seq_detokenize(spark, sf):
    ids = S.add_specials(S.char_ids("raw_seq"), True)
    return Inputs(spark, sf).contigs.select("contig", S.detokenize(ids).alias("text"))


@query("seq_replace_n", views=("contigs",), sql=f"""
SELECT contig, array_to_string(list_transform({TOK_SQL.format(c='seq')}, lambda x: CASE WHEN x = 11 THEN 4 ELSE x END), ',') AS ids
FROM contigs""")
def seq_replace_n(spark, sf):
    return Inputs(spark, sf).contigs.select("contig", number_text(S.replace_n(S.char_ids("seq"))).alias("ids"))
