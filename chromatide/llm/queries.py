"""Registered queries of the operators: thin digests of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS, SHARD_SEED = 16, 10


@query("op10_feistel_shards")
def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``.

    That law spreads every document alone, so equal texts are not kept in one
    shard; ``grown_shard`` belongs to the law ``key`` and is null.
    """
    from .feistel import feistel_shards
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return (feistel_shards(docs, ["doc_id", "size", "text_crc32"], SHARDS, SHARD_SEED)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


# Fixed by the contract of the query: (host, path, verdict).
URL_BASE = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
            ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# The method's own rules, over the canonical form; they decide where no base rule fits.
URL_GLOBS = ("*cheap-pills*^*", "*spam-*^*", "*casino*^*", "*.xxx^*", "*^*/login*", "*^*.exe")


def _like(glob: str) -> str:
    host, path = glob.split("^")
    return f"('.' || host LIKE '{host.replace('*', '%')}' AND path LIKE '{path.replace('*', '%')}')"


def _url_sql() -> str:
    rules = sorted(URL_BASE, key=lambda r: -len(r[0] + r[1]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for h, p, v in rules]
    rule = "".join(f" WHEN {c} THEN '{n}'" for c, n, _ in fits)
    verdict = "".join(f" WHEN {c} THEN '{v}'" for c, _, v in fits)
    block = " OR ".join(_like(g) for g in URL_GLOBS)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE coalesce(rest, '') END AS raw_host,
  CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM r),
u AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h)
SELECT page_id, host, path, CASE{rule} END AS rule, CASE{verdict} WHEN {block} THEN 'block' ELSE 'allow' END AS verdict FROM u"""


@query("op8_url_shift_and", _url_sql())
def op8_url_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL: the longest base rule, else the method's globs, else allow."""
    from .urlglob import Rule, host_path_rule, judge_urls
    base = [host_path_rule(h, p, v) for h, p, v in URL_BASE]
    rules = base + [Rule(g, g, "block", rank=-1) for g in URL_GLOBS]
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    named = F.col("rule").isin([r.name for r in base])
    return judged.select("page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict")


@query("op9_secret_trigrams")
def op9_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document, with a digest of the base spans and the list of all spans."""
    from .secret_scan import BASE_RULES, find_secrets
    base = [r.kind for r in BASE_RULES]
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kinds):
        return F.filter("secret_spans", lambda s: s["kind"].isin(kinds))

    return found.select("doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(joined(of(base)), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


@query("op6_simhash_golay")
def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash component of every document: 4-word shingles, at most 4 differing bits."""
    from .simhash import simhash_components
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_pack_islands")
def op7_pack_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers
    from .packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


@query("op5_ppm_language")
def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    from .ppm import crc32_of_id, identify, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_of_id("doc_id") % 5 == 0
    model = train(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


#: A document is rejected from this probability of being bad.
REJECT_FROM = 0.5


@query("op4_cotrain_quality")
def op4_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being bad (toxic or of low quality) by both views, and the verdict."""
    from .cotrain import score, train
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return (score(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
            .select("doc_id", "text_score", "page_score", "score", (F.col("score") < REJECT_FROM).alias("kept")))


@query("op3_positional_index")
def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a 10-word window of a benchmark item."""
    from .posindex import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query("op2_mcd_outliers")
def op2_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of base rule and robust distance."""
    from .outliers import judge
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


_LM_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT r, i, ws[i] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
u0 AS (SELECT w, count(*) AS n FROM p GROUP BY w),
t AS (SELECT sum(n) AS total FROM u0),
k AS (SELECT p.r, p.i, p.w FROM p),
u AS (SELECT w, count(*) AS n FROM k GROUP BY w),
b AS (SELECT k.r, k.i, k.w, lag(k.w) OVER (PARTITION BY k.r ORDER BY k.i) AS v FROM k),
c AS (SELECT v, w, count(*) AS n FROM b WHERE v IS NOT NULL GROUP BY v, w),
s AS (SELECT b.r, CASE WHEN b.v IS NULL THEN 0 WHEN c.n >= 2 THEN 1 ELSE 0 END AS seen,
  CASE WHEN b.v IS NULL THEN ln(uw.n / t.total) WHEN c.n >= 2 THEN ln(c.n / uv.n) ELSE ln(0.4 * uw.n / t.total) END AS x
  FROM b JOIN u uw ON uw.w = b.w LEFT JOIN u uv ON uv.w = b.v LEFT JOIN c ON c.v = b.v AND c.w = b.w, t)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(s.seen), 0) AS BIGINT) AS n_seen,
  round(sum(s.x) / len(d.ws), 6) AS mean_log_score
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id, d.ws"""


@query("op1_stupid_backoff", _LM_SQL)
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log score of a word, for every document under the counts of all documents."""
    from .lm_score import score_documents
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "n_seen", F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))


@query("op11_piece_rounds")
def op11_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text with an end id, and the text they decode to, as digests."""
    import public_tokenizers
    from .pieces import decode_ids, encode_texts
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model, end_id=2).select("doc_id", "ids")
    return decode_ids(encoded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


_BOND_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
  list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT DISTINCT * FROM r WHERE vec_id % 100 = 0) a, r WHERE a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS slot FROM s WHERE same),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.slot ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score WHERE p.slot <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@query("op12_bond_negatives", _BOND_SQL)
def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, within 0.3 to 0.9 of its first five positives' scores."""
    from .bond import hard_negatives, quantized
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives(rows, F.col("id") % 100 == 0)


_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({c}) + 1), lambda i: CAST(ascii(substr({c}, i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
_TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, count(*) AS n, c - c % 20 AS base, {_CRC.format(c="CAST(c AS VARCHAR)")} % 4 AS h FROM t GROUP BY c),
g AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS taken, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS size
  FROM h LEFT JOIN h b ON b.c = h.base),
r AS (SELECT t.c, t.pos - g.h + g.taken AS d, t.role, t.text, g.size FROM t JOIN g USING (c) WHERE t.pos > g.h
  UNION ALL SELECT g.c, t.pos, t.role, t.text, g.size FROM g JOIN t ON t.c = g.base WHERE t.pos <= g.h),
m AS (SELECT c, d, size, text, sha256(CAST(list((role, text)) OVER (PARTITION BY c ORDER BY d) AS VARCHAR)) AS k FROM r
  UNION ALL SELECT c, 0, size, '', '' FROM g),
u AS (SELECT d, k, min(c) AS conv_id, count(*) AS n, len(list_filter(regexp_split_to_array(any_value(text), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
  string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = size) AS ends FROM m GROUP BY d, k),
e AS (SELECT m.c, m.d, m.k, u.conv_id, u.n, lag(u.conv_id) OVER (PARTITION BY m.c ORDER BY m.d) AS up, lag(m.k) OVER (PARTITION BY m.c ORDER BY m.d) AS up_k,
  CASE WHEN u.conv_id = m.c THEN (u.n - 1) * u.words ELSE 0 END AS own FROM m JOIN u ON u.d = m.d AND u.k = m.k),
kids AS (SELECT d - 1 AS d, up_k AS k, count(DISTINCT k) AS n_children FROM e WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT e.d, e.k, e.conv_id, e.up, sum(e.own) OVER (PARTITION BY e.c ORDER BY e.d DESC) AS saved,
  sum(CASE WHEN kids.k IS NULL AND e.conv_id = e.c THEN 1 ELSE 0 END) OVER (PARTITION BY e.c ORDER BY e.d DESC) AS leaves
  FROM e LEFT JOIN kids ON kids.d = e.d AND kids.k = e.k)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, any_value(x.up) AS parent_conv_id, u.n AS n_convs, coalesce(any_value(kids.n_children), 0) AS n_children,
  CAST(sum(x.leaves) AS BIGINT) AS n_leaves, CAST(sum(x.saved) AS BIGINT) AS saved_tokens, sha256(coalesce(any_value(u.ends), '')) AS ends_sha256
FROM u JOIN x ON x.d = u.d AND x.k = u.k LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k GROUP BY u.d, u.k, u.conv_id, u.n"""


@query("op13_prefix_trie", _TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    from .trie import numbered_turns, prefix_trie, shared_openings
    return prefix_trie(shared_openings(numbered_turns(table(spark, sf_dir, "conversations"))))
