"""Decontamination through a positional inverted index, in DataFrame operations only.

The index holds the postings (term, document, position) of every training token
whose term occurs in the test items. For each window of an item its rarest terms
are looked up first; their position lists, shifted by their offset in the item,
are intersected, and the alignments that remain are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatide.session import scratch_path

from .common import ROW_KEY, ascii_lower, row_key, split_words, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: How many of a window's rarest terms must agree on an alignment before the words are compared.
ANCHORS = 2


def words_of(text: Column) -> Column:
    """Words of digits, ASCII letters in lower case and all characters beyond ASCII."""
    return split_words(ascii_lower(text), SEPARATORS)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, words, m) of the items that have words, each once; a null item_id is an id like any other."""
    return items.select("item_id", words_of(F.col("text")).alias("words")).distinct().withColumn("m", F.size("words")).where("m > 0")


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Postings (_rk, pos, term) of all tokens of ``docs`` whose term occurs in ``items``, written as a table.

    Tokens of other terms are never looked up. ``docs`` needs ``_rk`` and ``text``.
    """
    terms = items.select(F.explode("words").alias("term")).distinct()
    tokens = docs.select(ROW_KEY, F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    path = scratch_path(docs.sparkSession, "postings")
    tokens.join(terms, "term", "left_semi").select(ROW_KEY, "pos", "term").write.parquet(path)
    return docs.sparkSession.read.schema(f"{ROW_KEY} long, pos int, term string").parquet(path)


def _frequencies(index: DataFrame) -> DataFrame:
    return written(index.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def _anchors(items: DataFrame, frequencies: DataFrame, window: int, anchors: int) -> DataFrame:
    """(item key, at, term): places in the items that hold one of the rarest terms of some window that can occur."""
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - window, F.lit(0)))).alias("start")
    places = (items.select("ik", "words", "m", start)
              .select("ik", "start", F.posexplode(F.slice("words", F.col("start") + 1, window)).alias("off", "term"))
              .join(frequencies, "term", "left"))
    by_rarity = Window.partitionBy("ik", "start").orderBy("df", "off")
    whole = Window.partitionBy("ik", "start")
    return (places.withColumn("r", F.row_number().over(by_rarity)).withColumn("missing", F.sum(F.col("df").isNull().cast("int")).over(whole))
            .where((F.col("missing") == 0) & (F.col("r") <= anchors))
            .select("ik", (F.col("start") + F.col("off")).alias("at"), "term").distinct())


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(_rk, item_id, start, length): every place where a whole window of an item stands in a document.

    ``items`` as from :func:`item_words`. A window is ``window`` consecutive words, or the whole of a shorter item.
    """
    items = written(items.withColumn("ik", F.xxhash64("item_id", "words")))
    looked_up = _anchors(items, _frequencies(index), window, anchors)
    # Lists shifted by the place in the item: postings of one alignment share (document, item, diagonal).
    hits = index.join(looked_up, "term").select(ROW_KEY, "ik", (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    aligned = hits.groupBy(ROW_KEY, "ik", "diagonal").agg(F.sort_array(F.collect_set("at")).alias("ats")).join(items.select("ik", "m"), "ik")
    near = F.exists(F.transform("ats", lambda a, k: F.get("ats", k + anchors - 1) - a), lambda gap: gap < window)
    candidates = aligned.where(near | (F.col("m") < anchors)).select(ROW_KEY, "ik", "diagonal", "m")
    low = F.greatest(-F.col("diagonal"), F.lit(0))
    texts = docs.select(ROW_KEY, "text")
    per_doc = candidates.groupBy(ROW_KEY).agg(F.collect_list(F.struct("ik", "diagonal", "m")).alias("c"))
    cut = (texts.join(per_doc, ROW_KEY).select(ROW_KEY, words_of(F.col("text")).alias("w"), "c")
           .select(ROW_KEY, F.explode(F.transform("c", lambda c: F.struct(
               c["ik"].alias("ik"), c["diagonal"].alias("diagonal"),
               F.slice("w", F.greatest(c["diagonal"], F.lit(0)) + 1, c["m"]).alias("part")))).alias("c"))
           .select(ROW_KEY, "c.*").distinct())
    length = F.least(F.col("m"), F.lit(window))
    # Only windows that lie whole in the item: near its end a slice of fewer words could equal a short text.
    same = F.filter(F.sequence(low, F.greatest(low, F.col("m") - length)), lambda s: (
        (s + length <= F.col("m")) & (F.slice("part", s - low + 1, length) == F.slice("words", s + 1, length))))
    return (cut.join(items, "ik")
            .select(ROW_KEY, "item_id", F.explode(same).alias("s"), "diagonal", length.alias("length"))
            .select(ROW_KEY, "item_id", (F.col("diagonal") + F.col("s")).alias("start"), "length"))


def proximity_matches(items: DataFrame, index: DataFrame, slop: int, terms: int = 3) -> DataFrame:
    """(_rk, item_id, pos): the ``terms`` rarest terms of an item stand within ``slop`` words of the rarest's ``pos``, in any order."""
    own = items.select("item_id", F.explode(F.array_distinct("words")).alias("term")).join(_frequencies(index), "term", "left")
    by_rarity = Window.partitionBy("item_id").orderBy("df", "term")
    chosen = (own.withColumn("r", F.row_number().over(by_rarity)).where(F.col("r") <= terms)
              .withColumn("need", F.count(F.lit(1)).over(Window.partitionBy("item_id"))))
    hits = index.join(chosen, "term").select(ROW_KEY, "item_id", "pos", "r", "need", F.floor(F.col("pos") / slop).alias("cell"))
    first = hits.where("r = 1").select(ROW_KEY, "item_id", F.col("pos").alias("p"), F.explode(F.array(*[F.col("cell") + d for d in (-1, 0, 1)])).alias("cell"))
    return (first.join(hits, [ROW_KEY, "item_id", "cell"]).where(F.abs(F.col("pos") - F.col("p")) <= slop)
            .groupBy(ROW_KEY, "item_id", "p").agg(F.count_distinct("r").alias("got"), F.first("need").alias("need"))
            .where("got = need").select(ROW_KEY, "item_id", F.col("p").alias("pos")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, _rk, n_words, n_hit, n_items, item_ids, contaminated.

    A word is hit if it lies in any occurrence of a window of any item. Null
    or wordless texts and items have no words and match nothing; repeated rows
    get equal results; item rows equal in id and words count once. An empty
    table on either side leaves every document clean.
    """
    keyed = docs.select("doc_id", "text").withColumn(ROW_KEY, row_key("doc_id", "text"))
    own = item_words(items)
    once = keyed.select(ROW_KEY, "text")
    matches = phrase_matches(once, own, build_index(once, own), window)
    per_doc = written(matches.groupBy(ROW_KEY).agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("item_ids")))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct(
        (a["n"] + F.greatest(x["start"] + x["length"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], x["start"] + x["length"]).alias("end")))["n"]
    return (keyed.select("doc_id", ROW_KEY, F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
            .join(per_doc, ROW_KEY, "left")
            .select("doc_id", ROW_KEY, "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    F.col("spans").isNotNull().alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; all columns stay."""
    dirty = contamination(docs, items, window).where("contaminated").select(ROW_KEY).distinct()
    return docs.withColumn(ROW_KEY, row_key("doc_id", "text")).join(dirty, ROW_KEY, "left_anti").select(*docs.columns)
