"""Stupid-backoff bigram scores of every document under the corpus's own counts.

S(w | v) = c(v w) / c(v) if the pair was seen at least LEAST_COUNT times, else
BACKOFF * c(w) / N; the first word of a text scores c(w) / N. The logarithm of a
text's score is therefore a sum over its words as if all backed off, plus a gain
for each seen pair that depends on the pair alone. Count tables are partitioned
by the pair, joined to the exploded pairs and summed for each document. Every
word counts as itself: frequent words have an id in a broadcast dictionary, all
others a hash as their code and their counts in Spark tables only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW_KEY, UPPER, row_key, written

BACKOFF, LEAST_COUNT = 0.4, 2
#: The dictionary: words that make up at least this share of all words, so 2**20 - 1 at most. All others are rare words, known by their hash.
LEAST_SHARE, ID_BITS = 1e-6, 20
#: Pairs of two words that each make up this share (1000 words at most) are counted map-side and held in memory;
#: no other pair can be frequent enough to weigh on one task.
HEAD_SHARE = 1e-3
_ASCII = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words in ASCII lower case, between runs of 0x20 and 0x09 to 0x0D (what bytes.split() splits at)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).split()


def rare_code(word: bytes) -> int:
    """Code of a word outside the dictionary: negative, 63 bits of its hash (two of 10**8 words share one with a chance of 1 in 2000)."""
    return -1 - (xxhash.xxh64_intdigest(word, 42) >> 1)


def _rare_code(word: Column) -> Column:
    return F.lit(-1).cast("long") - F.shiftrightunsigned(F.xxhash64(word), 1)


class Vocabulary:
    """The dictionary: word ids from 1 by falling count. Any other word has a negative code and its count elsewhere."""

    def __init__(self, counts: pd.DataFrame, total: int):
        counts = counts.sort_values(["n", "word"], ascending=[False, True], kind="stable")
        self.total = total
        self.count = np.concatenate([[1], counts["n"].to_numpy(np.int64)])   # place 0 stands for rare words
        self.ids = {bytes(w): i + 1 for i, w in enumerate(counts["word"])}
        self.head = self.count >= HEAD_SHARE * total
        self.head[0] = False
        self.log_count = np.log(self.count)   # rare words: 0, theirs is joined
        self.log_share = self.log_count - math.log(max(1, total))
        self.log_share[0] = 0.0

    def encode(self, text: str | None) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w) or rare_code(w) for w in words_of(text)], np.int64)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the adjacent pairs in two columns, and which of them are pairs of two head words.

        A pair of dictionary words is packed in the first column and 0 in the
        second; else the columns are the codes of its words.
        """
        v, w = ids[:-1], ids[1:]
        known = (v > 0) & (w > 0)
        head = self.head[np.maximum(v, 0)] & self.head[np.maximum(w, 0)]
        return np.where(known, v << ID_BITS | w, v), np.where(known, 0, w), head

    def gain(self, key: np.ndarray, second: np.ndarray, n: np.ndarray, rare: np.ndarray | float = 0.0) -> np.ndarray:
        """What a seen pair adds to the log score, over its word backing off; ``rare`` is the sum of log counts of its rare words.

        A rare word by itself (key 0) adds its log share.
        """
        v = np.maximum(np.where(second == 0, key >> ID_BITS, key), 0)
        w = np.maximum(np.where(second == 0, key & ((1 << ID_BITS) - 1), second), 0)
        log_total = math.log(max(1, self.total))
        pair = np.log(n) - self.log_count[v] - self.log_count[w] - rare + log_total - math.log(BACKOFF)
        return np.where(key == 0, np.log(n) - log_total, pair)


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """Counts over all words of all ``docs``: the dictionary (words above LEAST_SHARE, a bounded number), and the table (code, n) of all others."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: Counter = Counter()
            for t in part["text"]:
                found.update(words_of(t))
            yield pd.DataFrame({"word": list(found), "n": np.fromiter(found.values(), np.int64, len(found))})

    counts = written(docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rare = counts.where(F.col("n") < LEAST_SHARE * total).groupBy(_rare_code(F.col("word")).alias("code")).agg(F.sum("n").alias("n"))
    return Vocabulary(counts.where(F.col("n") >= LEAST_SHARE * total).toPandas(), total), rare


def _head_pairs(docs: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all pairs of head words: at most a million."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        for part in parts:
            keys = [np.zeros(0, np.int64)]
            for t in part["text"]:
                key, _, head = vocab.pairs(vocab.encode(t))
                keys.append(key[head])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"key": key, "n": n})

    found = docs.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    found = found.toPandas().sort_values("key")
    return found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_seen (pairs seen in the corpus) and log_score (natural logarithm) for each row of ``docs`` (doc_id, text).

    A text without a word (null, empty) has n_words 0 and a null log_score.
    Every row counts in the corpus as often as it occurs, and repeated rows get
    equal scores. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn(ROW_KEY, row_key("doc_id", "text"))
    vocab, rare = vocabulary(docs)
    shared = spark.sparkContext.broadcast(vocab)
    heads = spark.sparkContext.broadcast(_head_pairs(docs, shared))

    @F.pandas_udf("n_words long, n_seen long, score double")
    def base(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v, (head_key, head_n) = shared.value, heads.value
        gains = v.gain(head_key, np.zeros_like(head_key), head_n)
        for part in parts:
            rows = []
            for t in part:
                ids = v.encode(t)
                key, _, head = v.pairs(ids)
                at = np.searchsorted(head_key, key[head])
                at[at == len(head_key)] = 0
                hit = at[head_key[at] == key[head]] if len(head_key) else at
                rows.append((len(ids), len(hit), v.log_share[np.maximum(ids, 0)].sum() + max(0, len(ids) - 1) * math.log(BACKOFF) + gains[hit].sum()))
            yield pd.DataFrame(rows, columns=["n_words", "n_seen", "score"])

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs that are not of two head words, and each rare word by itself as (0, code): both are counted alike."""
        def frame(keys, rows, times):
            both = np.concatenate(keys)
            return pd.DataFrame({"key": both["key"], "second": both["second"], ROW_KEY: np.concatenate(rows), "n": np.concatenate(times)})

        v = shared.value
        for part in parts:
            keys, rows, times = [], [], []
            for row, t in zip(part[ROW_KEY], part["text"]):
                ids = v.encode(t)
                key, second, head = v.pairs(ids)
                alone = ids[ids < 0]
                both = np.zeros(len(key) - head.sum() + len(alone), [("key", np.int64), ("second", np.int64)])
                both["key"][:len(both) - len(alone)] = key[~head]
                both["second"] = np.concatenate([second[~head], alone])
                both, n = np.unique(both, return_counts=True)
                keys.append(both)
                times.append(n)
                rows.append(np.full(len(both), row, np.int64))
                if sum(map(len, keys[-50:])) > 100_000 or len(keys) == 500:
                    yield frame(keys, rows, times)
                    keys, rows, times = [], [], []
            if keys:
                yield frame(keys, rows, times)

    @F.pandas_udf("double")
    def gain(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, second, n, logs in parts:
            yield pd.Series(shared.value.gain(*[x.to_numpy(np.int64) for x in (key, second, n)], logs.to_numpy(float)))

    # One exchange by the pair serves the count table and the join to it.
    parts, pair = int(spark.conf.get("spark.sql.shuffle.partitions")), ["key", "second"]
    pairs = docs.select(ROW_KEY, "text").mapInPandas(explode, f"key long, second long, {ROW_KEY} long, n int")
    pairs = pairs.where(F.col("key").isNotNull() & F.col("second").isNotNull() & F.col(ROW_KEY).isNotNull()).repartition(parts, *pair)   # the same filter for all uses
    counts = pairs.groupBy(*pair).agg(F.sum("n").alias("c"), F.count(ROW_KEY).alias("_rows"),   # reads all columns, so that the exchange is the join's
                                      F.max("key").alias("_first"), F.max("second").alias("_last"))   # filters on these stay above the exchange
    counts = counts.where(((F.col("c") >= LEAST_COUNT) | (F.col("_first") == 0)) & (F.col("_rows") > 0))
    # Seen pairs with a rare word are few: they fetch the counts of their rare words.
    logs = (counts.where((F.col("_first") != 0) & (F.col("_last") != 0))
            .select(*pair, F.explode(F.filter(F.array("_first", "_last"), lambda x: x < 0)).alias("code"))
            .join(rare, "code").groupBy(*pair).agg(F.sum(F.log("n")).alias("logs")))
    counts = counts.select(*pair, "c").join(logs, pair, "left").withColumn("logs", F.coalesce("logs", F.lit(0.0)))
    gained = (pairs.join(counts.hint("shuffle_hash"), pair).withColumn("gain", gain("key", "second", "c", "logs"))
              .groupBy(ROW_KEY).agg(F.sum(F.when(F.col("key") != 0, F.col("n")).otherwise(0)).alias("seen"), F.sum(F.col("n") * F.col("gain")).alias("gained")))
    scored = docs.withColumn("_b", base("text")).select("doc_id", ROW_KEY, "_b.*")
    each = scored.groupBy(ROW_KEY).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("n_words", "n_seen", "score")])
    m = F.col("m")
    out = (each.join(gained, ROW_KEY, "left")
           .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), m)))
           .select("doc_id", "n_words", (F.col("n_seen") + F.coalesce(F.col("seen") / m, F.lit(0))).cast("long").alias("n_seen"),
                   F.when(F.col("n_words") > 0, F.col("score") + F.coalesce(F.col("gained") / m, F.lit(0.0))).alias("log_score")))
    return out
