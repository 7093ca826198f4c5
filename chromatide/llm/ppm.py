"""Language identification by prediction by partial matching over bytes.

Per language, a context tree of orders 0 to K holds how often each byte followed
each context in the training texts. Method C: a symbol seen n times in a
context with T symbols of q kinds costs -log2(n / (T + q)) bits, an escape to
the next shorter context -log2(q / (T + q)); below order 0 every byte costs 8.
(Without exclusions.) The statistics are frozen before any text is scored, so
all code lengths are looked up in tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, written

ORDER = 4
#: Training pieces for each language (the least hashes of doc_id and piece), and characters in a piece. Longer texts
#: are cut, and each of their pieces is drawn like a text of its own.
TRAIN_DOCS, TRAIN_CHARS = 300, 50_000
CHUNK = 1 << 17
#: More languages than this are joined by a shuffle.
BROADCAST_LANGS = 20_000


def _padded(text: str) -> np.ndarray:
    """Bytes in ASCII lower case after a start context of zeros."""
    return np.frombuffer(bytes(ORDER) + text.encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.int64)


def _keys(data: np.ndarray, order: int) -> np.ndarray:
    """(context of ``order`` bytes, byte) at each position of a padded text, packed; its context is key >> 8."""
    n = len(data) - ORDER
    key = np.zeros(n, np.int64)
    for back in range(order, -1, -1):
        key = (key << 8) | data[ORDER - back:ORDER - back + n]
    return key


def context_counts(labelled: DataFrame, label: str, text: str) -> DataFrame:
    """(lang, ord, key, n) summed over all rows of ``labelled``."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, own in part.groupby("lang"):
                padded = [_padded(t) for t in own["text"] if t]
                for order in range(ORDER + 1) if padded else ():
                    key, n = np.unique(np.concatenate([_keys(d, order) for d in padded]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "ord": order, "key": key, "n": n})
    rows = labelled.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInPandas(count, "lang string, ord int, key long, n long").groupBy("lang", "ord", "key").agg(F.sum("n").alias("n"))


@dataclass
class Ppm:
    """Frozen code lengths: for each order the sorted keys and contexts with one column per language."""
    langs: list[str]
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def from_counts(cls, counts: pd.DataFrame) -> Ppm:
        langs = sorted(counts["lang"].unique())
        model = cls(langs, [], [], [], [])
        for order in range(ORDER + 1):
            own = counts[counts["ord"] == order]
            keys, row = np.unique(own["key"].to_numpy(np.int64), return_inverse=True)
            col = own["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
            n = np.zeros((len(keys), len(langs)))
            n[row, col] = own["n"].to_numpy()
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = (np.zeros((len(contexts), len(langs))) for _ in range(2))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[of])
            shorter = model.lookup(keys & ((1 << 8 * order) - 1), order - 1) if order else np.full(n.shape, 8.0)
            model.keys.append(keys)
            model.contexts.append(contexts)
            model.escapes.append(escape.astype(np.float32))
            model.costs.append(np.where(n > 0, seen, escape[of] + shorter).astype(np.float32))
        return model

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, wanted)
        at[at == len(table)] = 0
        return at, table[at] == wanted if len(table) else np.zeros(len(wanted), bool)

    def lookup(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of each (context, byte) for each language, escapes included."""
        out = np.zeros((len(keys), len(self.langs)))
        rows = np.arange(len(keys))
        while order >= 0 and len(rows):
            at, hit = self._find(self.keys[order], keys)
            out[rows[hit]] += self.costs[order][at[hit]]
            rows, keys = rows[~hit], keys[~hit]
            at, known = self._find(self.contexts[order], keys >> 8)
            out[rows[known]] += self.escapes[order][at[known]]
            keys, order = keys & ((1 << 8 * order) - 1), order - 1
        out[rows] += 8.0
        return out

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text for each language."""
        data, total = _padded(text), np.zeros(len(self.langs))
        for start in range(0, len(data) - ORDER, CHUNK):
            total += self.lookup(_keys(data[start:start + CHUNK + ORDER], ORDER), ORDER).sum(axis=0)
        return total


def crc32_of_id(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def train(labelled: DataFrame, doc_id: str = "doc_id", label: str = "lang", text: str = "text") -> Ppm:
    """Model of the languages in ``labelled`` from a bounded sample of the pieces of its texts (see TRAIN_DOCS, TRAIN_CHARS).

    Rows with a null label, a null text or an empty one are left out; a text of any
    length takes part, so a language is learned also where all its texts are long.
    """
    usable = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length(text) - 1) / TRAIN_CHARS)))
    usable = usable.select(F.col(label).alias("_l"), F.col(doc_id).cast("string").alias("_d"), F.col(text).alias("_x"), pieces.alias("_c"))
    usable = usable.withColumn("_h", F.xxhash64("_d", F.lit(5), "_c"))
    # A share of the hashes thins each language to about twice the sample where it lies, then the least hashes are taken.
    # The sizes, one row for each language, are broadcast while there are few, so that no text moves before it is thinned.
    size = written(usable.groupBy("_l").agg(F.count(F.lit(1)).alias("_n")))
    side = F.broadcast(size) if size.count() <= BROADCAST_LANGS else size
    thin = usable.join(side, "_l").where(F.pmod("_h", F.lit(1 << 31)) * F.col("_n") < F.lit(2 * TRAIN_DOCS * (1 << 31)))
    # only the pieces left are cut out of their texts
    thin = thin.select("_l", "_h", F.substring("_x", F.col("_c") * TRAIN_CHARS + 1, F.lit(TRAIN_CHARS)).alias("_t"))
    order = Window.partitionBy("_l").orderBy("_h", F.xxhash64("_t"))
    sample = thin.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= TRAIN_DOCS)
    label, text = "_l", "_t"
    return Ppm.from_counts(context_counts(sample, label, text).toPandas())


def identify(docs: DataFrame, model: Ppm, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (the language of the shortest code) and ``score`` (its posterior under equal priors).

    A null text or one without a letter is ``und`` with score 0, as is every
    text when no language was learned. Ties go to the first language by name.
    Whole texts are scored, in bounded chunks. Columns of those two names are
    replaced, others pass through; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ppm = shared.value
        for part in parts:
            rows = []
            for t in part:
                if not ppm.langs or t is None or not any(map(str.isalpha, t)):
                    rows.append(("und", 0.0))
                    continue
                bits = ppm.code_lengths(t)
                best = int(bits.argmin())
                rows.append((ppm.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    free = free_name(docs, "_j")
    judged = docs.drop("lang_pred", "score").withColumn(free, judge(F.col(text)))
    return judged.select("*", f"{free}.lang_pred", f"{free}.score").drop(free)
