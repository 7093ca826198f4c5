"""Packing of tokenized documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt to blocks of a bounded size. In each block, islands evolve
populations of packings side by side; between epochs each island's elite moves
on to the next one. A packing is bred by injecting whole well-filled bins of
one parent into the other, removing the bins that now hold a piece twice, and
best-fitting the pieces displaced by that.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: White space for str.split() but not for the tokenizer.
ODD_SPACE, SPACE = re.compile(r"[\x1c-\x1f]"), re.compile(r"[ \t\n\r]+")
#: A word of Latin letters and then marks: two pieces to the tokenizer, the first in lower case.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|*%&#$]*)")
#: Entries of a worker's caches (the tokenizer drops white space, so words are independent), and the longest word kept.
CACHE_WORDS, CACHE_PARTS, CACHE_CHARS, TEXTS_AT_ONCE = 400_000, 1_000_000, 64, 100
BLOCK, ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4096, 3, 4, 2, 6


class WordTokenizer:
    """``encode`` of a lower-casing byte-level tokenizer that drops white space, word by word with bounded caches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.to_byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _part(self, part: str) -> bytes:
        """Ids of one piece between the tokenizer's cuts."""
        got = self.parts.get(part)
        if got is None:
            mapped = part if part.isascii() else self.to_byte_level.pre_tokenize_str(part)[0][0]
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            if len(self.parts) >= CACHE_PARTS:
                self.parts.clear()
            if len(part) <= CACHE_CHARS:
                self.parts[part] = got
        return got

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        found, others = {}, []
        for w in new:
            m = PLAIN.fullmatch(w)
            if m is None:
                others.append(w)
            else:
                found[w] = self._part(m[1].lower()) + (self._part(m[2]) if m[2] else b"")
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            found[w] = array("I", e.ids).tobytes()
        return found

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """32-bit ids of each text, in the machine's byte order."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            split = [SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in texts[at:at + TEXTS_AT_ONCE]]
            new = set().union(*split).difference(self.words)
            self.words.update(self._learn(new))
            known = self.words
            for words in split:
                yield b"".join([known[w] for w in words])
            if len(known) > CACHE_WORDS:
                known.clear()
            else:
                for w in new:
                    if len(w) > CACHE_CHARS:
                        del known[w]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (and ids as little-endian bytes).

    A document is its ids and then ``end_id``; only a longer one is cut. Null text counts as empty.
    """
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _TOKENIZERS.setdefault(tokenizer, None) or WordTokenizer(tokenizer)
        _TOKENIZERS[tokenizer] = words
        end = np.array([end_id], dtype="<u4").tobytes()
        for part in parts:
            rows = []
            for doc_id, ids in zip(part["doc_id"], words.encode_batch(["" if t is None else t for t in part["text"]])):
                if sys.byteorder != "little":
                    ids = np.frombuffer(ids, "=u4").astype("<u4").tobytes()
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)) + ((own,) if with_ids else ()))
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    # doc_id travels as text: pandas has no null among 64-bit integers
    cut_up = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(cut, schema)
    return cut_up.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def best_fit(items, lengths, gaps: list[tuple[int, int]], bin_of: np.ndarray, next_bin: int, capacity: int) -> int:
    """Put each item into the fullest bin with room; ``gaps`` is the sorted (room, bin) list. Returns the next new bin."""
    for i in items:
        size = int(lengths[i])
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
        else:
            room, b, next_bin = capacity, next_bin, next_bin + 1
        bin_of[i] = b
        if room > size:
            insort(gaps, (room - size, b))
    return next_bin


def _fills(bin_of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bin_of, weights=lengths).astype(np.int64)


def _compact(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def fitness(bin_of: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then a higher mean square fill (smaller is better)."""
    fill = _fills(bin_of, lengths)
    return len(fill), -float(np.mean((fill / capacity) ** 2))


def first_packing(lengths: np.ndarray, capacity: int, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths), np.int32)
    best_fit(order, lengths, [], out, 0, capacity)
    return out


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child of ``a`` with a sample of the well-filled bins of ``b``."""
    fill = _fills(b, lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    taken = rng.choice(good, size=max(1, len(good) // 3), replace=False)
    injected = np.isin(b, taken)
    doubled = np.unique(a[injected])                    # bins of a that hold an injected piece
    displaced = np.isin(a, doubled) & ~injected
    child = a.astype(np.int32).copy()
    child[injected] = len(lengths) + b[injected]        # new bin numbers, above all of a's
    kept = ~displaced
    bins, inverse = np.unique(child[kept], return_inverse=True)
    room = capacity - np.bincount(inverse, weights=lengths[kept]).astype(np.int64)
    gaps = sorted((int(r), int(n)) for r, n in zip(room, bins) if r > 0)
    todo = np.flatnonzero(displaced)
    todo = todo[np.argsort(-lengths[todo], kind="stable")]
    best_fit(todo, lengths, gaps, child, 4 * len(lengths), capacity)
    return _compact(child)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties a few of the worst-filled bins and best-fits their pieces in random order."""
    fill = _fills(a, lengths)
    worst = np.argsort(fill)[:max(1, len(fill) // 50) + 1]
    out = np.isin(a, worst)
    child = a.astype(np.int32).copy()
    gaps = sorted((int(capacity - f), int(n)) for n, f in enumerate(fill) if f < capacity and n not in set(worst.tolist()))
    best_fit(rng.permutation(np.flatnonzero(out)), lengths, gaps, child, len(lengths), capacity)
    return _compact(child)


def evolve(population: list[np.ndarray], lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A few generations; stops once no packing can have fewer bins. Best first."""
    least = -(-int(lengths.sum()) // capacity)
    score = lambda p: fitness(p, lengths, capacity)
    population = sorted(population, key=score)
    for _ in range(GENERATIONS):
        if score(population[0])[0] <= least:
            break
        a, b = rng.choice(len(population), size=2, replace=len(population) < 2)
        child = crossover(population[a], population[b], lengths, capacity, rng)
        child = min(child, mutate(child, lengths, capacity, rng), key=score)
        population = sorted([*population, child], key=score)[:POPULATION]
    return population


def _sorted_block(part: pd.DataFrame) -> pd.DataFrame:
    return part.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)


def pack_pieces(pieces: DataFrame, capacity: int, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (needs doc_id, piece, start, length, ids_crc32).

    Every piece lies in one sequence of at most ``capacity`` tokens, without gaps.
    Equal rows are packed one by one; no pieces give no rows. Blocks are dealt
    by row number, so no key makes one large; their number follows the input.
    """
    pieces = written(pieces)
    blocks = max(1, -(-pieces.count() // block))
    dealt = (pieces.withColumn("doc_id", F.col("doc_id").cast("string"))
             .withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long")))
    state = "block long, island int, lengths binary, population array<binary>"

    def start(part: pd.DataFrame) -> pd.DataFrame:
        part = _sorted_block(part)
        lengths = part["length"].to_numpy(np.int64)
        rows = []
        for island in range(ISLANDS):
            rng = np.random.default_rng([seed, island, int(part["block"][0])])
            noise = [lengths * rng.uniform(0.9, 1.1, len(lengths)) for _ in range(POPULATION - 1)]
            orders = [np.arange(len(lengths))] + [np.argsort(-x, kind="stable") for x in noise]
            rows.append((int(part["block"][0]), island, lengths.tobytes(), [first_packing(lengths, capacity, o).tobytes() for o in orders]))
        return pd.DataFrame(rows, columns=["block", "island", "lengths", "population"])

    def epoch(number: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            own = part[part["lengths"].notna()].iloc[0]
            lengths = np.frombuffer(own["lengths"], np.int64)
            rng = np.random.default_rng([seed, number, int(own["island"]), int(own["block"])])
            grown = evolve([np.frombuffer(p, np.int32) for x in part["population"] for p in x], lengths, capacity, rng)
            packed = [p.astype(np.int32).tobytes() for p in grown]
            return pd.DataFrame([(own["block"], own["island"], own["lengths"], packed),
                                 (own["block"], (own["island"] + 1) % ISLANDS, None, packed[:1])], columns=["block", "island", "lengths", "population"])
        return run

    islands = dealt.groupBy("block").applyInPandas(start, state)
    for number in range(EPOCHS):
        islands = islands.groupBy("block", "island").applyInPandas(epoch(number), state)

    def place(part: pd.DataFrame, evolved: pd.DataFrame) -> pd.DataFrame:
        part = _sorted_block(part)
        lengths = part["length"].to_numpy(np.int64)
        best = min((np.frombuffer(p, np.int32) for x in evolved["population"] for p in x), key=lambda p: fitness(p, lengths, capacity))
        order = np.argsort(best, kind="stable")
        total = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], best[order][1:] != best[order][:-1]])
        offset = np.empty(len(part), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        return part.assign(sequence_id=(part["block"].astype("int64") * (1 << 20)) + best.astype(np.int64), offset=offset)[columns]

    columns = [*pieces.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{n}` {t}" for n, t in dealt.drop("block").dtypes) + ", sequence_id long, offset long"
    packed = dealt.groupBy("block").cogroup(islands.groupBy("block")).applyInPandas(place, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(pieces.schema["doc_id"].dataType))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenize all ``docs`` (doc_id, text) and pack them; see :func:`tokenized_pieces` and :func:`pack_pieces`."""
    return pack_pieces(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)
