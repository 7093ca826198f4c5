"""SimHash near-duplicates, with candidate keys from the binary Golay code.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two
fingerprints that differ in at most 4 bits either agree on a whole segment, or
differ in every segment and then in exactly one bit on at least two of them
(1 + 1 + 2 is all that 4 errors allow). So there are two kinds of keys:

* exact: (segment, its bits);
* Golay: for a pair of segments, the 12-bit indices of the codewords that the
  two words decode to. The perfect [23,12,7] code decodes every word to the one
  codeword within 3 bits. If x and y differ in one bit, decode(x) is among the
  decodings of the one-bit neighbours of y. One-bit errors flip the parity, so
  words of even parity in the pair's first segment give their own decoding,
  words of odd parity the (about 5 by 5) decodings around them.

Fingerprints that share a key are compared; no pair within 4 bits is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW_KEY, UPPER, row_key, written
from .components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))   # (shift, bits)
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 4
#: Generator polynomial of the binary Golay code (fixed value).
GOLAY = 0xC75
#: A key shared by more fingerprints is split into blocks of so many, and each pair of blocks is a group of its own.
BLOCK = 4096


@lru_cache(maxsize=1)
def _golay_tables():
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome."""
    def syndrome(x):
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x
    low = np.array([syndrome(x) for x in range(1 << 12)], np.int32)
    high = np.array([syndrome(x << 12) for x in range(1 << 11)], np.int32)
    errors = np.zeros(1 << 11, np.int32)
    bits = [1 << i for i in range(23)]
    for i, a in enumerate(bits):
        errors[syndrome(a)] = a
        for j in range(i):
            errors[syndrome(a | bits[j])] = a | bits[j]
            for k in range(j):
                errors[syndrome(a | bits[j] | bits[k])] = a | bits[j] | bits[k]
    return low, high, errors


def golay_index(x: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within 3 bits of each 23-bit word."""
    low, high, errors = _golay_tables()
    return (x ^ errors[low[x & 0xFFF] ^ high[x >> 12]]) >> 11


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 values of the word shingles, repeats included; 0 without a word."""
    words = WORD.findall((text or "").translate(_ASCII))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    count = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        h = np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]).encode("utf-8", "surrogatepass"), SEED)
                      for i in range(start, min(n, start + (1 << 16)))], dtype=">u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n).tobytes(), "big")


_ASCII = str.maketrans(UPPER, LOWER)


def with_fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit integer."""
    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in part], dtype=np.uint64).view(np.int64))
    return docs.withColumn("fp", fp(F.col(text)))


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    shift, bits = SEGMENTS[k]
    return ((fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) & 1


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the fingerprint) for all keys of an array of unsigned fingerprints."""
    rows = np.arange(len(fp))
    segs = [_segment(fp, k) for k in range(3)]
    parity = [_parity(s).astype(np.int64) for s in segs]
    own = [golay_index(s) for s in segs]
    around = [np.stack([golay_index(s ^ (1 << b)) for b in range(SEGMENTS[k][1])], axis=1) for k, s in enumerate(segs)]
    for a in around:   # the decodings of one word's neighbours, each once; -1 marks a repeat
        a.sort(axis=1)
        a[:, 1:][a[:, 1:] == a[:, :-1]] = -1
    keys, of = [], []
    for k, s in enumerate(segs):
        keys.append((np.int64(k) << 56) | s)
        of.append(rows)
    for p, (a, b) in enumerate(PAIRS):
        base = np.int64(3 + p) << 56
        even = parity[a] == 0
        # The last bit of the key is the even side's parity on the second segment.
        keys.append(base | own[a][even] << 13 | own[b][even] << 1 | parity[b][even])
        of.append(rows[even])
        odd = ~even
        ka, kb, other, r = around[a][odd], around[b][odd], 1 - parity[b][odd], rows[odd]
        ia, ca = np.nonzero(ka >= 0)
        # every (row, first index) against that row's second indices
        grid = kb[ia]
        i, c = np.nonzero(grid >= 0)
        keys.append(base | ka[ia, ca][i] << 13 | grid[i, c] << 1 | other[ia][i])
        of.append(r[ia][i])
    return np.concatenate(keys), np.concatenate(of)


def key_table(fps: DataFrame) -> DataFrame:
    """(key, fp) for every distinct fingerprint of ``fps``."""
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            values = part["fp"].to_numpy(np.int64)
            for start in range(0, len(values), 4096):
                chunk = values[start:start + 4096]
                key, of = keys_of(chunk.view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": chunk[of]})
    return fps.mapInPandas(emit, "key long, fp long")


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph "at most ``max_bits`` apart" on distinct fingerprints.

    Breadth first: each reached fingerprint is compared with those not reached
    yet, so a dense group costs about one comparison for each member.
    """
    left, right = [], []
    todo = fps
    while len(todo):
        frontier, todo = todo[:1], todo[1:]
        while len(frontier) and len(todo):
            head, frontier = frontier[0], frontier[1:]
            near = np.bitwise_count(head ^ todo) <= max_bits
            if near.any():
                reached = todo[near]
                left.append(np.full(len(reached), head))
                right.append(reached)
                todo = todo[~near]
                frontier = np.concatenate([frontier, reached])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links_of_sorted(key: np.ndarray, fp: np.ndarray, max_bits: int):
    """Links within runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):   # small runs, all pairs of a size at once
        base = starts[sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                a, b = fp[base + i], fp[base + j]
                near = np.bitwise_count(a ^ b) <= max_bits
                yield a[near], b[near]
    for start, size in zip(starts[sizes > 8], sizes[sizes > 8]):
        yield _forest(np.unique(fp[start:start + size]), max_bits)


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that join all fingerprints of ``fps`` (distinct ``fp``) at most ``max_bits`` apart.

    Of each group with a common key only a spanning forest comes out, never all
    pairs; its components are those of all pairs. Groups above :data:`BLOCK`
    are dealt to pairs of blocks, so no task holds more than two blocks of one key.
    """
    keys = key_table(fps)
    hot = keys.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb"))
    tagged = keys.join(hot, "key", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    cold = tagged.where("nb is null").select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    split = (tagged.where("nb is not null").select("key", block.alias("b"), other.alias("o"), "fp")
             .select("key", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "fp"))
    grouped = cold.unionByName(split).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def link(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            last = part.iloc[-1]
            same = ((part["key"] == last["key"]) & (part["lo"] == last["lo"]) & (part["hi"] == last["hi"])).to_numpy()
            held = part[same]   # the last run may go on in the next batch
            yield from out(part[~same])
        if held is not None:
            yield from out(held)

    def out(rows: pd.DataFrame):
        if not len(rows):
            return
        run = ((rows[["key", "lo", "hi"]] != rows[["key", "lo", "hi"]].shift()).any(axis=1)).cumsum().to_numpy()
        found = list(_links_of_sorted(run, rows["fp"].to_numpy(np.int64).view(np.uint64), max_bits))
        if found:
            u, v = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
            yield pd.DataFrame({"u": u, "v": v})

    return grouped.mapInPandas(link, "u long, v long")


def _components(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id) of every fingerprint of ``prints`` (doc_id, fp)."""
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(near_links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest doc_id reachable over links of at most ``max_bits`` bits.

    ``max_bits`` may be 0 to 4 (the keys guarantee no more). One row for each input
    row; texts without a word have fingerprint 0, which is linked like any other.
    Equal fingerprints are one node, so copies cost nothing. A null doc_id is
    never the smallest unless its whole component has none. An empty table gives
    an empty result; other columns of the input are dropped.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    prints = written(with_fingerprints(docs.select("doc_id", "text"), shingle).drop("text"))
    return prints.join(_components(prints, max_bits).drop("root"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null last).

    Rows are told apart by doc_id and text; of rows equal in both, one stays.
    """
    keyed = docs.withColumn(ROW_KEY, row_key("doc_id", "text"))
    prints = written(with_fingerprints(keyed.select("doc_id", ROW_KEY, "text"), shingle).drop("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW_KEY)).alias("first")
    rows = prints.groupBy("fp", ROW_KEY, "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    keep = (rows.join(_components(prints, max_bits).select("fp", "root"), "fp")
            .groupBy("root").agg(first).select(F.col("first")[ROW_KEY].alias(ROW_KEY)))
    keep = written(rows.join(keep, ROW_KEY, "left_semi").select(ROW_KEY, "_n"))
    kept = keyed.join(keep, ROW_KEY)
    once, repeated = kept.where("_n = 1"), kept.where("_n > 1").dropDuplicates([ROW_KEY])
    return once.unionByName(repeated).select(*docs.columns)
