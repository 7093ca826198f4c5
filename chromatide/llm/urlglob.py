"""Wildcard URL rules, all matched at once by a bit-parallel Shift-And automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands between host and path in the canonical form; UTF-8 text never holds this byte.
HOST_END = 0xFF


@dataclass(frozen=True)
class Rule:
    """A glob over the canonical URL: ``*`` any bytes, ``?`` one byte, ``^`` the end of the host.

    The whole URL must match. The longest matching rule decides (by ``rank``, then order in the list).
    """
    name: str
    glob: str
    verdict: str
    rank: int = 0


def host_path_rule(host: str, path: str, verdict: str) -> Rule:
    """Rule for ``host`` and all its subdomains where the path starts with ``path``."""
    return Rule(host + path, f"*.{host}^{path}*", verdict, rank=len(host + path))


class ShiftAnd:
    """Rules packed one after another into 64-bit words; one bit for each glob state.

    Bit i set means: the states up to item i of its rule have been matched by
    the bytes read so far. A ``*`` is a self loop on the state before it.
    """

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        bits = sum(1 + len(r.glob.replace("*", "").encode()) for r in rules)
        self.words = max(1, (bits + 63) // 64)
        start, final, loop = (np.zeros(self.words, np.uint64) for _ in range(3))
        byte = np.zeros((256, self.words), np.uint64)

        def put(mask, bit):
            mask[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

        self.final_bit = []
        at = 0
        for r in rules:
            put(start, at)
            for c in r.glob.encode():
                if c == ord("*"):
                    put(loop, at)
                    continue
                at += 1
                if c == ord("?"):
                    for b in range(256):
                        if b != HOST_END:
                            put(byte[b], at)
                else:
                    put(byte[HOST_END if c == ord("^") else c], at)
            put(final, at)
            self.final_bit.append(at)
            at += 1
        self.start, self.final, self.loop, self.byte = start, final, loop, byte

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Boolean (text, rule) matrix: which rules match each whole text."""
        n = len(texts)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        data = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        active = n
        for pos in range(int(lengths[0]) if n else 0):
            while active and lengths[active - 1] <= pos:  # sorted: the longest texts come first
                active -= 1
            s = state[:active]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            moved &= self.byte[data[offsets[:active] + pos]]
            state[:active] = moved | (s & self.loop)
        hit = np.zeros((n, len(self.rules)), bool)
        for k, bit in enumerate(self.final_bit):
            hit[order, k] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & one != 0
        return hit


def canonical(host: str, path: str) -> bytes:
    """``.host`` END ``path``: the leading dot lets ``*.host`` fit the host itself and its subdomains."""
    return b"." + host.encode("utf-8", "surrogatepass") + bytes([HOST_END]) + path.encode("utf-8", "surrogatepass")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path`` of ``url``; both are empty for null or a text without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring_index(F.expr(f"substr(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)"), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substring_index(rest, "/", 1)).otherwise(rest)
    path = F.when(cut > 0, F.substring(rest, F.length(host) + 1, F.length(rest))).otherwise("")
    return df.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def judge_urls(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the deciding rule's name or null) and ``verdict``.

    All rules run over each URL in one pass. Rows without a matching rule get
    ``default``; null and malformed URLs have an empty host and path, which
    rules match or not like any other. Repeated rows are judged one by one, an
    empty table gives an empty result, and input columns named like the four
    outputs are replaced. A long URL is read to its end.
    """
    automaton = ShiftAnd(rules)
    by_rank = sorted(range(len(rules)), key=lambda k: (-rules[k].rank, k))
    df = with_host_path(df.drop("host", "path", "rule", "verdict"), url)

    @F.pandas_udf("long")
    def deciding(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            hit = automaton.run([canonical(h, p) for h, p in zip(host, path)])
            first = np.full(len(host), -1, dtype=np.int64)
            for k in reversed(by_rank):
                first[hit[:, k]] = k
            yield pd.Series(first)

    names, verdicts = (F.array(*[F.lit(getattr(r, f)) for r in rules]) for f in ("name", "verdict"))
    return (df.withColumn("_k", deciding("host", "path"))
            .withColumn("rule", F.when(F.col("_k") >= 0, F.get(names, F.col("_k").cast("int"))))
            .withColumn("verdict", F.when(F.col("_k") >= 0, F.get(verdicts, F.col("_k").cast("int"))).otherwise(default))
            .drop("_k"))
