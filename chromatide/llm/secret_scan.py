"""Secrets in text, found through a trigram inverted index of each block of documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regexgrams


@dataclass(frozen=True)
class SecretRule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


# Base kinds: fixed by the contract of the query. The key names are in either case, the rest as written.
BASE_RULES = (
    SecretRule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A key runs to its END line if that comes before another BEGIN, else over the base64 lines (real or escaped line ends).
_PEM_LINES = (r"(?:(?:(?:[\s\"',>#|]|\\[rn])*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n\\]*|[A-Za-z0-9+/=]{16,}))+"
              r"(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/=]+(?![^\s\\\"']))?)?")
MORE_RULES = (
    SecretRule("private_key", r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:(?!-----BEGIN)[\s\S])*?-----END \1PRIVATE KEY-----|" + _PEM_LINES + ")"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
)
RULES = BASE_RULES + MORE_RULES
#: A longer text is a block of its own; the index of a block holds about so many bytes of text.
BLOCK_BYTES = 4 << 20


class TrigramIndex:
    """Posting lists (trigram -> documents of the block), for the trigrams that the rules ask for."""

    def __init__(self, rules: tuple[SecretRule, ...]):
        self.queries = [regexgrams.trigram_query(r.pattern, r.flags) for r in rules]
        grams = sorted(set().union(set(), *[regexgrams.trigrams(q) for q in self.queries]))
        self.grams = grams
        self.ids = np.zeros(1 << 24, dtype=np.int16)
        for i, g in enumerate(grams):
            self.ids[(g[0] << 16) | (g[1] << 8) | g[2]] = i + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, frozenset]:
        """``texts`` in ASCII lower case. Separated by a byte that no UTF-8 text holds."""
        if not texts or not self.grams:
            return {}
        data = np.frombuffer(b"\xff".join(texts), dtype=np.uint8).astype(np.int32)
        ends = np.cumsum([len(t) + 1 for t in texts])
        gram = self.ids[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]] if len(data) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(gram)
        doc = np.searchsorted(ends, at, side="right")
        pairs = np.unique(gram[at].astype(np.int64) * len(texts) + doc)
        gram_of, doc_of = pairs // len(texts), pairs % len(texts)
        cuts = np.searchsorted(gram_of, np.arange(1, len(self.grams) + 2))
        return {g: frozenset(doc_of[cuts[i]:cuts[i + 1]].tolist()) for i, g in enumerate(self.grams)}

    def candidates(self, texts: list[bytes]) -> list[frozenset]:
        """For each rule, the documents that can hold a match."""
        lists, everything = self.postings(texts), frozenset(range(len(texts)))
        return [regexgrams.candidates(q, lists, everything) for q in self.queries]


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def scan_block(texts: list[str], rules: tuple[SecretRule, ...], index: TrigramIndex) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule number, end) of each text, in code points, by start and then rule order."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    compiled = [re.compile(r.pattern, r.flags) for r in rules]
    for first, block in _blocks(texts):
        lower = [t.encode("utf-8", "surrogatepass").lower() for t in block]
        for k, docs in enumerate(index.candidates(lower)):
            group, least = rules[k].group, rules[k].least
            for d in docs:
                found[first + d] += [(m.start(), k, m.end()) for m in compiled[k].finditer(block[d])
                                     if m.end(group) - m.start(group) >= least]
    for spans in found:
        spans.sort()
    return found


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add ``secret_spans``: array of (kind, start, end), code points, end exclusive, by start.

    Matches of one kind are leftmost and do not overlap; kinds may overlap one
    another. Each block of an input partition is indexed by the trigrams that
    the rules need, candidates come from the posting lists, and only they are
    matched; a rule without a mandatory trigram is matched on every text. A
    null or empty text has no spans. Repeated rows are scanned one by one; an
    empty table gives an empty result; a column named secret_spans is replaced.
    """
    index = TrigramIndex(rules)

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = ["" if t is None else t for t in part]
            yield pd.Series([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x]
                             for x in scan_block(texts, rules, index)])

    return docs.drop("secret_spans").withColumn("secret_spans", spans(F.col(text)))


def redact(text: str | None, spans: list[tuple[int, int]], mask: str = "<secret>") -> str | None:
    """``text`` with every maximal run of overlapping spans replaced by ``mask``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with every found secret replaced by a mask in ``text``; all rows and columns stay."""
    index = TrigramIndex(rules)

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = ["" if t is None else t for t in part]
            yield pd.Series([None if raw is None else redact(t, [(s, e) for s, _, e in x])
                             for raw, t, x in zip(part, texts, scan_block(texts, rules, index))], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
