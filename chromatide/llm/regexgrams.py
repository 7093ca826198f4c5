"""Boolean trigram queries of regular expressions.

A query is True (no text can be ruled out), a trigram (bytes), or a tuple
("and" | "or", parts). Texts are compared in ASCII lower case.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser

#: A set of exact strings larger than this is turned into its trigram query and given up.
MAX_STRINGS = 64


def _and(parts):
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings):
    return _or([_and([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _chars(items):
    """Lower-cased strings of a character class, or None if it is large or negated."""
    out = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < MAX_STRINGS:
            out.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return None
    return {_fold(c) for c in out}


def _fold(s: str) -> bytes:
    return s.encode("utf-8", "surrogatepass").lower()


def _walk(tree):
    """(exact strings or None, query) of a parsed sequence."""
    exact, queries = {b""}, []

    def flush():
        nonlocal exact
        if exact is not None:
            queries.append(_of_strings(exact))
        exact = {b""}

    broken = False
    for op, arg in tree:
        strings, query = None, True
        if op is C.LITERAL:
            strings = {_fold(chr(arg))}
        elif op is C.IN:
            strings = _chars(arg)
        elif op is C.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is C.BRANCH:
            arms = [_walk(a) for a in arg[1]]
            query = _or([q if s is None else _of_strings(s) for s, q in arms])
            strings = None if any(s is None for s, _ in arms) else set().union(*[s for s, _ in arms])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, part = arg
            inner, inner_query = _walk(part)
            if inner is not None and high == 1:
                strings = inner | {b""} if low == 0 else inner
            elif low > 0:
                query = inner_query if inner is None else _of_strings(inner)
                if inner is not None and low == high and len(inner) == 1:
                    strings = {next(iter(inner)) * low}
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            continue
        if strings is None or len(exact) * len(strings) > MAX_STRINGS:
            broken = True
            flush()
            queries.append(query if strings is None else _of_strings(strings))
        else:
            exact = {a + b for a in exact for b in strings}
    if broken:
        flush()
        return None, _and(queries)
    return exact, _of_strings(exact)


def trigram_query(pattern: str, flags: int = 0):
    """Query that every text with a match satisfies; True if the pattern has no mandatory trigram."""
    return _walk(parser.parse(pattern, flags | re.ASCII))[1]


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*[trigrams(p) for p in query[1]])


def candidates(query, postings: dict, everything: frozenset) -> frozenset:
    """Documents that satisfy ``query``, from the posting lists of its trigrams."""
    if query is True:
        return everything
    if isinstance(query, bytes):
        return postings.get(query, frozenset())
    parts = [candidates(p, postings, everything) for p in query[1]]
    if query[0] == "or":
        return frozenset().union(*parts)
    parts.sort(key=len)
    return parts[0].intersection(*parts[1:])
