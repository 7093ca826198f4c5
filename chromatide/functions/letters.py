"""Letters and whole numbers of Arrow batches by lookup tables, a few nanoseconds each.

Spark's ``translate``, ``regexp_replace`` and higher-order functions make an
object for each character or element; these work on a batch's buffers. What is
needed on the way is made for a part of a batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters or numbers of a batch that are worked on at once; a single row may hold more.
PART = 1 << 20


def _parts(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows from and to of the parts of a batch; ``places`` tells where each row begins and the last ends."""
    part = (places[:-1] - places[0]) // PART if len(places) else places
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)


def _in_parts(rows: pa.Array, places: np.ndarray, step: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``step`` over the parts of ``rows``, joined."""
    out = [step(rows.slice(lo, hi - lo)) for lo, hi in _parts(places)] or [step(rows)]
    return out[0] if len(out) == 1 else pa.concat_arrays(out)


def _looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` for bytes, without a place of eight bytes for each of them."""
    out = np.empty(len(data), table.dtype)
    for at in range(0, len(data), PART):
        np.take(table, data[at:at + PART], out=out[at:at + PART], mode="clip")
    return out


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the places where each begins and the last ends."""
    texts = texts.cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0]:places[-1]]
    return data, places - places[0]


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every character (code point) of all texts, and the texts' places among these."""
    data, places = _utf8(texts)
    if not len(data) or data.max() < 0x80:
        return data, places
    kept, ends = [], np.zeros(len(places), np.int64)
    for lo, hi in _parts(places):
        a, b = int(places[lo]), int(places[hi])
        first = (data[a:b] & 0xC0) != 0x80
        kept.append(data[a:b][first])
        ends[lo + 1:hi + 1] = ends[lo] + np.append(0, np.cumsum(first, dtype=np.int64))[places[lo + 1:hi + 1] - a]
    return np.concatenate(kept), ends


def _texts(data: np.ndarray, places: np.ndarray, like: pa.Array) -> pa.Array:
    out = pa.LargeStringArray.from_buffers(len(like), pa.py_buffer(np.ascontiguousarray(places, np.int64)), pa.py_buffer(data))
    if like.null_count:
        out = pc.if_else(like.is_valid(), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def replaced(col: Column | str, old: str, new: str, other: str | None = None) -> Column:
    """``translate(col, old, new)`` for ASCII letters; with ``other``, every other character but those of ``new`` becomes it.

    Not marked as deterministic, so that Catalyst computes it once for a row and
    not again in every filter and column that uses it.
    """
    if not (old + new + (other or "")).isascii() or len(old) != len(new):
        raise ValueError("old and new must be equally many ASCII letters")
    table = np.arange(256, dtype=np.uint8)
    if other is not None:
        table[:] = ord(other)
        table[list(new.encode())] = list(new.encode())
    for a, b in reversed(list(zip(old.encode(), new.encode()))):    # the first of equal letters holds
        table[a] = b

    def look_up(texts: pa.Array) -> pa.Array:
        data, places = _utf8(texts) if other is None else _characters(texts)
        return _texts(_looked_up(table, data), places, texts)

    return F.arrow_udf(look_up, T.StringType()).asNondeterministic()(col)


#: Least code point of each number of bytes above one, and the first byte of each number of bytes.
_MORE_BYTES = np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31, 1 << 36])
_WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 13])
_LEADS = {1: 0, 2: 0xC0, 3: 0xE0, 4: 0xF0, 5: 0xF8, 6: 0xFC, 7: 0xFE, 13: 0xFF}


def _code_point_bytes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all code points in one row of bytes, and the number of bytes of each.

    Code points beyond Unicode's last one go on by the same rule, to any whole number.
    """
    if len(codes) and codes.min() < 0:
        raise ValueError("no code point below 0")
    width = _WIDTHS[np.searchsorted(_MORE_BYTES, codes, side="right")]
    first = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.uint8)
    for w in np.unique(width).tolist():
        at = width == w
        c, start = codes[at], first[at]
        for b in range(w - 1, 0, -1):
            out[start + b] = 0x80 | (c & 0x3F)
            c = c >> 6
        out[start] = _LEADS[w] | c
    return out, width


def code_point_bytes(col: Column | str) -> Column:
    """Binary: the code points of an array of whole numbers in UTF-8, see :func:`_code_point_bytes`; null elements are left out."""
    @F.arrow_udf(T.BinaryType())
    def encode(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0), np.int64)
        valid = np.asarray(flat.is_valid())
        data, width = _code_point_bytes(np.asarray(flat.drop_null(), np.int64))
        filled = np.zeros(len(flat), np.int64)
        filled[valid] = width
        ends = np.append(0, np.cumsum(filled))
        places = ends[np.append(0, np.cumsum(sizes))]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(places), pa.py_buffer(data)])
        if lists.null_count:
            out = pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.large_binary()))
        return out.cast(pa.binary())
    return encode(col)


def _lists(values: np.ndarray | pa.Array, places: np.ndarray, like: pa.Array) -> pa.Array:
    """Lists of ``values`` between ``places``, null where ``like`` is null."""
    mask = pa.array(~np.asarray(like.is_valid())) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values), mask=mask)


def letter_numbers(col: Column | str, numbers: dict[str, int], other: int, short: bool = False) -> Column:
    """Array with a number for each character of a text: that of ``numbers``, else ``other``; null for null.

    ``short`` gives numbers of one byte.
    """
    table = np.full(256, other, np.int8 if short else np.int32)
    for letter, number in numbers.items():
        table[ord(letter)] = number

    @F.arrow_udf(T.ArrayType(T.ByteType() if short else T.IntegerType()))
    def look_up(texts: pa.Array) -> pa.Array:
        data, places = _characters(texts)
        return _lists(_looked_up(table, data), places, texts)

    return look_up(col)


def _places(lists: pa.Array) -> np.ndarray:
    """Where each list begins among the elements of all, and the last ends."""
    return np.append(0, np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64)))


def letter_number_lists(col: Column | str, numbers: dict[str, int], other: int, before: list[int], after: list[int],
                        then: tuple[Callable[[pa.Array], pa.Array], T.DataType] | None = None) -> Column:
    """:func:`letter_numbers` of every text of an array, each list between the numbers ``before`` and ``after``; no null texts.

    ``then`` is a function of an Arrow array of such arrays, and its type: the
    numbers of a part of the batch go through it before those of the next are
    made, so a batch's numbers are never held as a whole.
    """
    table = np.full(256, other, np.int32)
    for letter, number in numbers.items():
        table[ord(letter)] = number

    def number(groups: pa.Array) -> pa.Array:
        data, places = _characters(groups.flatten())
        n, more = np.diff(places), len(before) + len(after)
        ends = np.append(0, np.cumsum(n + more))
        values = np.empty(int(ends[-1]), np.int32)
        for lo, hi in _parts(places):
            a, b = int(places[lo]), int(places[hi])
            values[np.arange(a, b) + np.repeat(ends[lo:hi] - places[lo:hi] + len(before), n[lo:hi])] = table[data[a:b]]
        for at, one in enumerate(before):
            values[ends[:-1] + at] = one
        for at, one in enumerate(reversed(after)):
            values[ends[1:] - 1 - at] = one
        inner = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
        return _lists(inner, _places(groups), groups)

    @F.arrow_udf(then[1] if then else T.ArrayType(T.ArrayType(T.IntegerType())))
    def look_up(groups: pa.Array) -> pa.Array:
        if not then:
            return number(groups)
        letters = np.append(0, np.cumsum(np.asarray(pc.binary_length(groups.flatten()), np.int64)))
        return _in_parts(groups, letters[_places(groups)], lambda part: then[0](number(part)))

    return look_up(col)


def _joined(lists: pa.Array, sep: str) -> pa.Array:
    """Texts of lists of whole numbers or texts; null elements are left out, null lists stay null."""
    flat = lists.flatten()
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    if flat.null_count:
        valid = np.asarray(flat.is_valid())
        sizes = np.diff(np.append(0, np.cumsum(valid))[np.append(0, np.cumsum(sizes))])
        flat = flat.drop_null()
    places = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    out = pc.binary_join(pa.ListArray.from_arrays(places, flat.cast(pa.string())), sep)
    return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.string())) if lists.null_count else out


def number_text(col: Column | str) -> Column:
    """``array_join(col, ',')`` of an array of whole numbers."""
    @F.arrow_udf(T.StringType())
    def join(lists: pa.Array) -> pa.Array:
        return _in_parts(lists, _places(lists), lambda part: _joined(part, ","))
    return join(col)


def _lists_text(groups: pa.Array) -> pa.Array:
    inner = _joined(groups.flatten(), ",")
    return _joined(_lists(inner, _places(groups), groups), "|")


def number_lists_text(col: Column | str) -> Column:
    """Arrays of arrays of whole numbers as text, numbers between commas and arrays between bars."""
    @F.arrow_udf(T.StringType())
    def join(groups: pa.Array) -> pa.Array:
        return _in_parts(groups, _places(groups.flatten())[_places(groups)], _lists_text)
    return join(col)


def number_lists_md5(groups: pa.Array) -> pa.Array:
    """``md5`` of the text of :func:`number_lists_text`, for an Arrow array; null for null."""
    return pa.array([hashlib.md5(t.as_buffer()).hexdigest() if t.is_valid else None
                     for t in _lists_text(groups).cast(pa.binary())], pa.string())
