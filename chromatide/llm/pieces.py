"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut between two characters that stand side by side in no piece of the
vocabulary, as no merge can cross such a place. The words that are left over are
encoded many at a time in flat numpy arrays: each round finds the least pair
rank of every word, merges all its leftmost places at once and closes the gaps,
until no word has a pair left. Whole texts pass, in slices of a bounded size.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Kinds of a piece in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_PAIR = np.iinfo(np.int32).max
#: Characters that are encoded and ids that are decoded at once, and characters of words that a worker keeps before it starts anew.
SLICE_CHARS, SLICE_IDS, CACHE_CHARS = 1 << 19, 1 << 17, 4_000_000
#: Texts taken from an Arrow batch at once.
ROWS_AT_ONCE = 256
#: Rows of one batch given back: a worker holds the ids or texts of these only, however large its batches are.
ROWS_OUT = 1024


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if wire == 2 else (4 if wire == 5 else 8, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Vocabulary of a BPE model file with byte fallback and the identity normalizer; others raise ValueError."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces, scores, kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in model:
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        plain = not normalizer.get(2) and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1 and not trainer.get(24)
        if trainer.get(3) != 2 or not trainer.get(35) or not plain or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model must be BPE with byte fallback, the identity normalizer and no user-defined pieces")
        self._build(pieces, scores, kinds, bool(normalizer.get(3, 1)))

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True) -> PieceModel:
        """A model of given pieces; for tests."""
        self = cls.__new__(cls)
        self._build(pieces, scores, kinds, dummy_prefix)
        return self

    def _build(self, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool) -> None:
        self.prefix = SPACE if dummy_prefix else ""
        self.pieces, self.kinds = pieces, np.array(kinds, np.int8)
        self.scores = scores
        shown = [b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN
                 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(b) for b in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.starts_blank = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(pieces, kinds)])

    def prepare(self) -> PieceModel:
        """Builds what encoding needs, once; decoding alone does without."""
        if hasattr(self, "merge_key"):
            return self
        pieces, scores = self.pieces, self.scores
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            self.byte_id[int(pieces[i][1:-1], 16)] = i
        normal = {pieces[i]: int(i) for i in np.flatnonzero(self.kinds == NORMAL)}
        # equal scores share a rank: then the place decides
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        chars = sorted(set("".join(normal)))
        lone = {c: len(pieces) + k for k, c in enumerate(c for c in chars if c not in normal)}
        ids = {**normal, **lone}
        #: Symbols from here on are characters that are no piece; the last one is for all that occur in no piece.
        self.n_symbols = len(pieces) + len(lone) + 1
        self.symbol = np.full(0x110000, self.n_symbols - 1, np.int32)
        self.kind_of_char = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.symbol[ord(c)] = ids[c]
            self.kind_of_char[ord(c)] = k
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        merges = {}
        for piece, i in normal.items():
            kind = self.kind_of_char[[ord(c) for c in piece]]
            self.beside[kind[:-1], kind[1:]] = True
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    merges[a * self.n_symbols + b] = i
        self.merge_key = np.array(sorted(merges) or [-1], np.int64)
        self.merge_to = np.array([merges.get(k, -1) for k in self.merge_key.tolist()], np.int32)
        return self

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) of each pair of symbols; (-1, NO_PAIR) where the two make no piece."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
        piece = np.where(self.merge_key[at] == key, self.merge_to[at], -1)
        return piece, np.where(piece >= 0, self.rank[piece], NO_PAIR).astype(np.int32)

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each character but the first: whether no merge can join it to the one before."""
        kind = self.kind_of_char[codes]
        return ~self.beside[kind[:-1], kind[1:]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` (none empty) in one array, and the number of ids of each."""
        codes = _codes("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        sym, at = self.symbol[codes], np.arange(len(codes))
        piece, rank = self.merged(sym[:-1], sym[1:])
        ends = word[1:] != word[:-1]
        piece = np.append(np.where(ends, -1, piece), -1)
        rank = np.append(np.where(ends, NO_PAIR, rank), NO_PAIR).astype(np.int32)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        one_by_one: list[int] = []
        floor = np.full(len(words), -1, np.int64)
        while len(sym):
            first = np.append(0, np.flatnonzero(word[1:] != word[:-1]) + 1)
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            # Several merges at once and then a pair of no higher rank: one of them had to wait for it.
            early = least <= floor
            over = early | (least == NO_PAIR)
            if over.any():
                one_by_one += word[first[early]].tolist()
                out = np.repeat(over & ~early, size)
                done.append((word[out], sym[out], at[out]))
                left = np.repeat(~over, size)
                word, sym, at, piece, rank = word[left], sym[left], at[left], piece[left], rank[left]
                floor = floor[~over]
                continue
            here = np.flatnonzero(rank == np.repeat(least, size))
            run = np.maximum.accumulate(np.where(np.append(True, np.diff(here) != 1), np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - run) % 2 == 0]
            segment = np.searchsorted(first, here, side="right") - 1
            floor = np.where(np.bincount(segment, minlength=len(first)) > 1, least, -1)
            # A merge whose right neighbour merges too: the piece with that neighbour's left half may come first.
            close = np.flatnonzero((np.diff(here) == 2) & (segment[1:] == segment[:-1]))
            if len(close):
                between = self.merged(piece[here[close]], sym[here[close + 1]])[1]
                floor[segment[close[between <= least[segment[close]]]]] = NO_PAIR
            sym[here] = piece[here]
            stay = np.ones(len(sym), bool)
            stay[here + 1] = False
            word, sym, at, piece, rank = word[stay], sym[stay], at[stay], piece[stay], rank[stay]
            here -= np.arange(len(here))
            before = here[here > 0] - 1
            for places in (here, before[word[before] == word[before + 1]]):
                inside = np.append(word[1:] == word[:-1], False)[places]
                piece[places], rank[places] = -1, NO_PAIR
                places = places[inside]
                piece[places], rank[places] = self.merged(sym[places], sym[places + 1])
        starts = np.cumsum(sizes) - sizes
        for w in one_by_one:
            own = self._one_by_one(codes[starts[w]:starts[w] + sizes[w]])
            done.append((np.full(len(own), w), own[:, 0], own[:, 1] + starts[w]))
        word, sym, at = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return self._ids(word[order], sym[order], codes[at[order]], len(words))

    def _one_by_one(self, codes: np.ndarray) -> np.ndarray:
        """(symbol, place) of one word, merged pair by pair: least rank first, then leftmost."""
        sym = self.symbol[codes].tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        key_of = dict(zip(self.merge_key.tolist(), self.merge_to.tolist())) if not hasattr(self, "_merges") else self._merges
        self._merges = key_of
        agenda: list[tuple[int, int, int, int]] = []

        def look(i: int) -> None:
            if i >= 0 and after[i] < len(sym):
                j = after[i]
                piece = key_of.get(sym[i] * self.n_symbols + sym[j], -1)
                if piece >= 0:
                    heapq.heappush(agenda, (int(self.rank[piece]), i, sym[i], sym[j]))

        for i in range(len(sym) - 1):
            look(i)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if sym[i] != a or j >= len(sym) or sym[j] != b:
                continue
            sym[i], sym[j] = key_of[a * self.n_symbols + b], -1
            after[i] = after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            look(before[i])
            look(i)
        return np.array([(s, i) for i, s in enumerate(sym) if s >= 0], np.int64)

    def _ids(self, word: np.ndarray, sym: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: a character that is no piece becomes the pieces of its UTF-8 bytes."""
        odd = sym >= len(self.pieces)
        size = np.where(odd, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
        ids = np.repeat(sym, size).astype(np.int32)
        ids[np.repeat(odd, size)] = self.byte_id[np.frombuffer("".join(map(chr, codes[odd].tolist())).encode(), np.uint8)]
        return ids, np.bincount(word, weights=size, minlength=n).astype(np.int64)

    def _shown(self, ids: np.ndarray) -> bytes:
        """What the pieces show, one after the other."""
        size = self.shown_size[ids]
        ends = np.cumsum(size)
        return self.shown[np.repeat(self.shown_at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of the id lists of ``sizes`` that lie one after the other in ``ids``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id lies outside the vocabulary")
        flat = b"".join(self._shown(ids[at:at + SLICE_IDS]) for at in range(0, len(ids), SLICE_IDS))
        total = np.append(0, np.cumsum(self.shown_size[ids]))
        ends = np.cumsum(sizes)
        hidden = np.append(0, np.cumsum(self.kinds[ids] == CONTROL))
        out = []
        for start, end in zip((ends - sizes).tolist(), ends.tolist()):
            first = start
            while first < end and hidden[first + 1] > hidden[first]:
                first += 1
            last = end
            while last > first and hidden[last] > hidden[last - 1]:
                last -= 1
            blank = first < last and bool(self.prefix) and bool(self.starts_blank[ids[first]])
            try:
                if hidden[last] > hidden[first]:
                    raise ValueError
                out.append(flat[total[first] + blank:total[last]].decode())
            except ValueError:
                out.append(self._decode_runs(ids[first:last].tolist())[int(blank):])
        return out

    def _decode_runs(self, ids: list[int]) -> str:
        """Text of ``ids`` where bytes between other pieces may be no UTF-8: each wrong byte gives U+FFFD."""
        text, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += bytes([int(self.pieces[i][1:-1], 16)])
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        text.append(run[:n].decode())
                        break
                    except ValueError:
                        n = 0
                text.append("" if n else "�")
                run = run[n or 1:]
            if i is not None:
                text.append(self.shown[self.shown_at[i]:self.shown_at[i] + self.shown_size[i]].tobytes().decode())
        return "".join(text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class TextEncoder:
    """Encodes texts by their words; words seen before are looked up, in a store of a bounded size."""

    def __init__(self, model: PieceModel):
        self.model = model.prepare()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.ids, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _slices(self, text: str) -> Iterator[str]:
        """``text`` in normal form, in parts of about SLICE_CHARS that no merge joins."""
        text = (self.model.prefix + text.replace(" ", SPACE)) if text else ""
        at = 0
        while at < len(text):
            end = at + SLICE_CHARS
            while end < len(text):
                free = np.flatnonzero(self.model.cuts(_codes(text[at:end + 1])))
                if len(free):
                    end = at + int(free[-1]) + 1
                    break
                end += end - at
            yield text[at:end]
            at = end

    def _encode_slices(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``parts`` in one array, and their number in each."""
        text = "".join(parts)
        codes = _codes(text)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        new = np.append(True, self.model.cuts(codes))
        new[ends[:-1]] = True
        at = np.flatnonzero(new)
        words = [text[a:b] for a, b in zip(at.tolist(), [*at[1:].tolist(), len(text)])]
        if self.chars > CACHE_CHARS:
            self._forget()
        fresh = list(set(words).difference(self.known))
        if fresh:
            ids, sizes = self.model.encode_words(fresh)
            self.known.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh))))
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
            self.starts = np.cumsum(self.sizes) - self.sizes
            self.chars += sum(map(len, fresh))
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.sizes[number]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[number] - (total - size), size) + np.arange(total[-1])]
        last = np.searchsorted(at, ends) - 1
        return ids, np.diff(np.append(0, total[last]))

    def encode(self, texts: Iterable[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts``, each with ``end_id`` behind it if that is given, in one array, and the number of ids of each."""
        tail = np.array([] if end_id is None else [end_id], np.int32)
        out: list[np.ndarray] = []
        counts: list[int] = []
        parts: list[str] = []
        owner: list[int] = []

        def work() -> None:
            ids, sizes = self._encode_slices(parts)
            for k, own in zip(owner, np.split(ids, np.cumsum(sizes)[:-1])):
                waiting[k].append(own)
            parts.clear()
            owner.clear()

        waiting: list[list[np.ndarray]] = []
        n_chars = 0
        for k, text in enumerate(texts):
            waiting.append([])
            for part in self._slices(text):
                parts.append(part)
                owner.append(k)
                n_chars += len(part)
                if n_chars >= SLICE_CHARS:
                    work()
                    n_chars = 0
        if parts:
            work()
        for own in waiting:
            own.append(tail)
            counts.append(sum(map(len, own)))
            out += own
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(counts, np.int64)


_MODELS: dict[str, PieceModel] = {}
_ENCODERS: dict[str, TextEncoder] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(_model(path))
    return _ENCODERS[path]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ROWS_OUT at once."""
    return (batch.slice(at, ROWS_OUT) for batch in batches for at in range(0, batch.num_rows, ROWS_OUT))


def _with_column(df: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with a column that ``make`` builds from each Arrow batch; a column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    places = [k for k, f in enumerate(df.schema.fields) if f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in places], make(batch)], names=[*[f.name for f in kept], name])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(name, kind)]))


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", end_id: int | None = 2) -> DataFrame:
    """Add ``ids``, the model's ids of the whole ``text`` and then ``end_id`` (None: no end id).

    Null and empty texts give the end id alone. Every row is kept, repeated ones
    too, with all its columns; one called ``ids`` is replaced. An empty table
    stays empty. ``model_path`` must be readable on every executor.
    """
    place = docs.columns.index(text)

    def make(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(place)
        some = (t or "" for at in range(0, len(texts), ROWS_AT_ONCE) for t in texts.slice(at, ROWS_AT_ONCE).to_pylist())
        flat, sizes = _encoder(model_path).encode(some, end_id)
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

    return _with_column(docs, ids, T.ArrayType(T.IntegerType()), make)


def decode_ids(docs: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the text of the list ``ids``: control pieces show nothing, bytes that are no UTF-8 give U+FFFD.

    A null list gives null, an empty one an empty text; an id outside the
    vocabulary raises ValueError. Every row is kept with all its columns; one
    called ``text`` is replaced.
    """
    place = docs.columns.index(ids)

    def make(batch: pa.RecordBatch) -> pa.Array:
        lists = batch.column(place)
        sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
        flat, ends = np.asarray(lists.flatten()), np.append(0, np.cumsum(sizes))
        texts: list[str] = []
        while len(texts) < len(sizes):
            first = len(texts)
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_IDS, side="right")) - 1)
            texts += _model(model_path).decode(flat[ends[first]:ends[last]], sizes[first:last])
        return pa.array(texts, pa.string(), mask=np.asarray(lists.is_null()) if lists.null_count else None)

    return _with_column(docs, text, T.StringType(), make)
