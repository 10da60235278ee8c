"""BPE encoding with an index of pair occurrences, and decoding.

All words of a batch that the worker has not met yet are encoded together. Every pair of neighbours that the vocabulary can merge
is listed with all its places; ranks that have places are taken in ascending order; a merge at a place strikes the pairs
beside it and lists the pairs it makes. Vocabularies whose merges ascend (each merge uses only what earlier ones
made) can never get a new pair of lower rank, so this order gives each word what merging it by itself gives; for others
loading fails. No shuffle takes place: words of up to ``LONG`` characters are remembered within a task, up to ``remember`` of them.

Texts are normalised first as the vocabulary's file says: NFC, small letters one character at a time, white space dropped. Strings of special
tokens are found in the text as it stands. Decoding joins the tokens' strings by a space, special ones included.

Defined results: a null text is an empty one, with no ids and an empty decoded text. Repeated rows are encoded one by one; an
empty table gives an empty table. Other columns pass through; ``ids`` and ``decoded`` replace columns of those names.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import lean
from .token_count import Splitter
from .vocabulary import Vocabulary, letters, load

# The split of this family of vocabularies; what matches nothing is dropped.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Capitals newer than Python's tables, as (first, last, distance to the small letter).
NEW_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1),
                (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
SMALL = {c: c + by for first, last, by in NEW_CAPITALS for c in range(first, last + 1)} | {0x3A3: 0x3C3}  # no final form of sigma
AT_ONCE = 8192  # words under one index
LONG = 64  # characters
SLICE = 512  # documents that Python holds at a time


def normalised(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).translate(SMALL).lower() if _odd(text) else unicodedata.normalize("NFC", text).lower()


_odd = regex.compile("[" + "".join(map(chr, SMALL)) + "́-ͯ]").search  # composing can make a capital of this set only from marks


def encode_words(words: list[str], v: Vocabulary) -> list[bytes]:
    """The ids of every word, as little-endian 32-bit integers, by one pair index over all of them."""
    inner = [v.ids[letters(bytes([b]))] for b in range(256)]
    final = [v.ids[letters(bytes([b])) + v.suffix] for b in range(256)]
    gone, gap = -2, -1
    symbols: list[int] = []
    for w in words:
        data = w.encode()
        symbols.extend(map(inner.__getitem__, data[:-1]))
        symbols.append(final[data[-1]])
        symbols.append(gap)
    right = list(range(1, len(symbols) + 1))
    left = list(range(-1, len(symbols) - 1))
    ranks, made, merges = v.ranks.get, v.made, v.rank_pairs
    places: dict[int, list[int]] = {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        r = ranks(pair)
        if r is not None:
            places.setdefault(r, []).append(i)
    active = list(places)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        a, b = merges[rank]
        new = made[rank]
        here = places.pop(rank)
        here.sort()
        for i in here:
            if symbols[i] != a:
                continue
            j = right[i]
            if symbols[j] != b:
                continue
            symbols[i], symbols[j] = new, gone
            k = right[i] = right[j]
            left[k] = i
            h = left[i]
            r = ranks((symbols[h], new))
            if r is not None:
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(h)
            r = ranks((new, symbols[k]))
            if r is not None:
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(i)
    out = np.array(symbols, dtype=np.int32)
    out = out[out != gone]
    ends = np.flatnonzero(out == gap)
    raw = out.astype("<u4").tobytes()
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return [raw[4 * s:4 * e] for s, e in zip(starts.tolist(), ends.tolist())]


class Codec:
    """Encodes and decodes with one vocabulary; remembers the ids of words, starting anew at ``remember`` of them."""

    def __init__(self, v: Vocabulary, pattern: str = SPLIT, remember: int = 300_000):
        if not v.merges_ascend():
            raise ValueError("the vocabulary's merges do not ascend: a pair index could merge out of order")
        self.v, self.remember, self.known = v, remember, {}
        self.split = Splitter(pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True))) + ")") if v.specials else None
        self.tokens = v.tokens

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special string stands among them under its own name with a leading blank, which no word has."""
        if self.special is None:
            return self.split(normalised(text))
        out: list[str] = []
        for n, part in enumerate(self.special.split(text)):
            if n % 2:
                out.append(" " + part)
            elif part:
                out += self.split(normalised(part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        texts = [self.pieces(t) for t in texts]
        fresh = {w for t in texts for w in t if w not in self.known}
        if len(self.known) + len(fresh) > self.remember:
            self.known.clear()
            fresh = {w for t in texts for w in t}
        for w in [w for w in fresh if w[0] == " "]:
            fresh.discard(w)
            self.known[w] = np.array([self.v.specials[w[1:]]], dtype="<u4").tobytes()
        words = list(fresh)
        for at in range(0, len(words), AT_ONCE):
            part = words[at:at + AT_ONCE]
            self.known.update(zip(part, encode_words(part, self.v)))
        out = [b"".join(map(self.known.__getitem__, t)) for t in texts]
        for w in words:
            if len(w) > LONG:  # kept for its own batch only
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple, Codec] = {}  # one codec per worker process and vocabulary


IDS, DECODED = ("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())


def _mapped(df: DataFrame, path: str, source: str, targets: list[tuple], work, pattern: str, remember: int) -> DataFrame:
    """``df`` with the columns ``targets``, of which ``work(codec, values)`` gives a list each."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))  # bounded by the vocabulary
    names = [t[0] for t in targets]
    kept = [f for f in df.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern, remember)
        if key not in _LOADED:
            _LOADED[key] = Codec(shared.value, pattern, remember)
        codec = _LOADED[key]
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    made = [pa.array(values, t[2]) for values, t in zip(work(codec, part.column(source).to_pylist()), targets)]
                    yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *made], names=[*[f.name for f in kept], *names])
        finally:
            codec.known = {}  # a worker waits for its next task without them

    return df.mapInArrow(lean(run), T.StructType([*kept, *[T.StructField(t[0], t[1]) for t in targets]]))


def encoded(df: DataFrame, path: str, text: str = "text", pattern: str = SPLIT, remember: int = 300_000) -> DataFrame:
    """Adds ``ids``: the token ids as little-endian 32-bit integers."""
    return _mapped(df, path, text, [IDS], lambda c, texts: (_encode(c, texts),), pattern, remember)


def decoded(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text that the ids stand for."""
    return _mapped(df, path, ids, [DECODED], lambda c, ids: (_decode(c, ids),), SPLIT, 300_000)


def round_trip(df: DataFrame, path: str, text: str = "text", pattern: str = SPLIT, remember: int = 300_000) -> DataFrame:
    """Adds ``ids`` and, from these alone, ``decoded``: both ways in one worker, which holds the vocabulary once."""
    def both(codec: Codec, texts: list) -> tuple[list, list]:
        ids = _encode(codec, texts)
        return ids, _decode(codec, ids)

    return _mapped(df, path, text, [IDS, DECODED], both, pattern, remember)


def _encode(codec: Codec, texts: list) -> list[bytes]:
    return codec.encode([t or "" for t in texts])


def _decode(codec: Codec, ids: list) -> list[str]:
    return [codec.decode(i or b"") for i in ids]


def id_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, dtype="<u4").tolist()
