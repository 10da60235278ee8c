"""Token counts by the whole-token shortcut.

Byte-level BPE merges each pre-token for itself, so a pre-token that is a vocabulary string *and* merges to that one token
counts as one without merging. Which strings do is proved once, on the driver, by merging every vocabulary string.
Tasks then split texts into pre-tokens, look each up, and merge only those that are not proved. What a worker
merged it remembers, up to ``remember`` pre-tokens of ``LONG`` characters at most; longer ones are merged with a heap, in n log n steps. No shuffle takes place.

Defined results: a null text is an empty one and has no tokens. Strings of special tokens inside a text are one token each, as the
library has it by default. Lone surrogates cannot occur in Spark strings. Repeated rows count one by one; an empty table
gives an empty table. Other columns pass through; ``n_tokens`` replaces a column of that name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .vocabulary import Vocabulary, letters, load

LONG = 64  # characters

# The split of the GPT-2 family of vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that are letters or digits only in Unicode versions after the library's (16.0). To it they are neither.
LATER = ("\U00000558 \U0000058b-\U0000058c \U0000088f \U00000c5c \U00000cdc \U0000208f \U0000209d-\U0000209f \U0000a7ce-\U0000a7cf \U0000a7d2 "
         "\U0000a7d4 \U0000a7dd \U0000a7e2 \U0000a7f1 \U0000ab6c-\U0000ab6d \U000107bb-\U000107bf \U00010940-\U00010959 "
         "\U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011de0-\U00011de9 \U00011df1 \U0001246f "
         "\U00012475-\U0001247f \U00012550-\U00012686 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff6 "
         "\U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 "
         "\U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 "
         "\U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 "
         "\U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead "
         "\U000323b0-\U00033479 \U0003d000-\U0003fc3f").replace(" ", "")


class Splitter:
    """Pre-tokens of a text under a pattern that names letters, digits and blanks by ``\\p{L}``, ``\\p{N}`` and ``\\s``."""

    def __init__(self, pattern: str):
        self.usual = regex.compile(pattern).findall
        self.later = regex.compile(f"[{LATER}]").search
        exact = pattern.replace("[^\\s\\p{L}\\p{N}]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{LATER}])").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        for kind in ("\\p{L}", "\\p{N}"):
            exact = exact.replace(f" ?{kind}", f" ?(?:(?![{LATER}]){kind})").replace(f"|{kind}", f"|(?:(?![{LATER}]){kind})")
        self.exact = regex.compile(exact).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.later(text):
            return self.usual(text)
        return self.exact(text)


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The merges of one pre-token, lowest rank first, leftmost first; only the ranks beside a merge are looked up again."""
    none = len(made)
    rank = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
    while rank:
        best = min(rank)
        if best == none:
            break
        i = rank.index(best)
        symbols[i:i + 2] = [made[best]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get((symbols[i], symbols[i + 1]), none)
        if i:
            rank[i - 1] = ranks.get((symbols[i - 1], symbols[i]), none)
    return symbols


def merged_long(symbols: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The same merges of a long pre-token: pairs wait in a heap by rank and place, symbols are linked to their neighbours."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapq.heapify(waiting)
    while waiting:
        rank, i = heapq.heappop(waiting)
        j = after[i]
        if symbols[i] is None or j == n or ranks.get((symbols[i], symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = made[rank], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := ranks.get((symbols[k], symbols[after[k]]))) is not None:
                heapq.heappush(waiting, (r, k))
    return [s for s in symbols if s is not None]


def proved_whole(v: Vocabulary) -> set[str]:
    """The vocabulary strings, as texts, that encode alone as one token."""
    back = {c: b for b, c in enumerate(map(letters, (bytes([b]) for b in range(256))))}
    out = set()
    for token, i in v.ids.items():
        if all(c in back for c in token) and merged([v.ids[c] for c in token], v.ranks, v.made) == [i]:
            try:
                out.add(bytes(back[c] for c in token).decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token
    return out


class Counts(dict):
    """Tokens per pre-token: one for proved strings, merged on first sight for others. Starts anew when ``remember`` is reached."""

    def __init__(self, v: Vocabulary, whole: Iterable[str], remember: int):
        self.whole = dict.fromkeys(whole, 1)
        super().__init__(self.whole)
        self.ranks, self.made, self.bytes = v.ranks, v.made, [v.ids[letters(bytes([b]))] for b in range(256)]
        self.limit = len(self.whole) + remember

    def __missing__(self, token: str) -> int:
        if len(token) > LONG:  # kept out of memory too
            return len(merged_long([self.bytes[b] for b in token.encode()], self.ranks, self.made))
        n = len(merged([self.bytes[b] for b in token.encode()], self.ranks, self.made))
        if len(self) >= self.limit:
            self.clear()
            self.update(self.whole)
        self[token] = n
        return n


class Counter:
    def __init__(self, v: Vocabulary, whole: Iterable[str], pattern: str = SPLIT, remember: int = 400_000):
        self.split = Splitter(pattern)
        self.counts = Counts(v, whole, remember)
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.specials, key=len, reverse=True)))) if v.specials else None

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        one = self.counts.__getitem__
        if self.special is None:
            return sum(map(one, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(one, self.split(p))) for p in parts)


_LOADED: dict[tuple, Counter] = {}  # one counter per worker process and vocabulary


def counter_column(spark: SparkSession, path: str, pattern: str = SPLIT, remember: int = 400_000):
    """A function from a text column to its token count under the vocabulary at ``path`` (read by the driver alone)."""
    v = load(path)
    shared = spark.sparkContext.broadcast((v, proved_whole(v)))  # bounded by the vocabulary

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        key = (path, pattern, remember)
        if key not in _LOADED:
            _LOADED[key] = Counter(*shared.value, pattern, remember)
        return pd.Series([_LOADED[key](t) for t in texts], dtype="int64")

    return counted


def with_counts(df: DataFrame, path: str, text: str = "text", pattern: str = SPLIT, remember: int = 400_000) -> DataFrame:
    return df.withColumn("n_tokens", counter_column(df.sparkSession, path, pattern, remember)(F.coalesce(F.col(text), F.lit(""))))
