"""Resampling towards a target by importance weights of hashed word runs.

Features are all runs of one to ``LONGEST`` words, hashed into a fixed number of buckets. Counts of a bucket in the corpus and in the target
give it a gain; a document's weight is the sum of the gains of its features, taken from one array. Gumbel noise from a seeded digest
of the id turns the highest scores into a draw without replacement.

The checksum of a run is put together from those of its words: appending ``k`` bytes acts on a checksum as a fixed linear map, one table for each ``k``, so
a text is hashed as arrays and no run is ever built as text. Texts are hashed in pieces of at most ``PIECE`` bytes (cut between words, the
last words carried over), whatever their length. Tasks send one row of counts a bucket; only the counts of all buckets go to the driver.

The draw needs the exact cutoff among all scores. Every chunk of keys tells its median and size; the weighted median of these is a pivot with at least a fourth of
all keys on either side, so each round discards a guaranteed fraction, until the cutoff is met or few keys are left. Survivors are
written anew when they are a fourth of what is stored. Then the winners alone are sorted, over all tasks.

Defined results: a null text is an empty one; it has no features, weight 0 and cannot be drawn, as have texts of fewer than ``least_words``. A null id has the
noise of an empty id and comes last among ties; rows that repeat an id are documents of their own with the same noise; rows equal in score and id are ranked
in some order, and no more than the number to be drawn are. An empty table gives an empty one, an empty target the gains of
its smoothing alone. Rows travel as one struct, so columns of any name come through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import numbered, stored

LONGEST = 3
PIECE = 1 << 20
TABLED = 64  # longest word, in bytes, whose map is a table
CHUNK = 1 << 20  # keys of which one median is taken
FEW = 4096  # keys that are sorted at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_BYTE = _byte_table()


def _append(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The inner state after one more byte."""
    return _BYTE[(crc ^ byte) & np.uint32(255)] ^ (crc >> np.uint32(8))


def _shift_tables() -> np.ndarray:
    """For every number of bytes up to ``TABLED`` and each byte of a checksum: what it becomes behind that many bytes."""
    out = np.zeros((TABLED + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(TABLED):
        out[n + 1] = _append(out[n], np.uint32(0))
    return out


_SHIFT = _shift_tables()


def _word_checksums(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    first, length = starts[order], sizes[order]
    long = int((length > TABLED).sum())
    state = out.copy()
    for k in range(int(min(TABLED, length[0])) if len(length) else 0):
        m = int(np.searchsorted(-length, -k, side="left"))  # words of more than k bytes
        state[long:m] = _append(state[long:m], flat[first[long:m] + k].astype(np.uint32))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:long].tolist():
        out[k] = zlib.crc32(flat[starts[k]:starts[k] + sizes[k]])
    return out


def _joined(before: np.ndarray, word: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of ``before``, a space and the word."""
    spaced = _append(before ^ np.uint32(0xFFFFFFFF), np.uint32(32)) ^ np.uint32(0xFFFFFFFF)
    n = np.minimum(sizes, TABLED)
    out = word.copy()
    for k in range(4):
        out ^= _SHIFT[n, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
    for k in np.flatnonzero(sizes > TABLED).tolist():
        out[k] = zlib.crc32(flat[starts[k]:starts[k] + sizes[k]], int(spaced[k]))
    return out


def _parts(texts: list[bytes | None]) -> Iterator[tuple[int, bool, memoryview]]:
    """Which text, whether it goes on from the part before, and at most about ``PIECE`` bytes of it, cut between words."""
    for which, text in enumerate(texts):
        view, at = memoryview(text or b""), 0
        while at < len(view):
            upto = min(len(view), at + PIECE)
            while upto < len(view):
                ends = np.flatnonzero(~_IN_WORD[_LOWER[np.frombuffer(view[upto:upto + 4096], np.uint8)]])
                if len(ends):
                    upto += int(ends[0])
                    break
                upto = min(len(view), upto + 4096)
            yield which, at > 0, view[at:upto]
            at = upto


def _pieces(texts: list[bytes | None]) -> Iterator[list[tuple[int, bool, memoryview]]]:
    held, size = [], 0
    for part in _parts(texts):
        if held and size + len(part[2]) > PIECE:
            yield held
            held, size = [], 0
        held.append(part)
        size += len(part[2]) + 1
    if held:
        yield held


def feature_checksums(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Piece by piece: the text of every word, and for each length of run the places of the words that end one with the runs' checksums."""
    carry: list[int] = []  # of the text that goes on: its words so far (LONGEST - 1 at most) and the checksums of the runs that end at the last one
    for piece in _pieces(texts):
        flat = _LOWER[np.frombuffer(b" ".join([b"", *[p[2] for p in piece], b""]), np.uint8)]
        begin = np.cumsum([1] + [len(p[2]) + 1 for p in piece[:-1]])
        edge = np.diff(_IN_WORD[flat].view(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        sizes = ends - starts
        owner = np.searchsorted(begin, starts, side="right") - 1
        n = np.bincount(owner, minlength=len(piece)) if len(starts) else np.zeros(len(piece), int)
        place = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
        if not piece[0][1]:
            carry = []
        place[:n[0]] += len(carry[:1]) and carry[0]
        runs, checks = [np.arange(len(starts))], [_word_checksums(flat, starts, sizes)]
        for length in range(1, LONGEST):
            before = np.concatenate([np.array([carry[length] if len(carry) > length else 0], np.uint32), checks[-1][:-1]]) if len(starts) else np.zeros(0, np.uint32)
            checks.append(_joined(before, checks[0], flat, starts, sizes))
            runs.append(np.flatnonzero(place >= length))
        yield np.array([p[0] for p in piece])[owner] if len(starts) else np.zeros(0, int), runs, [c[r] for c, r in zip(checks, runs)]
        if n[-1]:
            carry = [min(LONGEST - 1, int(place[-1]) + 1), *[int(c[-1]) for c in checks]]
        elif len(piece) > 1 or not piece[0][1]:
            carry = []


# ---- counts, gains and weights -----------------------------------------------------------------------------------

def bucket_counts(df: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, checks in feature_checksums(batch.column(0).to_pylist()):
                for c in checks:
                    own += np.bincount(c % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(own[used], pa.int64())], names=["bucket", "n"])

    summed = df.select(F.col(text).cast("binary")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, both counts smoothed by one."""
    s, t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(scale * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(df: DataFrame, text: str, gain: np.ndarray) -> DataFrame:
    """``row``, ``n_words``, ``n_features`` and ``weight`` of every row (``row`` has the columns but the text)."""
    rows = df.select(F.struct(*[c for c in df.columns if c != text] or [F.lit(0).alias("none")]).alias("row"), F.col(text).cast("binary").alias("text"))
    held = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owner, runs, checks in feature_checksums(batch.column("text").to_pylist()):
                words += np.bincount(owner, minlength=batch.num_rows)
                for r, c in zip(runs, checks):
                    features += np.bincount(owner[r], minlength=batch.num_rows)
                    # Sums of whole numbers below 2^53 are exact in doubles.
                    weight += np.bincount(owner[r], gain[c % np.uint32(len(gain))], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words), pa.array(features), pa.array(weight)], names=["row", "n_words", "n_features", "weight"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"row {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int, scale: int = 1000) -> Column:
    """Gumbel noise in thousandths from a digest of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# ---- the cutoff --------------------------------------------------------------------------------------------------

def _ahead(score: Column, ident: Column, key: tuple[int, int], or_equal: bool = False) -> Column:
    tie = ident <= key[1] if or_equal else ident < key[1]
    return (score > key[0]) | ((score == key[0]) & tie)


def _middle(score: np.ndarray, ident: np.ndarray) -> tuple[int, int]:
    k = np.lexsort((ident, -score))[(len(score) - 1) // 2]
    return int(score[k]), int(ident[k])


def _chunk_medians(keys: DataFrame, pivot: tuple[int, int] | None) -> list:
    """Per chunk and side of the pivot (0 ahead, 1 equal, 2 behind) the number of keys and their median."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            score, ident = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            side = np.full(len(score), 2, np.int32)
            if pivot is not None:
                side[(score > pivot[0]) | ((score == pivot[0]) & (ident < pivot[1]))] = 0
                side[(score == pivot[0]) & (ident == pivot[1])] = 1
            out = [(s, int(m.sum()), *_middle(score[m], ident[m])) for s in range(3) if (m := side == s).any()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["side", "n", "score", "ident"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("score").to_numpy(), batch.column("ident").to_numpy()))
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield from told()
        if held:
            yield from told()

    return keys.select("score", "ident").mapInArrow(tell, "side bigint, n bigint, score bigint, ident bigint").collect()


def cutoff(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The key that stands at place ``k`` of all (``score`` down, then ``ident`` up); None if there are fewer."""
    if k < 1:
        return None
    told, size = _chunk_medians(keys, None), None
    while True:
        n = sum(r["n"] for r in told)
        size = size or n
        if k > n:
            return None
        if n <= FEW:
            ordered = sorted(((-r["score"], r["ident"]) for r in keys.select("score", "ident").collect()))
            return -ordered[k - 1][0], ordered[k - 1][1]
        # The weighted median of the medians: half of all keys are in chunks whose median is not behind it, half in those not ahead of it.
        seen, pivot = 0, None
        for r in sorted(told, key=lambda r: (-r["score"], r["ident"])):
            seen += r["n"]
            if 2 * seen >= n:
                pivot = (r["score"], r["ident"])
                break
        told = _chunk_medians(keys, pivot)
        ahead, equal = (sum(r["n"] for r in told if r["side"] == s) for s in (0, 1))
        if ahead < k <= ahead + equal:
            return pivot
        side = 0 if k <= ahead else 2
        within = _ahead(F.col("score"), F.col("ident"), pivot, or_equal=side == 2)
        keys = keys.filter(within if side == 0 else ~within)
        k -= 0 if side == 0 else ahead + equal
        told = [r for r in told if r["side"] == side]
        if 4 * sum(r["n"] for r in told) <= size:
            keys, size = stored(keys, "keys"), None


def resampled(df: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20,
              buckets: int = 10000, seed: int = 42) -> DataFrame:
    """``row, n_words, n_features, weight, score, rank`` of every row of ``df``; ``rank`` counts the drawn ones, ``percent`` of a hundred of those with ``least_words``."""
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, text, buckets))
    rows = weighted(df, text, gain).withColumn("score", F.col("weight") + noise(F.col("row")[key], seed))
    rows = rows.withColumn("ident", F.coalesce(F.col("row")[key].cast("bigint"), F.lit(2 ** 63 - 1)))
    held = stored(rows, "weighted")
    able = held.filter(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    last = cutoff(able.select("score", "ident"), k)
    names = ["row", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint").alias("rank")
    if last is None:
        return held.select(*names, none)
    inside = (F.col("n_words") >= least_words) & _ahead(F.col("score"), F.col("ident"), last, or_equal=True)
    placed = numbered(held.filter(inside).select(F.struct(F.lit(0).alias("g")).alias("key"), (-F.col("score")).alias("down"), "ident", *names), ["key"], ["down", "ident"])
    ranks = placed.select(*names, F.when(F.col("pos") < k, F.col("pos") + 1).alias("rank"))
    return ranks.unionByName(held.filter(~inside).select(*names, none))
