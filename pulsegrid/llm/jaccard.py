"""Join of texts by the Jaccard similarity of their word n-grams, with signature trees.

A text's set holds the 64-bit hashes of its distinct shingles (``width`` words); equal sets are one class from the start. Two sets
of similarity ``percent``/100 or more share one of the first n - ceil(n * percent / 100) + 1 members in any common order, so only
those prefixes are looked up. The order puts shingles that occur in very many texts last; it decides how much is compared,
never what is found.

Classes that share a prefix member form a list. A signature tree over a list holds at its leaves each class's bitmap of hashed members and its
size, and in every node the OR of the bitmaps below, the range of sizes and the largest number of members that fell on a bit
already set. Two sets below two nodes share at most the bits the nodes share plus the smaller such number; where that, or
the sizes, rule out the similarity, the dual traversal prunes the pair. What is left joins classes into candidate groups,
and inside these a second traversal compares the sets themselves, skipping pairs that are already connected.

Nothing grows with a group's pairs: lists and groups give spanning edges only. A list longer than ``LONG`` is parted
by levels of size; what is still longer gives edges to its first class only, as do tasks for what they meet very often. A group larger than ``BLOCK`` classes or ``BLOCK_MEMBERS`` members is dealt in blocks
of like sizes; pairs of blocks are compared only where the blocks are not yet wholly connected.

Defined results: a null text is an empty one; a text without words has an empty set and is linked with nothing, so its component is its
own id; a text of fewer words than ``width`` has one shingle, the whole. Rows that repeat an id are documents of their own; a null id
never is the smallest. An empty table gives an empty result. Extra columns are not carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import BLANKS, lean, stored

LONG, LOCAL_LONG = 128, 64  # longest list that is compared; longest of one level of size in a slice
BLOCK, BLOCK_MEMBERS = 256, 1 << 18
BUCKET_MEMBERS = 800_000  # members of all sets for each bucket
FAN = 8
FINE = 8  # bits per member of the bitmaps that part large groups
LEADERS = 8  # one class in so many of a first block leads
ID = 12  # bytes of a class id
PIECE = 1 << 19  # bytes of text that are taken apart at once

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def size_level(n: np.ndarray, percent: int) -> np.ndarray:
    """Similar sets have the same level or neighbouring ones."""
    return np.floor(np.log(n) / math.log(100 / percent)).astype(np.uint8)


def _parts(texts: list[bytes | None], piece: int) -> Iterator[tuple[int, memoryview]]:
    """Every text in parts of at most ``piece`` bytes, cut at blanks; a word longer than that is a part of its own."""
    for which, text in enumerate(texts):
        view, at = memoryview(text or b""), 0
        while at < len(view):
            upto = min(len(view), at + piece)
            if upto < len(view):
                blanks = np.flatnonzero(_BLANK[np.frombuffer(view[at:upto], np.uint8)])
                if len(blanks):
                    upto = at + int(blanks[-1]) + 1
                else:
                    while upto < len(view) and not len(blanks):
                        blanks = np.flatnonzero(_BLANK[np.frombuffer(view[upto:upto + 4096], np.uint8)])
                        upto = min(len(view), upto + (int(blanks[0]) if len(blanks) else 4096))
            yield which, view[at:upto]
            at = upto


def _long_word(view: memoryview, piece: int) -> np.uint64:
    """The hash of one word of any length."""
    base, total = 0x100000001B3, np.zeros(1, np.uint64)
    for at in range(0, len(view), piece):
        values = _BYTE[_SMALL[np.frombuffer(view[at:at + piece], np.uint8)]]
        values *= np.cumprod(np.full(len(values), base, np.uint64))
        total += np.add.reduce(values, keepdims=True) * np.uint64(pow(base, at, 1 << 64))
    return mix(total + np.uint64(len(view)))[0]


def word_hashes(texts: list[bytes | None], piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and how many each text has. At most about ``piece`` bytes are taken apart at once."""
    counts, out, held, size = np.zeros(len(texts), np.int64), [], [], 0

    def hashed() -> None:
        nonlocal held, size
        flat = _SMALL[np.frombuffer(b" ".join([b"", *[v for _, v in held], b""]), np.uint8)]
        begins = np.cumsum([1] + [len(v) + 1 for _, v in held[:-1]])
        solid = ~_BLANK[flat]
        edge = np.diff(solid.view(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        if len(starts):
            lengths = ends - starts
            begin = np.cumsum(lengths) - lengths
            values = _BYTE[flat[solid]]
            values *= np.cumprod(np.full(int(lengths.max()), 0x100000001B3, np.uint64))[np.arange(len(values)) - np.repeat(begin, lengths)]
            out.append(mix(np.add.reduceat(values, begin) + lengths.astype(np.uint64)))
            owner = np.array([w for w, _ in held])[np.searchsorted(begins, starts, side="right") - 1]
            np.add.at(counts, owner, 1)
        held, size = [], 0

    for which, view in _parts(texts, piece):
        if held and size + len(view) > piece:
            hashed()
        if len(view) > piece:
            out.append(np.array([_long_word(view, piece)], np.uint64))
            counts[which] += 1
            continue
        held.append((which, view))
        size += len(view)
    if held:
        hashed()
    return np.concatenate([np.zeros(0, np.uint64), *out]), counts


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    word, counts = word_hashes(texts)
    factor = np.uint64(0xD6E8FEB86659FD93)
    out, at = [], 0
    if len(word) >= width:
        rolled = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            rolled *= factor
            rolled += word[k:len(word) - width + 1 + k]
        rolled = mix(rolled + np.uint64(width))
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at:at + n - width + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for h in word[at:at + n]:
                whole = whole * factor + h
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def class_id(members: np.ndarray) -> bytes:
    """96 bits that equal sets share."""
    low = np.add.reduce(mix(members)) + np.uint64(len(members))
    high = np.add.reduce(mix(members ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    return mix(np.array([low, high], np.uint64)).tobytes()[:ID]


def bitmap(members: np.ndarray, per: int = 3) -> np.ndarray:
    """``per`` bits and more per member, hashed; a power of two, so that larger maps fold onto smaller ones."""
    bits = 1 << max(7, (per * len(members) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(members >> np.uint64(11)) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


class Tree:
    """Nodes of every level, leaves first: OR of bitmaps, least and greatest size, greatest excess."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        excess = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, x = self.levels[-1]
            cuts = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(x, cuts)))

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (i < j) that may reach the similarity."""
        i = j = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            b, low, high, x = self.levels[level]
            near = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
            if level == 0:
                near &= i < j
            i, j = i[near], j[near]
            keep = np.zeros(len(i), bool)
            for at in range(0, len(i), 4096):
                p, q = i[at:at + 4096], j[at:at + 4096]
                most = np.bitwise_count(b[p] & b[q]).sum(axis=1) + np.minimum(x[p], x[q])
                keep[at:at + 4096] = (100 + percent) * most >= percent * (low[p] + low[q])
            i, j = i[keep], j[keep]
            if level:
                count = len(self.levels[level - 1][0])
                step = np.arange(FAN)
                p = np.broadcast_to((i[:, None] * FAN + step)[:, :, None], (len(i), FAN, FAN)).ravel()
                q = np.broadcast_to((j[:, None] * FAN + step)[:, None, :], (len(i), FAN, FAN)).ravel()
                inside = (p < count) & (q < count) & (p <= q)
                i, j = p[inside], q[inside]
        return i, j


def near_pairs(bits: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may reach the similarity, from one tree for each length of bitmap: over the maps of that length and those of as many more bits as a similar set may have, folded (twice as many,
    from a similarity of a half). No small set among large ones makes their maps coarser. In each tree near sizes and maps with the same low bits
    lie side by side."""
    lengths = np.array([len(b) for b in bits])
    reach = 1 << max(1, math.ceil(math.log2(100 / percent)))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero((lengths >= length) & (lengths <= reach * length))
        if len(at) < 2:
            continue
        maps = np.stack([folded(bits[k], length) for k in at.tolist()])
        order = np.lexsort((maps[:, 0], sizes[at]))
        i, j = Tree(maps[order], sizes[at][order]).pairs(percent)
        i, j = at[order[i]], at[order[j]]
        own = (lengths[i] == length) | (lengths[j] == length)  # longer maps meet in their own tree
        yield i[own], j[own]


class Groups:
    """Which members are connected."""

    def __init__(self, n: int):
        self.up, self.left = list(range(n)), n

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.of(i), self.of(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
            self.left -= 1


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


# ---- first pass: profiles and prefixes ---------------------------------------------------------------------------

PROFILE = "doc_id bigint, tx bigint, n bigint, cid binary, bits binary"
PREFIX = "bucket int, tokens binary, members binary, levels binary, hot binary"
_PREFIX = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("members", pa.binary()), ("levels", pa.binary()), ("hot", pa.binary())])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each stay near ``size`` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            upto = min(rows, int(np.searchsorted(np.cumsum(lengths[at:at + rows]), size)) + 1)
            yield batch.slice(at, upto)
            at += upto


def frequent(docs: DataFrame, width: int, least: int = 8, most: int = 1 << 20) -> np.ndarray:
    """Shingles met in very many texts, for the order: those that two or more different texts of a slice hold, added up over all slices. The
    ``most`` most frequent go to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 8192, 1 << 24):
            sets = {class_id(s): s for s in shingle_sets(part.column("text").to_pylist(), width)}
            shingle, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
            often = n >= 2
            yield pa.RecordBatch.from_arrays([pa.array(shingle[often].view(np.int64)), pa.array(n[often], pa.int64())], names=["s", "n"])

    table = (docs.select("text").mapInArrow(lean(count), "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
             .orderBy(F.col("n").desc(), "s").limit(most).toArrow())
    return np.sort(table.column("s").to_numpy().view(np.uint64))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Every document with its class, size and bitmap; no class for a text without words."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            sets = shingle_sets(part.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tx"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([class_id(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "tx", "n", "cid", "bits"])

    return docs.select("doc_id", "tx", "text").mapInArrow(lean(profile), PROFILE)


def prefixes(docs: DataFrame, width: int, percent: int, buckets: int, late) -> DataFrame:
    """Per slice of documents and bucket one row: the prefix members that fall in the bucket, with their classes and levels of size. A member
    that more than ``LOCAL_LONG`` classes of a level share in the slice is sent for one of them, marked hot; rows without ``tokens`` hold edges from that one to the others."""
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = late.value
        for part in _slices(batches):
            chosen = {class_id(s): s for s in shingle_sets(part.column("text").to_pylist(), width) if len(s)}
            if not chosen:
                continue
            firsts = []
            for s in chosen.values():
                size = len(s) - -(-len(s) * percent // 100) + 1
                if size < len(s) and len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    common = last[at] == s
                    s = np.concatenate([s[~common], s[common]])
                firsts.append(s[:size])
            token = np.concatenate(firsts)
            owner = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
            names = np.frombuffer(b"".join(chosen), np.uint8).reshape(-1, ID)
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            short = (token & np.uint64(0xFFFFFFFF)).astype("<u4")
            level = size_level(np.array([len(c) for c in chosen.values()]), percent)[owner]
            order = np.lexsort((level, short, bucket))
            bucket, short, owner, level = bucket[order], short[order], owner[order], level[order]
            start = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1]) | (level[1:] != level[:-1])]))
            count = np.diff(np.concatenate([start, [len(short)]]))
            hot = np.repeat(count > LOCAL_LONG, count)
            head = np.zeros(len(short), bool)
            head[start] = True
            if hot.any():
                rest = hot & ~head
                pairs = np.unique(np.stack([np.repeat(owner[start], count)[rest], owner[rest]], axis=1), axis=0)
                edges = np.concatenate([names[pairs[:, 0]], names[pairs[:, 1]]], axis=1)
                spread = int(mix(np.array([int(pairs[0, 1]) + len(pairs)], np.uint64))[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([spread], pa.int32()), pa.nulls(1, pa.binary()), pa.array([edges.tobytes()], pa.binary()),
                                                  pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=_PREFIX)
            keep = ~hot | head
            bucket, short, owner, level, hot = bucket[keep], short[keep], owner[keep], level[keep], hot[keep]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                 *[pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (short, names[owner], level, hot.astype(np.uint8))]], schema=_PREFIX)

    return docs.select("text").mapInArrow(lean(prefix), PREFIX)


# ---- lists of classes that share a prefix member -----------------------------------------------------------------

def lists_of_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket: the distinct lists of classes that share a member, and star edges for long lists."""
    given = [e[k:k + 2 * ID] for t, e in zip(table.column("tokens").to_pylist(), table.column("members").to_pylist()) if t is None for k in range(0, len(e), 2 * ID)]
    table = table.filter(table.column("tokens").is_valid())
    if not table.num_rows:
        return pa.table({"kind": pa.array([2] * len(given), pa.int32()), "members": pa.array(given, pa.binary())})
    token = np.frombuffer(b"".join(table.column("tokens").to_pylist()), "<u4")
    names = np.frombuffer(b"".join(table.column("members").to_pylist()), np.uint8).reshape(-1, ID)
    hot, level = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("hot", "levels"))
    low = np.ascontiguousarray(names[:, :8]).view("<u8").ravel()
    high = np.ascontiguousarray(names[:, 8:]).view("<u4").ravel()
    order = np.lexsort((high, low, level, token))
    token, low, high, names, hot, level = token[order], low[order], high[order], names[order], hot[order], level[order]
    fresh = np.concatenate([[True], (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    hot = np.maximum.reduceat(hot, np.flatnonzero(fresh))
    token, names, level = token[fresh], names[fresh], level[fresh]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    end = np.concatenate([start[1:], [len(token)]])
    is_hot = np.maximum.reduceat(hot, start)
    found, edges = set(), set(given)
    for a, b, h in zip(start.tolist(), end.tolist(), is_hot.tolist()):
        if b - a < 2:
            continue
        if not h and b - a <= LONG:
            found.add(names[a:b].tobytes())
            continue
        for at in np.unique(level[a:b]).tolist():  # classes of a level and the next
            first, last = a + int(np.searchsorted(level[a:b], at)), a + int(np.searchsorted(level[a:b], at + 1, side="right"))
            if last - first < 2:
                continue
            if last - first > LONG or hot[first:last].any():
                center = names[first].tobytes()
                edges.update(center + names[k].tobytes() for k in range(first + 1, last))
            else:
                found.add(names[first:last].tobytes())
    kind = [1] * len(found) + [2] * len(edges)
    return pa.table({"kind": pa.array(kind, pa.int32()), "members": pa.array([*found, *edges], pa.binary())})


def in_runs(df: DataFrame, key: str, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``work`` on the rows of every key, which meet in one partition side by side; keys are many and each has few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(key).to_pylist()
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            if held and (not keys or held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]):
                out = work(pa.Table.from_batches(held))
                held = []
                if out is not None:
                    yield out
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                held.append(batch.slice(a, b - a))
                if b < len(keys):
                    out = work(pa.Table.from_batches(held))
                    held = []
                    if out is not None:
                        yield out
        if held:
            out = work(pa.Table.from_batches(held))
            if out is not None:
                yield out

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(lean(run), schema)


def _edges(ids: list[bytes], groups: Groups) -> pa.RecordBatch | None:
    pairs = [(ids[groups.of(k)], ids[k]) for k in range(len(ids)) if groups.of(k) != k]
    if not pairs:
        return None
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def candidate_edges(percent: int):
    def work(rows: pa.Table) -> pa.RecordBatch | None:
        """A spanning forest of the pairs of a list, of a group or between two blocks of one, that the signature tree does not rule out."""
        first: dict[bytes, int] = {}
        for k, c in enumerate(rows.column("cid").to_pylist()):
            first.setdefault(c, k)
        ids, at = list(first), list(first.values())
        maps = rows.column("bits").to_pylist()
        side = rows.column("side").to_numpy()[at] if "side" in rows.column_names else np.zeros(len(at), int)
        across = bool((side == 0).any() and (side == 1).any())
        groups = Groups(len(ids))
        for i, j in near_pairs([np.frombuffer(maps[k], np.uint64) for k in at], rows.column("n").to_numpy()[at], percent):
            for a, b in zip(i.tolist(), j.tolist()):
                if not across or side[a] != side[b]:
                    groups.join(a, b)
                    if groups.left == 1:
                        return _edges(ids, groups)
        return _edges(ids, groups)
    return work


def exact_edges(percent: int):
    def work(rows: pa.Table) -> pa.RecordBatch | None:
        """A spanning forest of the similar pairs of a group, or between two blocks of one."""
        first: dict[bytes, int] = {}
        for k, c in enumerate(rows.column("cid").to_pylist()):
            first.setdefault(c, k)
        ids, at = list(first), list(first.values())
        held = rows.column("members").to_pylist()
        sets = [np.frombuffer(held[k], np.uint64) for k in at]
        side = rows.column("side").to_numpy()[at]
        across = bool((side == 0).any() and (side == 1).any())
        groups = Groups(len(ids))
        for i, j in near_pairs([bitmap(s) for s in sets], np.array([len(s) for s in sets]), percent):
            for a, b in zip(i.tolist(), j.tolist()):
                if (not across or side[a] != side[b]) and groups.of(a) != groups.of(b) and similar(sets[a], sets[b], percent):
                    groups.join(a, b)
                    if groups.left == 1:
                        return _edges(ids, groups)
        return _edges(ids, groups)
    return work


# ---- which documents to read again -------------------------------------------------------------------------------

CHUNK = 1 << 16  # bytes of the filter that tasks send as one row


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.view(np.uint64)
    return np.concatenate([mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D))]) & np.uint64(bits - 1)


def key_filter(keys: DataFrame, count: int, most: int = 1 << 30) -> np.ndarray:
    """A filter of ``most`` bits at most that every key ``h`` passes, and few others: 16 bits per key, two of them set. Tasks send the parts
    they touch, which are joined by OR; only the filter itself goes to the driver."""
    bits = min(most, 1 << max(19, (16 * count).bit_length()))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column("h").to_numpy(), bits)
            np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        packed = own.reshape(-1, CHUNK)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([packed[k].tobytes() for k in used], pa.binary())], names=["part", "data"])

    def joined(rows: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.uint8).reshape(-1, CHUNK)
        return pa.table({"part": rows.column("part")[:1], "data": pa.array([np.bitwise_or.reduce(data, axis=0).tobytes()], pa.binary())})

    out = np.zeros((bits // 8 // CHUNK, CHUNK), np.uint8)
    table = keys.mapInArrow(lean(parts), "part bigint, data binary").groupBy("part").applyInArrow(joined, "part bigint, data binary").toArrow()
    for part, data in zip(table.column("part").to_pylist(), table.column("data").to_pylist()):
        out[part] = np.frombuffer(data, np.uint8)
    return out.ravel()


def passes(wanted: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _places(h, 8 * len(wanted))
    hit = (wanted[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (hit[:len(h)] & hit[len(h):]).astype(bool)


# ---- the join ----------------------------------------------------------------------------------------------------

EDGES = "a binary, b binary"


def _cut_ids(members):
    return F.transform(F.sequence(F.lit(0), (F.octet_length(members) / ID).cast("int") - 1), lambda i: F.substring(members, i * ID + 1, F.lit(ID)))


def _block_key(c, i, d, j):
    return F.concat_ws("|", F.hex("comp"), *[x.cast("string") for x in (c, i, d, j)])


def bucket_count(of_docs: DataFrame) -> int:
    """Buckets by the summed sizes of the sets, however many rows they come from."""
    return min(1 << 16, max(16, (of_docs.agg(F.sum("n")).first()[0] or 0) // BUCKET_MEMBERS))


def linked(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, tx, n_shingles, class_id, group_id, component_id``: every document with the hash of its text, the size of its set, its class
    of equal sets, its group of linked classes, and the smallest id in the group."""
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tx"), F.col(text).cast("binary").alias("text"))
    late = df.sparkSession.sparkContext.broadcast(frequent(docs, width))
    of_docs = stored(profiles(docs, width), "profiles")
    buckets = bucket_count(of_docs)
    classes = of_docs.filter("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    of_docs = of_docs.select("doc_id", "tx", "n", "cid")

    shared = stored(prefixes(docs, width, percent, buckets, late).groupBy("bucket").applyInArrow(lists_of_bucket, "kind int, members binary"), "lists")
    stars = shared.filter("kind = 2").select("members").distinct().select(
        F.substring("members", 1, ID).alias("a"), F.substring("members", ID + 1, ID).alias("b"))
    lists = shared.filter("kind = 1").select("members").distinct().select(
        F.md5("members").alias("list"), F.explode(_cut_ids(F.col("members"))).alias("cid"))
    likely = in_runs(lists.join(classes, "cid").select("list", "cid", "n", "bits"), "list", candidate_edges(percent), EDGES)
    groups = components(likely.unionByName(stars))

    live = stored(groups.join(classes.select("cid", "n"), groups["v"] == F.col("cid")).select("cid", "n", F.col("root").alias("comp")), "live")
    links = _compared(docs, of_docs, live, width, percent)
    roots = components(links)

    smallest = of_docs.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    named = smallest.join(roots.select(F.col("v").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select("cid", "root", "component_id")
    return of_docs.join(of_class, "cid", "left").select(
        "doc_id", "tx", F.col("n").alias("n_shingles"), F.hex("cid").alias("class_id"), F.hex("root").alias("group_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, one of every group: that with the smallest id, a null id only if there is no other. Texts without words all stay."""
    found = stored(linked(df, key, text, width, percent).select("doc_id", "tx", "group_id"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")
    # The same three columns, none of them null, for the join and for what repeats: texts are shuffled once.
    same = ["__none", "__id", "__tx"]

    def named(ident, tx):
        return [ident.isNull().alias("__none"), F.coalesce(ident, F.lit(0)).alias("__id"), tx.alias("__tx")]

    chosen = (found.filter("group_id is not null").groupBy("group_id").agg(F.min(order).alias("r"))
              .select(*named(F.col("r.doc_id"), F.col("r.tx"))))
    rows = df.select(F.struct("*").alias("__row"), *named(F.col(key).cast("bigint"), F.xxhash64(F.col(text))),
                     F.coalesce(F.length(F.translate(F.col(text), BLANKS, "")) > 0, F.lit(False)).alias("__words"))
    kept = rows.filter("__words").join(chosen, same, "left_semi").dropDuplicates(same)
    return kept.select("__row").unionByName(rows.filter("not __words").select("__row")).select("__row.*")


def _sets_of(docs: DataFrame, of_docs: DataFrame, live: DataFrame, width: int, fine: bool) -> DataFrame:
    """``cid, n`` and ``bits`` (fine bitmaps) or ``members`` of the classes of ``live``, one row of each, from documents read again. Rows that
    repeat both id and text, and documents that only seem to be wanted, pass the filter too: of a class one row is kept, where it was read and then
    over all, and joins on the class drop the classes that nobody asks for."""
    chosen = (of_docs.join(live.select("cid"), "cid").groupBy("cid")
              .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("r"))
              .select(F.xxhash64("r.doc_id", "r.tx").alias("h")))
    wanted = docs.sparkSession.sparkContext.broadcast(key_filter(chosen, live.count()))
    name = "bits" if fine else "members"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column("h").to_numpy())))
            for part in _slices([batch]):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([(bitmap(s, FINE) if fine else s).tobytes() for s in sets], pa.binary())], names=["cid", "n", name])

    sets = docs.select(F.xxhash64("doc_id", "tx").alias("h"), "text").mapInArrow(lean(members), f"cid binary, n bigint, {name} binary")
    return sets.groupBy("cid").agg(F.first("n").alias("n"), F.first(name).alias(name))


def _big(live: DataFrame) -> DataFrame:
    sized = live.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    return stored(sized.filter((F.col("m") > BLOCK) | (F.col("t") > BLOCK_MEMBERS)).select("comp"), "big")


def _compared(docs: DataFrame, of_docs: DataFrame, live: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges between similar classes of the candidate groups. Groups too large for one task are first parted by trees of finer bitmaps."""
    big = _big(live)
    if not big.isEmpty():
        inside = live.join(big, "comp")
        fine = _in_blocks(inside, big, _sets_of(docs, of_docs, inside, width, True), candidate_edges(percent), percent)
        parts = components(fine).select(F.col("v").alias("cid"), F.col("root").alias("comp"))
        live = stored(live.join(big, "comp", "left_anti").select("cid", "n", "comp").unionByName(
            inside.select("cid", "n").join(parts, "cid").select("cid", "n", "comp")), "live")
        big = _big(live)
    return _in_blocks(live, big, _sets_of(docs, of_docs, live, width, False), exact_edges(percent), percent)


def _in_blocks(live: DataFrame, big: DataFrame, sets: DataFrame, work, percent: int) -> DataFrame:
    """Edges that ``work`` finds among the classes of every group, the groups of ``big`` in blocks."""
    payload = [c for c in sets.columns if c != "cid"]
    step = math.log(100 / percent)
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    in_big = live.join(big, "comp").withColumn("c", level)
    shape = in_big.groupBy("comp", "c").agg(
        F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_MEMBERS))).cast("int").alias("k"))
    blocks = stored(in_big.join(shape, ["comp", "c"]).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")), "blocks")
    c, i, k = F.col("c"), F.col("i"), F.col("k")

    def meeting(d, x, e, y, side: int):
        return F.struct(_block_key(d, x, e, y).alias("task"), F.lit(side).alias("side"))

    # Every block meets some leaders of the first block of its sizes, and the first blocks of neighbouring sizes meet.
    zero = F.lit(0)
    leads = (i == 0) & (F.pmod(F.xxhash64(F.lit(1), "cid"), F.lit(LEADERS)) == 0)
    first = F.concat(
        F.array(meeting(c, i, c, i, 0)),
        F.when(leads, F.concat(
            F.array(meeting(c, zero, c + 1, zero, 0), meeting(c - 1, zero, c, zero, 1)),
            F.transform(F.filter(F.sequence(zero, k - 1), lambda j: j > 0), lambda j: meeting(c, j, c, j, 0)))).otherwise(F.array().cast(
                "array<struct<task:string,side:int>>")))
    small = live.join(big, "comp", "left_anti").select("cid", F.hex("comp").alias("task"), F.lit(0).alias("side"))
    tasks = small.unionByName(blocks.select("cid", F.explode(first).alias("m")).select("cid", "m.task", "m.side"))
    links = stored(in_runs(tasks.join(sets, "cid").select("task", "side", "cid", *payload), "task", work, EDGES), "links")
    if big.isEmpty():
        return links

    # Blocks that are not yet connected as wholes meet the others of their size and the next.
    roots = components(links)
    state = (blocks.join(roots.select(F.col("v").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
             .groupBy("comp", "c", "i").agg(F.min("root").alias("lo"), F.max("root").alias("hi")))
    left = state.select("comp", "c", "i", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    right = state.select("comp", F.col("c").alias("d"), F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    unmet = ((F.col("d") == F.col("c")) & (F.col("j") > F.col("i"))) | (F.col("d") == F.col("c") + 1)
    whole = (F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    pairs = stored(left.join(right, "comp").filter(unmet & ~whole).withColumn(
        "task", _block_key(F.col("c"), F.col("i"), F.col("d"), F.col("j"))).select("comp", "c", "i", "d", "j", "task"), "pairs")
    if pairs.isEmpty():
        return links
    ends = pairs.select("comp", "c", "i", "task", F.lit(0).alias("side")).unionByName(
        pairs.select("comp", F.col("d").alias("c"), F.col("j").alias("i"), "task", F.lit(1).alias("side")))
    more = blocks.select("cid", "comp", "c", "i").join(ends, ["comp", "c", "i"]).select("cid", "task", "side")
    rest = in_runs(more.join(sets, "cid").select("task", "side", "cid", *payload), "task", work, EDGES)
    return links.unionByName(rest)
