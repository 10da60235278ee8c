"""Language identification by prediction with partial matching (PPM).

For every language a tree of byte contexts up to ``order`` bytes counts which byte followed. A byte costs -log2 of its probability:
from the longest known context with escape method C (a context seen n times with d different bytes escapes with
d / (n + d)), bytes already ruled out by a longer context excluded, down to equal chances for all bytes left. The statistics are
frozen after learning, so the cost of a byte depends on the ``order`` bytes before it alone. All costs are therefore worked out
once, as integers of 2**-16 bit, into tables by (context, byte, language); a text's code length is the exact sum of
what it looks up. The language with the shortest code is predicted.

Learning counts byte sequences of a sample bounded by ``max_docs`` documents per language (expected number; chosen by hash, the
same at every run) in Spark; the driver gets the counts, whose number the sample bounds, and broadcasts the tables, which ``max_table``
bytes bound. Scoring covers every whole text where it lies, without a shuffle.

Defined results: a null text, or one without any letter, is ``und`` with score 0, as is every text if nothing could be learned; equal code
lengths go to the language first in order of name; rows with a null language, text or id teach nothing. Repeated rows are scored one
by one. Added columns replace columns of their names; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

START = 0  # the class of "before the text"; classes of bytes begin at 1, and the last one stands for bytes never learned
UNIT = 1 << 16
CHUNK, SLICE = 1 << 19, 1024  # bytes and texts that are scored at a time


@dataclass(frozen=True)
class Model:
    languages: list[str]
    order: int
    byte_class: np.ndarray  # class of each byte
    context_of: np.ndarray  # the last ``order`` classes, as one number -> the longest known context that ends them
    costs: np.ndarray  # [context * classes + class, language]

    @property
    def width(self) -> int:
        return len(self.costs) // (int(self.context_of.max()) + 1)


def teachers(df: DataFrame, text: str, lang: str, key: str, max_docs: int) -> DataFrame:
    """A sample of at most ``max_docs`` documents per language, expected, by a hash of the id. Only ids and languages are read to draw it."""
    known = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull())
    sizes = {r["l"]: r["n"] for r in known.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return known.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    grain = 1 << 30
    share = F.create_map(*[F.lit(v) for l, n in sorted(sizes.items()) for v in (l, min(grain, max_docs * grain // n))])
    drawn = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(grain)) < share[F.col(lang)]
    return known.filter(drawn).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))


def byte_counts(sample: DataFrame, order: int) -> DataFrame:
    """How often every sequence of ``order + 1`` bytes occurs per language, texts preceded by ``order`` zero bytes: (lang, seq, n).
    A sequence is a number of base 257, of byte values plus one; 0 stands before the text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = batch.column("text").to_pylist()
            for lang in sorted(set(langs)):
                parts = []
                for t in (texts[i] for i in np.flatnonzero(langs == lang)):
                    data = np.concatenate([np.zeros(order, np.int64), np.frombuffer(t, np.uint8).astype(np.int64) + 1])
                    seq = np.zeros(len(t), np.int64)
                    for k in range(order + 1):
                        seq = seq * 257 + data[k:k + len(t)]
                    parts.append(seq)
                seq, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seq), pa.string()), pa.array(seq), pa.array(n, pa.int64())], names=["lang", "seq", "n"])

    return sample.mapInArrow(count, "lang string, seq bigint, n bigint").groupBy("lang", "seq").agg(F.sum("n").alias("n"))


def context_costs(counts: list[np.ndarray], rest: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
    """Code lengths in bits of every byte class after some contexts. ``counts`` holds, longest context first, how often each class followed
    (contexts x classes); ``bytes_of`` is how many bytes a class stands for; ``rest`` marks the classes that can follow at all."""
    rows, width = counts[0].shape
    cost = np.zeros((rows, width))
    open_ = np.broadcast_to(rest, (rows, width)).copy()  # not yet coded
    escape = np.zeros(rows)
    for seen in counts:
        seen = np.where(open_, seen, 0)
        total, kinds = seen.sum(axis=1), (seen > 0).sum(axis=1)
        here = seen > 0
        whole = np.maximum(total + kinds, 1)
        cost = np.where(here, escape[:, None] - np.log2(np.where(here, seen, 1) / whole[:, None]), cost)
        escape = escape - np.log2(np.where(kinds > 0, np.maximum(kinds, 1) / whole, 1.0))
        open_ &= ~here
    left = np.maximum((open_ * bytes_of).sum(axis=1), 1)
    return np.where(open_, escape[:, None] + np.log2(left)[:, None], cost)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, max_table: int) -> Model:
    """Tables from the counts of byte sequences per language."""
    languages = sorted(counts)
    used = np.zeros(257, bool)
    for seq, _ in counts.values():
        for k in range(order + 1):
            used[np.unique(seq // 257 ** k % 257)] = True
    learned = np.flatnonzero(used[1:])  # byte values
    width = len(learned) + 2
    byte_class = np.full(256, width - 1, np.int32)
    byte_class[learned] = np.arange(1, len(learned) + 1)
    of_base = np.concatenate([[START], byte_class])
    bytes_of = np.ones(width)
    bytes_of[START], bytes_of[-1] = 0, 256 - len(learned)
    rest = np.ones(width, bool)
    rest[START], rest[-1] = False, len(learned) < 256

    # Sequences in classes, newest byte last, and the contexts of every length among them (all languages together).
    seqs = {l: (np.stack([of_base[s // 257 ** k % 257] for k in range(order, -1, -1)], axis=1), n) for l, (s, n) in counts.items()}
    contexts: list[np.ndarray] = [np.zeros(1, np.int64)]
    for k in range(1, order + 1):
        codes = [_code(s[:, order - k:order], width) for s, _ in seqs.values()]
        contexts.append(np.unique(np.concatenate(codes)))
    base = np.concatenate([[0, 1], 1 + np.cumsum([len(c) for c in contexts[1:]])])
    rows = int(base[-1])
    if (rows * width * len(languages) + width ** order) * 4 > max_table:
        raise ValueError(f"the tables would take over {max_table} bytes: lower max_docs or order")
    context_of = np.zeros(width ** order, np.int32)
    for k in range(1, order + 1):  # longer ones come later and replace shorter ones
        context_of.reshape(-1, width ** k)[:, contexts[k]] = base[k] + np.arange(len(contexts[k]))
    costs = np.zeros((rows, width, len(languages)), np.int32)
    for j, l in enumerate(languages):
        seq, n = seqs[l]
        following = []  # per length: sorted keys of (context, class) and their counts
        for m in range(order + 1):
            keys, inverse = np.unique(_code(seq[:, order - m:], width), return_inverse=True)
            following.append((keys, np.bincount(inverse, weights=n)))
        for k in range(order + 1):
            codes = contexts[k]
            for lo in range(0, len(codes), 4096):
                part = codes[lo:lo + 4096]
                seen = []
                for m in range(k, -1, -1):
                    want = (part % width ** m)[:, None] * width + np.arange(width)[None, :]
                    keys, values = following[m]
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    seen.append(np.where(keys[at] == want, values[at], 0.0))
                costs[base[k] + lo:base[k] + lo + len(part), :, j] = np.rint(context_costs(seen, rest, bytes_of) * UNIT)
    costs[:, START] = 0
    return Model(languages, order, byte_class, context_of, costs.reshape(rows * width, -1))


def _code(rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    for k in range(rows.shape[1]):
        out = out * width + rows[:, k]
    return out


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 3, max_docs: int = 1000,
          max_table: int = 256 << 20) -> Model | None:
    """A model of the languages in ``lang``; nothing if no row can teach one. ``order`` is 1 to 3."""
    if not 1 <= order <= 3:
        raise ValueError("order is 1 to 3")
    table = byte_counts(teachers(df, text, lang, key, max_docs), order).toArrow()  # bounded by the sample
    langs = np.array(table.column("lang").to_pylist(), dtype=object)
    seq, n = table.column("seq").to_numpy(), table.column("n").to_numpy()
    counts = {str(l): (seq[langs == l], n[langs == l]) for l in sorted(set(langs))}
    return build(counts, order, max_table) if counts else None


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code lengths (units of 2**-16 bit) of texts that lie one after the other in ``data``: texts x languages."""
    out = np.zeros((len(offsets) - 1, len(model.languages)), np.int64)
    starts = offsets[:-1]
    for lo in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        hi = min(lo + CHUNK, int(offsets[-1]))
        first = int(np.searchsorted(starts, lo, side="right")) - 1
        last = int(np.searchsorted(starts, hi, side="left")) - 1
        inside = starts[first:last + 1] - lo
        begins = inside[(inside > -model.order) & (inside < hi - lo)]
        code = np.zeros(hi - lo, np.int32)
        for k in range(model.order, 0, -1):  # the byte k places before, or START before the text
            back = np.full(hi - lo, START, np.int32)
            src = data[max(lo - k, int(offsets[0])):hi - k]
            back[hi - lo - len(src):] = model.byte_class[src]
            for d in range(k):
                at = begins + d
                back[at[(at >= 0) & (at < hi - lo)]] = START
            code = code * np.int32(model.width) + back
        cost = np.take(model.costs, model.context_of[code] * np.int32(model.width) + model.byte_class[data[lo:hi]], axis=0)
        ends = offsets[first + 1:last + 2] - lo
        held = (ends > 0) & (ends > np.maximum(inside, 0))  # texts with a byte in this chunk
        out[first:last + 1][held] += np.add.reduceat(cost, np.maximum(inside, 0)[held], axis=0, dtype=np.int64)
    return out


def predicted(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (share of the predicted language, 0 to 1) and ``bits`` (length of its code)."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "bits")]
    if model is None:
        return df.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    given = df.select(*kept, F.when(F.col(text).rlike("\\p{L}"), F.col(text).cast("binary")).alias("__text"))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    schema = T.StructType([f for f in given.schema.fields if f.name != "__text"] + added)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            texts = batch.column("__text").cast(pa.large_binary())
            none = texts.is_null().to_numpy(zero_copy_only=False)
            _, where, data = texts.buffers()
            offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
            bits = code_lengths(m, np.frombuffer(data or b"", np.uint8), offsets)
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
            least = bits[np.arange(len(bits)), best]
            share = 1.0 / np.exp2(-np.minimum((bits - least[:, None]) / UNIT, 1000.0)).sum(axis=1)
            names = np.array(m.languages, dtype=object)[best]
            names[none] = "und"
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(np.where(none, 0.0, share)),
                 pa.array(least / UNIT, mask=none)], names=[*kept, "lang_pred", "score", "bits"])

    return given.mapInArrow(score, schema)
