"""Boosted regression trees over binned rows, all targets at once.

Features are cut into ``bins`` by their quantiles once. Rows travel as blocks that stay cached on the executors: the bins of several features share one
number of 16 bits, beside what the trees so far leave of the targets. Tasks are as many as the cores keep busy, whatever the rows: every job of a level
costs its tasks' start. A tree grows level by level: every task adds up, for its blocks, the residuals and rows of each (target, node, cell), a cell
being the bins of the features that share a number; each feature's own sums come from these once a task. Of the two children of a node only the one of fewer rows
is added up, the other is what its parent has besides. The sums, whose size depends on the depth, the features and the bins but not on the rows, go to the driver, which
picks the best cut of every node. One job per level serves all targets. Residuals are written anew every few rounds; the chain of these is cut by
checkpoints, so a lost executor costs a few rounds of one block; the one before is deleted then.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .keys import delete_folder, shared_folder
from .quantiles import quantiles

BLOCK_ROWS, STORED_ROWS = 1 << 16, 1 << 12  # rows worked on at once, and of a block as it is cached: short ones pass to the workers faster
TASK_ROWS, MOST_ROWS = 1 << 14, 1 << 20  # fewest rows of a task, and most where there are more than the cores want
BITS = 10  # bits that features share, fewer where trees are deep; a feature has 8 at most
NODES = 64  # up to so many nodes of a level are told apart one after the other
HOLD, CUT = 3, 10  # rounds between written residuals; written residuals between checkpoints


class Trees:
    """What was learned: medians for gaps, cut points, first guesses, and per round and target one tree as arrays over its nodes (the children of node i are 2i and 2i + 1)."""

    def __init__(self, features: list[str], targets: list[str], medians: np.ndarray, edges: list[np.ndarray], start: np.ndarray, step: float, depth: int):
        self.features, self.targets, self.medians, self.edges, self.start, self.step, self.depth = features, targets, medians, edges, start, step, depth
        self.rounds: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), self.medians, x)
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(self.edges) else np.zeros((len(x), 0), np.uint8)

    def predicted(self, bins: np.ndarray) -> np.ndarray:
        return self.start + added(np.ascontiguousarray(bins.T), self.rounds, self.step, self.depth)


class Columns:
    """The bins of one feature after the other, taken out of the shared numbers as they are asked for."""

    def __init__(self, codes: np.ndarray, fields: list[tuple[int, int, int]]):
        self.codes, self.fields, self.taken, self.shape = codes, fields, {}, (len(fields), codes.shape[1])

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self.taken:
            which, shift, bits = self.fields[k]
            self.taken[k] = (self.codes[which] >> shift & ((1 << bits) - 1)).astype(np.uint8)
        return self.taken[k]


def shared(widths: list[int], room: int = BITS) -> list[tuple[int, int, int]]:
    """Where each feature's bins lie: (number, shift, bits), features of many bins placed first, up to ``room`` bits a number."""
    used: list[int] = []
    fields: list = [None] * len(widths)
    for k in sorted(range(len(widths)), key=lambda k: -widths[k]):
        bits = max(1, (widths[k] - 1).bit_length())
        which = next((i for i, u in enumerate(used) if u + bits <= room), len(used))
        used += [0] * (which == len(used))
        fields[k] = which, used[which], bits
        used[which] += bits
    return fields


def coded(bins: np.ndarray, fields: list[tuple[int, int, int]]) -> np.ndarray:
    """``bins`` (row, feature) as the shared numbers, one after the other."""
    codes = np.zeros((1 + max(f[0] for f in fields), len(bins)), np.uint16)
    for k, (which, shift, _) in enumerate(fields):
        codes[which] |= bins[:, k].astype(np.uint16) << shift
    return codes


def walked(columns, tree: tuple, levels: int) -> np.ndarray:
    """The node of every row after ``levels`` cuts; ``columns`` holds the bins of one feature after the other."""
    feature, cut = tree[0], tree[1]
    n = columns.shape[1]
    at = np.ones(n, np.uint8 if levels < 8 else np.uint16 if levels < 15 else np.int64)
    beyond, here = np.empty(n, bool), np.empty(n, bool)
    for level in range(levels):
        if 1 << level > NODES:
            whole = columns if isinstance(columns, np.ndarray) else np.stack([columns[k] for k in range(len(columns.fields))])
            right = whole[feature[at], np.arange(n)] > cut[at]
        else:
            right = np.zeros(n, bool)
            for i in range(1 << level, 2 << level):
                if cut[i] < 255:
                    np.greater(columns[int(feature[i])], int(cut[i]), out=beyond)
                    if level:
                        beyond &= np.equal(at, i, out=here)
                    right |= beyond
        at *= 2
        at += right
    return at


def added(columns: np.ndarray, rounds: list, step: float, depth: int) -> np.ndarray:
    """What some rounds of trees add to the predictions, one column a target."""
    total = np.zeros((columns.shape[1], 1))
    for trees in rounds:
        total = total + step * np.stack([t[2][walked(columns, t, depth)] for t in trees], axis=1)
    return total


def _grown(sums: np.ndarray, trees: list, level: int) -> np.ndarray:
    """Cut every node of a level where its residuals part best, and tell whether its right child is the smaller one. ``sums``: target, node, feature, bin,
    (rows, residuals). Cuts that differ by no more than the rounding of sums are equal, and the first of them is taken."""
    first = 1 << level
    small = np.zeros((len(trees), first), bool)
    for t, (feature, cut, value) in enumerate(trees):
        left = np.cumsum(sums[t], axis=2)  # node, feature, bin, 2
        whole = left[:, :1, -1:, :]
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[..., 1] ** 2 / whole[..., 0]
        gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, -np.inf)
        for node in range(len(sums[t])):
            rows, total = whole[node, 0, 0]
            mean = total / rows if rows else 0.0
            i = first + node
            most = gain[node].max() if gain[node].size else -np.inf
            if rows and most > 1e-12:
                f, b = divmod(int((gain[node] >= most - 1e-10 * most - 1e-13 * total * mean).argmax()), sums.shape[3])
                feature[i], cut[i] = f, b
                value[2 * i], value[2 * i + 1] = left[node, f, b, 1] / left[node, f, b, 0], right[node, f, b, 1] / right[node, f, b, 0]
                small[t, node] = right[node, f, b, 0] < left[node, f, b, 0]
            else:  # all rows go left and keep the node's mean
                value[2 * i] = value[2 * i + 1] = mean
                small[t, node] = True
    return small


def _parted(sums: np.ndarray, got: np.ndarray, small: np.ndarray) -> np.ndarray:
    """The sums of a level's nodes from those of the level before and of each pair's smaller child."""
    out = np.empty((sums.shape[0], 2 * sums.shape[1], *sums.shape[2:]))
    right = small[:, :, None, None, None]
    out[:, ::2], out[:, 1::2] = np.where(right, sums - got, got), np.where(right, got, sums - got)
    return out


def _summed(blocks: Iterator, fields: list, pending: list, trees: list, small: np.ndarray | None, counted: bool, width: int, step: float, depth: int) -> Iterator[np.ndarray]:
    """Sums of the whole (``small`` is None; rows only if ``counted``) or of the smaller child of every node of the level before."""
    level = 0 if small is None else small.shape[1].bit_length()
    slots = 1 if small is None else small.shape[1]
    room = max(shift + bits for _, shift, bits in fields)
    cells, parts = slots << room, None
    for codes, rests in joined(blocks):
        columns = Columns(codes, fields)
        if parts is None:
            parts = np.zeros((len(rests), len(codes), 2, cells))
        if not level:
            codes = codes.astype(np.int64)
        for t, tree in enumerate(trees):
            chosen, own, rest = None, columns, rests[t]
            if level:
                place = np.full(2 << level, slots, np.uint16)
                place[2 * np.arange(slots, 2 * slots) + small[t]] = np.arange(slots)
                slot = place.take(walked(columns, tree, level), mode="clip")
                chosen = np.flatnonzero(slot < slots)
                own, rest = Columns(codes.take(chosen, axis=1), fields), rest.take(chosen)
            rest = remaining(own, rest, pending, t, step, depth)
            own = own.codes if level else codes
            if np.isnan(rest.sum()):  # rows without this target
                known = np.flatnonzero(~np.isnan(rest))
                chosen, own, rest = known if chosen is None else chosen[known], own.take(known, axis=1), rest[known]
            if level:
                first = slot.take(chosen).astype(np.int64) << room
                cell = np.empty_like(first)
            for k, code in enumerate(own):
                code = np.add(first, code, out=cell) if level else code
                if level or counted:
                    parts[t, k, 0] += np.bincount(code, minlength=cells)
                parts[t, k, 1] += np.bincount(code, rest, cells)
    if parts is not None:
        out = np.zeros((len(parts), slots, len(fields), width, 2))
        for k, (which, shift, bits) in enumerate(fields):
            own = parts[:, which].reshape(len(parts), 2, slots, -1, 1 << bits, 1 << shift).sum(axis=(3, 5))
            n = min(width, 1 << bits)
            out[:, :, k, :n] = np.moveaxis(own, 1, 3)[:, :, :n]
        yield out


def remaining(columns: Columns, rest: np.ndarray, pending: list, t: int, step: float, depth: int) -> np.ndarray:
    """What ``pending`` rounds leave of one target's residuals."""
    for trees in pending:
        rest = rest - (step * trees[t][2]).take(walked(columns, trees[t], depth), mode="clip")
    return rest


def joined(blocks: Iterator) -> Iterator[tuple]:
    """Cached blocks put together to blocks of up to ``BLOCK_ROWS`` rows. The memory of one is used again for the next."""
    room, n = None, 0
    for block in blocks:
        rows, done = block[0].shape[1], 0
        if room is None:
            room = [np.empty((len(x), BLOCK_ROWS), x.dtype) for x in block]
        while done < rows:
            take = min(rows - done, BLOCK_ROWS - n)
            for x, r in zip(block, room):
                r[:, n:n + take] = x[:, done:done + take]
            done, n = done + take, n + take
            if n == BLOCK_ROWS:
                yield tuple(room)
                n = 0
    if n:
        yield tuple(r[:, :n] for r in room)


def _left(blocks: Iterator, fields: list, pending: list, step: float, depth: int) -> Iterator[tuple]:
    for codes, rests in joined(blocks):
        columns = Columns(codes, fields)
        rests = np.stack([remaining(columns, rests[t], pending, t, step, depth) for t in range(len(rests))])
        for at in range(0, codes.shape[1], STORED_ROWS):
            yield codes[:, at:at + STORED_ROWS].copy(), rests[:, at:at + STORED_ROWS].copy()


def task_count(rows: int, cores: int) -> int:
    """Tasks of a job: two a core where there are rows enough, more only where a task would get more than ``MOST_ROWS``."""
    return max(1, min(-(-rows // TASK_ROWS), max(2 * cores, -(-rows // MOST_ROWS))))


def fit_trees(train: DataFrame, features: Sequence[str], targets: Sequence[str], *, rounds: int = 200, step: float = 0.05, depth: int = 4, bins: int = 32) -> Trees:
    """Trees for all ``targets``; a row without some target counts for the others. Gaps in features are filled by exact medians."""
    features, targets = list(features), list(targets)
    spark = train.sparkSession
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *targets])])
    rows = rows.select(*[F.nanvl(c, F.lit(None)).alias(c) for c in rows.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    means = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(y).alias(f"m{i}") for i, y in enumerate(targets)], *[F.count(f).alias(f"k{i}") for i, f in enumerate(features)]).first()
    gaps = [f for i, f in enumerate(features) if means[f"k{i}"] < means["n"]]  # only these need a median
    got = quantiles(rows, [], {f: (f, .5) for f in gaps}).first() if gaps else None
    medians = np.array([0.0 if got is None or f not in gaps or got[f] is None else got[f] for f in features])
    cuts = rows.approxQuantile(features, [k / bins for k in range(1, bins)], 0.001) if features else []
    edges = [np.unique(np.array(c, float)) for c in cuts]
    start = np.array([means[f"m{i}"] or 0.0 for i in range(len(targets))])
    model = Trees(features, targets, medians, edges, start, step, depth)
    width = max([len(e) + 1 for e in edges], default=1)
    fields = shared([len(e) + 1 for e in edges], max(8, min(BITS, 15 - depth)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list) -> pa.RecordBatch:
            bins, y = (np.concatenate(p) for p in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([coded(bins, fields).tobytes()], pa.binary()), pa.array([(y - start).T.tobytes()], pa.binary())], names=["n", "x", "y"])

        parts, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, STORED_ROWS):
                part = batch.slice(at, STORED_ROWS).to_pandas()
                parts.append((model.binned(part[features].to_numpy(float)), part[targets].to_numpy(float)))
                rows += len(part)
                if rows >= STORED_ROWS:
                    yield block(parts)
                    parts, rows = [], 0
        if rows:
            yield block(parts)

    def unpacked(r) -> tuple:
        return np.frombuffer(r["x"], np.uint16).reshape(-1, r["n"]), np.frombuffer(r["y"]).reshape(-1, r["n"])

    if not features or not means["n"]:
        rows.unpersist()
        return model
    cores = spark.sparkContext.defaultParallelism
    tasks = task_count(means["n"], cores)
    shared_folder(spark)
    held = rows.repartition(tasks).mapInArrow(packed, "n bigint, x binary, y binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    pending, old, written, folders, counts = [], rows, 0, [], None
    for k in range(rounds):
        trees = [(np.zeros(1 << depth, np.int64), np.full(1 << depth, 255, np.int64), np.zeros(2 << depth)) for _ in targets]
        sums = small = None
        for level in range(depth):
            job = held.coalesce(min(tasks, cores)).mapPartitions(lambda b, pending=list(pending), trees=trees, small=small, counted=counts is None: _summed(b, fields, pending, trees, small, counted, width, step, depth))
            got = job.treeReduce(operator.add) if min(tasks, cores) > 64 else job.reduce(operator.add)
            if level:
                sums = _parted(sums, got, small)
            else:  # the rows of all bins are the same in every round
                counts, sums = got[..., :1] if counts is None else counts, got
                sums[..., :1] = counts
            small = _grown(sums, trees, level)
            if old is not None:
                old.unpersist()
                old = None
                if held.isCheckpointed():
                    folders.append(held.getCheckpointFile())
                    for done in folders[:-1]:
                        delete_folder(spark, done)
                    folders = folders[-1:]
        model.rounds.append(trees)
        pending.append(trees)
        if len(pending) == HOLD:
            old, written = held, written + 1
            held = held.mapPartitions(lambda b, pending=list(pending): _left(b, fields, pending, step, depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if written % CUT == 0:
                held.checkpoint()
            pending = []
    held.unpersist()
    if old is not None:
        old.unpersist()
    for done in folders:
        delete_folder(spark, done)
    return model


def with_predictions(model: Trees, df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``df`` with the prediction of each target under a name of ``names``."""
    held = df.sparkSession.sparkContext.broadcast(model)  # rounds x targets x nodes numbers, whatever the rows
    where = [model.targets.index(t) for t in names]

    @F.pandas_udf("array<double>")
    def predicted(x: pd.DataFrame) -> pd.Series:
        m = held.value
        return pd.Series(list(m.predicted(m.binned(x.to_numpy(float, na_value=np.nan)))[:, where]))

    out = df.withColumn("__p", predicted(F.struct(*[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f"f{i}") for i, f in enumerate(model.features)])))
    return out.withColumns({name: F.col("__p")[i] for i, name in enumerate(names.values())}).drop("__p")
