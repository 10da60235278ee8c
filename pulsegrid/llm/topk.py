"""Exact top-k inner products with bounds from segment statistics, coarse to fine.

Vectors are cut into equal segments. With a segment's mean m and deviation s, the Cauchy-Schwarz inequality bounds the
product over a segment of width w by w * (m * m' + s * s'); as |a-b|^2 = |a|^2 + |b|^2 - 2ab, an upper bound on the product
is a lower bound on the distance. One segment gives the coarsest bound, twice as many segments a finer one. A pair
goes on to the next level only while its bound reaches the k-th best exact score its query has so far; survivors of the
finest level are scored exactly.

The stated queries meet all candidates in blocks: both sides are dealt to (query block, candidate block) cells of bounded
size, each cell keeps k per query, and the cells' answers are merged by a ranking per query. The number of cells
follows the input, so no side is broadcast and no task holds more than two blocks.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; vectors meet only vectors
of the same length; equal scores are ordered by the smaller id. Rows with a null id take no part. Rows that repeat an id are
candidates each on their own, except for the query's own id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

SAFE = 2.0 ** 52  # integers up to here are exact in double arithmetic


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of sqrt(w) * (mean, deviation) per segment; the product of two such rows bounds the vectors' product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, devs = [], []
    for a, b in zip(edges[:-1], edges[1:]):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        means.append(math.sqrt(b - a) * mean)
        devs.append(np.sqrt(np.square(part - mean[:, None]).sum(axis=1)))
    return np.column_stack(means + devs)


def best_of_block(q_ids, q, c_ids, c, k: int, levels=(1, 4, 16)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of every query in a block, as (query row, candidate row, score), exactly."""
    exact_in_double = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * q.shape[1] < SAFE
    whole = None if exact_in_double else ([[int(v) for v in row] for row in q], [[int(v) for v in row] for row in c])
    coarse_q, coarse_c = zip(*[(segment_features(q, n), segment_features(c, n)) for n in levels])
    slack = 1e-9 * (np.sqrt(np.square(q).sum(axis=1))[:, None] * np.sqrt(np.square(c).sum(axis=1)).max(initial=0.0)) + 1e-9

    def scores(i: int, rows: np.ndarray) -> np.ndarray:
        if exact_in_double:
            return (c[rows] @ q[i]).astype(np.int64)
        return np.array([sum(a * b for a, b in zip(whole[0][i], whole[1][r])) for r in rows], dtype=object)

    out_q, out_c, out_s = [], [], []
    for lo in range(0, len(q), 256):  # bounds of 256 queries at a time
        bounds = coarse_q[0][lo:lo + 256] @ coarse_c[0].T
        for i in range(lo, min(lo + 256, len(q))):
            bound = bounds[i - lo] + slack[i, 0]
            others = np.flatnonzero(c_ids != q_ids[i])
            if not len(others):
                continue
            # the most promising by a finer bound give a first k-th best score
            finer = coarse_c[1][others] @ coarse_q[1][i] + slack[i, 0]
            first = others[np.argpartition(-finer, min(4 * k, len(others)) - 1)[:4 * k]]
            got = scores(i, first)
            floor = np.sort(got)[-k] if len(got) >= k else None
            alive = others
            if floor is not None:
                alive = others[(bound[others] >= floor) & (finer >= floor)]
                for level in range(2, len(levels)):
                    alive = alive[coarse_c[level][alive] @ coarse_q[level][i] + slack[i, 0] >= floor]
            exact = scores(i, alive)
            order = np.lexsort((c_ids[alive], -exact.astype(np.float64)))[:k] if exact_in_double else np.array(
                sorted(range(len(alive)), key=lambda j: (-exact[j], c_ids[alive[j]]))[:k], dtype=int)
            out_q.append(np.full(len(order), i))
            out_c.append(alive[order])
            out_s.append(exact[order])
    if not out_q:
        return np.array([], int), np.array([], int), np.array([], np.int64)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s).astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


OUT = "query_id bigint, vec_id bigint, score bigint"


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64,
           query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer products over all other rows."""
    rows = (df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
            .filter(F.col("id").isNotNull() & usable(F.col("v")))
            .select("id", F.coalesce("q", F.lit(False)).alias("q"), F.size("v").alias("dim"), quantised(F.col("v"), scale).alias("v")))
    total, asked = df.select(F.count("*"), F.count_if(is_query)).first()
    cells_c, cells_q = max(1, math.ceil(total / candidate_block)), max(1, math.ceil(asked / query_block))
    spread = F.xxhash64("id", "v")
    candidates = rows.withColumn("cb", F.pmod(spread, F.lit(cells_c)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(cells_q - 1)))).select("dim", "qb", "cb", "id", "v")
    questions = rows.filter("q").withColumn("qb", F.pmod(spread, F.lit(cells_q)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(cells_c - 1)))).select("dim", "qb", "cb", "id", "v")

    def cell(asking: pa.Table, given: pa.Table) -> pa.Table:
        ids_q = asking.column("id").to_numpy()
        ids_c = given.column("id").to_numpy()
        if len(ids_q) and len(ids_c):
            i, j, s = best_of_block(ids_q, _matrix(asking.column("v")), ids_c, _matrix(given.column("v")), k)
        else:
            i = j = s = np.array([], np.int64)
        return pa.table({"query_id": pa.array(ids_q[i], pa.int64()), "vec_id": pa.array(ids_c[j], pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ("dim", "qb", "cb")
    found = questions.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(cell, OUT)
    # Rows that repeat a query's id ask the same question or another one; either way the best k of all stay.
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
