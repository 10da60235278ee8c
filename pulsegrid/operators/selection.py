"""Order, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keys import join_on, keyed


def history(df: DataFrame, order: Sequence[str], limit: int, cap: int, where: Column | None = None) -> DataFrame:
    """Latest rows first; the limit is clamped to 1…cap."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, min(limit, cap)))


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (ascending columns)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b")).select(*by, "__b.*")


def top_k(df: DataFrame, measure: Column, k: int, ties: Sequence[str]) -> DataFrame:
    return df.withColumn("__m", measure).orderBy(F.col("__m").desc(), *ties).limit(k).drop("__m")


def last_n(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int, salts: int = 32) -> DataFrame:
    """The last ``n`` rows of each key. Each of ``salts`` parts of a key keeps its own last ``n`` first, so
    the final ranking sees at most n x salts rows of a key."""
    desc = [F.col(c).desc() for c in order]
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    first = part.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*desc))).filter(F.col("__r") <= n)
    return first.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*desc))).filter(F.col("__r") <= n).drop("__r", "__salt")


def seeded_sample(df: DataFrame, key: Sequence[str], size: int, seed: int = 7) -> DataFrame:
    """A repeatable random sample of at most ``size`` rows, chosen by a hash of the key and the seed."""
    return df.withColumn("__h", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))), 256)) \
        .orderBy("__h", *key).limit(size).drop("__h")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with differing columns; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
