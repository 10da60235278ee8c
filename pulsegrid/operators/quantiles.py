"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. Here a first pass counts a group's
values by an order-preserving code, combined map-side: the shuffle carries one row per code, however many values
there are. The counts give the buckets in which the wanted ranks fall. A bucket whose wanted ranks are its first or last
value is settled by its smallest and largest value, which the first pass keeps: so are nearly all of small groups. For the
others a second pass reads the values again and keeps those of these buckets, told by a bitmap of fixed size before
anything is shuffled; only these are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keys import PACKED, col, join_on, keyed, packed, spare, unpacked, value_code

# Position rules: 0-based, possibly fractional, position of the answer among n sorted values.


def linear(q) -> Callable[[Column], Column]:
    return lambda n: (n - 1) * F.lit(float(q))


def nearest(q) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.ceil(n * F.lit(float(q))), F.lit(1)) - 1


def floored(q) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.floor(n * F.lit(float(q))), F.lit(1)) - 1


def rounded(q) -> Callable[[Column], Column]:
    return lambda n: F.bround((n - 1) * F.lit(float(q)))


def upper_middle() -> Callable[[Column], Column]:
    return lambda n: F.floor(n / 2)


def top_share_median(share: float) -> Callable[[Column], Column]:
    """Median of the largest ``share`` of the values (at least one)."""
    def position(n: Column) -> Column:
        k = F.greatest(F.lit(1), F.ceil(n * F.lit(share)))
        return (n - k) + (k - 1) * F.lit(0.5)
    return position


Spec = tuple  # (value column, q or position rule)


def _rule(q):
    return q if callable(q) else linear(q)


def quantiles(df: DataFrame, by: Sequence[str], specs: Mapping[str, Spec]) -> DataFrame:
    """One row per key, one column per spec ``name -> (value, q)``; nulls and NaN are skipped.

    Groups in which a spec has no value get null, and groups without any value do not appear.
    """
    df, keys = keyed(df, by)
    found = _quantiles(df.select("*", packed(keys)), specs)
    return found.select(*unpacked(keys), *specs).drop(*spare(by))


STEPS = 1024  # codes per octave of the first pass
WORDS = 1 << 14  # words of 64 bits in the marks of the chosen buckets


def _place() -> Column:
    return F.pmod(F.xxhash64(PACKED, "__m", "__b"), F.lit(WORDS * 64))


def _marks(chosen: DataFrame) -> Column:
    """A bitmap of fixed size (128 KB) over the hashes of the chosen buckets, as a scalar subquery."""
    bits = chosen.select(F.shiftright(_place(), 6).alias("__w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(_place(), F.lit(64)).cast("int")).alias("__o"))
    every = chosen.sparkSession.range(0, WORDS, 1, 1).select(F.col("id").alias("__w"), F.lit(0).cast("bigint").alias("__o"))
    words = bits.unionByName(every).groupBy("__w").agg(F.bit_or("__o").alias("__o"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("__w", "__o"))), lambda x: x["__o"])).scalar()


def _marked(marks: Column) -> Column:
    """Whether a row may lie in a chosen bucket: never false for one that does."""
    word = F.get(marks, F.shiftright(_place(), 6).cast("int"))
    return F.getbit(word, F.pmod(_place(), F.lit(64)).cast("int")) == 1


def _quantiles(df: DataFrame, specs: Mapping[str, Spec]) -> DataFrame:
    """``quantiles`` of a frame whose keys are packed; every step shares that key."""
    values: list[Column] = []
    texts: list[str] = []
    which: dict[str, int] = {}
    for name, (value, _) in specs.items():
        text = str(col(value))
        if text not in texts:
            texts.append(text)
            values.append(col(value).cast("double"))
        which[name] = texts.index(text)
    if len(values) == 1:
        rows = df.select(PACKED, F.lit(0).alias("__m"), (values[0] + F.lit(0.0)).alias("__v"))
    else:
        rows = df.select(PACKED, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), v.alias("v"))
                                                     for i, v in enumerate(values)])).alias("__x"))
        rows = rows.select(PACKED, F.col("__x.m").alias("__m"), (F.col("__x.v") + F.lit(0.0)).alias("__v"))
    rows = rows.filter(F.col("__v").isNotNull() & ~F.isnan("__v")) \
        .withColumn("__b", value_code("__v", STEPS))
    buckets = rows.groupBy(PACKED, "__m", "__b").agg(F.count(F.lit(1)).alias("__bn"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    group = W.partitionBy(PACKED, "__m")
    ordered = group.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = buckets.withColumn("__total", F.sum("__bn").over(group)) \
        .withColumn("__upto", F.sum("__bn").over(ordered))

    def position(name):
        return _rule(specs[name][1])(F.col("__total")).cast("double")

    def wanted(name, rank):
        return (F.col("__m") == which[name]) & (rank >= F.col("__below")) & (rank < F.col("__upto"))

    def end(rank):
        """The value at a rank where the ends of its bucket tell it."""
        return F.when((rank <= F.col("__below")) | (F.col("__min") == F.col("__max")), F.col("__min")).when(rank >= F.col("__upto") - 1, F.col("__max"))

    ranks = [(n, f(position(n))) for n in specs for f in (F.floor, F.ceil)]
    chosen = buckets.withColumn("__below", F.col("__upto") - F.col("__bn")).filter(reduce(lambda a, b: a | b, [wanted(n, r) for n, r in ranks])) \
        .select(PACKED, "__m", "__b", "__total", "__upto", "__below", "__min", "__max")
    unsettled = chosen.filter(reduce(lambda a, b: a | b, [wanted(n, r) & end(r).isNull() for n, r in ranks]))
    counted = rows.filter(_marked(_marks(unsettled))).groupBy(PACKED, "__m", "__b", "__v").agg(F.count(F.lit(1)).alias("__n"))
    near = chosen.join(counted, [PACKED, "__m", "__b"], "left")
    inside = W.partitionBy(PACKED, "__m", "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = near.withColumn("__end", F.col("__below") + F.sum("__n").over(inside))

    def at(name, rank):
        # The smallest value that reaches the rank. A value computed anew may differ in its last bit and lie in the next bucket; the
        # bucket's largest value then stands for it.
        here = wanted(name, rank)
        return F.coalesce(F.min(F.when(here, end(rank))), F.min(F.when(here & (rank < F.col("__end")), F.col("__v"))), F.max(F.when(here, F.col("__max"))))

    parts = []
    for n in specs:
        p = position(n)
        parts += [at(n, F.floor(p)).alias(f"__lo_{n}"), at(n, F.ceil(p)).alias(f"__hi_{n}"),
                  F.max(F.when(F.col("__m") == which[n], p - F.floor(p))).alias(f"__fr_{n}")]
    found = near.groupBy(PACKED).agg(*parts)
    return found.select(PACKED, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__fr_{n}")).alias(n) for n in specs])


def summarise(df: DataFrame, by: Sequence[str], aggs: Mapping[str, Column], specs: Mapping[str, Spec] | None = None,
              digits: int | None = None, approx: bool = False) -> DataFrame:
    """Grouped aggregates and exact quantiles side by side, one row per key.

    ``approx`` answers the quantiles from a bounded sketch inside the same aggregation instead.
    """
    specs = dict(specs or {})
    base, keys = keyed(df, by)
    if approx and specs:
        aggs = {**aggs, **{n: F.percentile_approx(col(v), F.lit(float(q)), 10000) for n, (v, q) in specs.items()}}
        specs = {}
    base = base.select("*", packed(keys))
    out = base.groupBy(PACKED).agg(*[c.alias(n) for n, c in aggs.items()]) if aggs \
        else base.select(PACKED).distinct()
    if specs:
        out = out.join(_quantiles(base, specs), PACKED, "left")
    out = out.select(*unpacked(keys), *aggs, *specs)
    if digits is not None:
        kinds = dict(out.dtypes)
        out = out.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in keys else F.col(c)
                           for c in out.columns])
    return out.drop(*spare(by))


def average_rank(df: DataFrame, by: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Add the average rank of each value within its key (ties share their mean rank; nulls rank null)."""
    from .ordered import running

    out = df
    for name, value in values.items():
        counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
        placed = running(counted, by, [value], {"__before": F.col("__n")}, slice_col=value_code(value), strict=True)
        ranks = placed.select(*by, F.col(value), (F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
        out = join_on(out, ranks, [*by, value], "left")
    return out
