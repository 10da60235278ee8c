"""Mixing sources to target weights by hierarchical budgets.

Documents hang on the leaves of a tree (domain, language, source). Weights are shares among siblings. A token budget
goes down the tree by weight; what a child cannot fill is shared out among its siblings, again by weight, and only what
none of them can fill goes back to the parent's siblings. A leaf can be read ``epochs`` times at most. Each
leaf reads whole epochs and then a prefix of one more, in an order given by a hash of (seed, epoch, document).

The prefix is found without ordering a leaf: tokens are summed per (leaf, range of the hash), the range in which the budget
ends follows from those sums, and only the rows of that one range are ordered. The result is a cut value per leaf, so
the documents themselves are filtered where they lie, by a join with one row per leaf.

Defined results: null domain, language or source are nodes of their own; a null or empty text has no tokens and comes with the
prefix or epoch that covers its hash; a leaf without any tokens gives no rows. Equal rows have equal hashes and are
taken all together or not at all. The document that would overrun the budget ends the prefix; it is taken if that comes nearer to the budget than to leave it. An empty table gives an
empty result. The added column ``epoch`` replaces one of that name; all others pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import stored, words

RANGE_BITS = 12
Path = tuple


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def shared_out(amount: int, room: Mapping[Path, int], weights: Mapping[Path, float]) -> dict[Path, int]:
    """Share ``amount`` among siblings by weight, none above its room; shortages go to those with room left."""
    given = {k: 0 for k in room}
    left = min(amount, sum(room.values()))
    open_ = sorted((k for k in room if room[k] > 0), key=repr)
    while left > 0 and open_:
        total = sum(weights.get(k, 1.0) for k in open_)
        if total <= 0:  # only children of weight 0 have room
            weights = {}
            continue
        full = [k for k in open_ if left * weights.get(k, 1.0) / total >= room[k] - given[k]]
        if full:
            for k in full:
                step = min(left, room[k] - given[k])
                given[k] += step
                left -= step
            open_ = [k for k in open_ if k not in set(full)]
            continue
        parts = {k: left * weights.get(k, 1.0) / total for k in open_}
        for k in open_:
            given[k] += int(parts[k])
        left -= sum(int(p) for p in parts.values())
        for k in sorted(open_, key=lambda k: (int(parts[k]) - parts[k], repr(k))):
            if left > 0 and given[k] < room[k] and weights.get(k, 1.0) > 0:
                given[k] += 1
                left -= 1
        break
    return given


def leaf_budgets(tokens: Mapping[Path, int], weights: Mapping[Path, float], total: int, epochs: int) -> dict[Path, int]:
    """Budgets of the leaves. ``weights`` maps a path, from the root down, to its share among its siblings (1 if absent)."""
    if not tokens:
        return {}
    depth = max(map(len, tokens))
    room: list[dict[Path, int]] = [{} for _ in range(depth + 1)]
    for path, n in tokens.items():
        for d in range(depth + 1):
            room[d][path[:d]] = room[d].get(path[:d], 0) + n * epochs
    given = {(): min(total, room[0].get((), 0))}
    for d in range(1, depth + 1):
        below: dict[Path, dict[Path, int]] = {}
        for path, n in room[d].items():
            below.setdefault(path[:-1], {})[path] = n
        given = {k: v for parent, children in below.items() for k, v in shared_out(given[parent], children, weights).items()}
    return given


def _leaf(levels: Sequence[str]) -> Column:
    """The path as one struct: never null, and equal nulls are equal."""
    return F.struct(*[F.col(c).cast("string").alias(f"l{i}") for i, c in enumerate(levels)])


def mixed(df: DataFrame, levels: Sequence[str], weights: Mapping[Path, float], total: int | float, epochs: int = 1, seed: int = 0,
          key: str = "doc_id", text: str = "text", tokens=token_count) -> DataFrame:
    """The documents of the mixture, once for every epoch that takes them, with the column ``epoch``.

    ``total`` is a number of tokens, or as a float a share of all tokens. The driver holds one entry per leaf.
    """
    spark = df.sparkSession
    rows = stored(df.select(_leaf(levels).alias("leaf"), F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"),
                            tokens(F.col(text)).alias("n")), "tokens")
    have = {tuple(r["leaf"]): r["n"] for r in rows.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    wanted = total if isinstance(total, int) else int(total * sum(have.values()))
    budget = leaf_budgets({p: n for p, n in have.items() if n}, weights, wanted, epochs)
    plan = [(p, budget[p] // have[p], budget[p] % have[p]) for p in sorted(budget, key=repr)]
    shape = "leaf struct<" + ", ".join(f"l{i}: string" for i in range(len(levels))) + ">, full int, rest bigint"
    leaves = spark.createDataFrame(plan, shape)

    h = F.xxhash64(F.lit(seed), F.col("full"), F.col("k"), F.col("t"))
    open_ = rows.join(leaves.filter("rest > 0"), "leaf").withColumn("h", h).withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    sums = open_.groupBy("leaf", "rest", "range").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = (sums.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") > F.col("rest"))
            .groupBy("leaf").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("before")), "range").alias("e"))
            .select("leaf", "e.range", "e.before"))
    ends = stored(ends, "ends")  # so that the join below is dealt by leaf and range, not by leaf alone
    peers = Window.partitionBy("leaf").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # What ends at or before the budget, and what crosses it if less is too much than would be missing.
    over, missing = F.col("upto") - F.col("rest"), F.col("rest") - (F.col("upto") - F.col("equal"))
    last = (open_.join(ends, ["leaf", "range"])
            .withColumn("upto", F.col("before") + F.sum("n").over(peers)).withColumn("equal", F.sum("n").over(Window.partitionBy("leaf", "h")))
            .filter((over <= 0) | ((missing > 0) & (over < missing))).groupBy("leaf").agg(F.max("h").alias("h")))
    below = F.shiftleft(F.col("range").cast("bigint"), 64 - RANGE_BITS) - 1
    none = F.col("range") == -(2 ** (RANGE_BITS - 1))  # the prefix ends in the lowest range: nothing lies below it
    cuts = stored(leaves.join(ends, "leaf", "left").join(last, "leaf", "left").select(
        "leaf", "full", F.coalesce("h", F.when(~none, below)).alias("cut")), "cuts")

    own = F.xxhash64(F.lit(seed), F.col("__full"), F.col(key), F.xxhash64(F.col(text)))
    kept = [c for c in df.columns if c != "epoch"]
    named = df.select(*kept, _leaf(levels).alias("__leaf"))
    out = named.join(cuts.select(F.col("leaf").alias("__leaf"), F.col("full").alias("__full"), F.col("cut").alias("__cut")), "__leaf")
    times = F.col("__full") + F.when(own <= F.col("__cut"), 1).otherwise(0)
    return (out.withColumn("__times", times).filter("__times > 0")
            .select(*kept, F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("epoch")))
