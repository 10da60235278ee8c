"""Merkle manifest of a dataset: a tree over the rows of every group, and one over the groups' roots.

Rows are leaves. Inside a group they stand in a given order; every ``FANOUT`` consecutive nodes become the digest of their digests, level by
level, until one is left: the group's root. These, in the order of the groups, make the dataset's root in the same way.

Each level is one slot pivot: conditional aggregates spread the children of a parent into ``FANOUT`` columns. All columns put together give the parent's
digest; the columns before and after a child's own are its siblings. Consecutive leaves lie side by side, so the map side already
brings most parents together, and a level is a sixteenth of the one below. Proofs are built from the root down: a parent's proof is
joined once and shared by its children, so whole proofs exist only in the rows given back and are never shuffled.

Positions are counted over a range partitioning: every task counts its own rows, and one small row per (group, task) says how many come before.
No group is held by one task, however large.

Defined results: a null group is a group and comes first; a null key comes first in its group; rows that repeat a key follow each other by digest, and rows
equal in all stand side by side. A null field counts as ``-``, an empty one as ``0:``. A group of one row has its leaf as root; an
empty table gives an empty result. Rows travel as one struct, so columns of any name come through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import numbered, stored

FANOUT = 16
PROOF = "array<struct<left:string,right:string>>"


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts, one after the other."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its size in bytes before it, so that no two lists of values look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, from the leaf's level up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _slots(slot: Column, value: Column) -> list[Column]:
    return [F.first(F.when(slot == k, value), ignorenulls=True).alias(f"c{k}") for k in range(FANOUT)]


def _level(nodes: DataFrame, *payload: str) -> DataFrame:
    """The parents of all nodes that are not the only one of their tree: ``key, n, parent`` and the children in columns ``c0 ... c15``."""
    slot = F.pmod(F.col("pos"), F.lit(FANOUT))
    child = F.struct("digest", *payload)
    return nodes.filter("n > 1").groupBy("key", "n", F.floor(F.col("pos") / FANOUT).alias("parent")).agg(*_slots(slot, child))


def _children() -> Column:
    return F.array(*[F.col(f"c{k}") for k in range(FANOUT)])


def _above(level: DataFrame) -> DataFrame:
    """The parents of a level as nodes."""
    every = F.array_join(F.transform(_children(), lambda c: c["digest"]), "")
    return level.select("key", F.ceil(F.col("n") / FANOUT).alias("n"), F.col("parent").alias("pos"), F.sha2(every.cast("binary"), 256).alias("digest"))


def _below(level: DataFrame, proofs: DataFrame, *carried: str) -> DataFrame:
    """The children of a level, each with its own siblings before the proof of its parent."""
    known = level.join(proofs.withColumnRenamed("pos", "parent"), ["key", "parent"])
    each = known.select("key", "parent", "proof", *carried, _children().alias("all"), F.posexplode(F.filter(_children(), lambda c: c.isNotNull())).alias("slot", "child"))
    digests = F.transform("all", lambda c: c["digest"])
    own = F.struct(F.array_join(F.slice(digests, F.lit(1), F.col("slot")), "").alias("left"),
                   F.array_join(F.slice(digests, F.col("slot") + 2, F.lit(FANOUT)), "").alias("right"))
    return each.select("key", (F.col("parent") * FANOUT + F.col("slot")).alias("pos"), F.concat(F.array(own), "proof").alias("proof"), *carried, "child")


def _tree(nodes: DataFrame, *payload: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels over ``nodes`` (``key, n, pos, digest``), the leaves' first, and the tops (``key, digest, height``)."""
    levels, tops = [], None
    while True:
        top = nodes.filter("n = 1").select("key", "digest", F.lit(len(levels)).alias("height"))
        tops = top if tops is None else tops.unionByName(top)
        if nodes.filter("n > 1").isEmpty():
            return levels, tops
        levels.append(stored(_level(nodes, *(payload if not levels else ())), "level"))
        nodes = stored(_above(levels[-1]), "nodes")


def _proofs(levels: list[DataFrame], tops: DataFrame, lowest: int) -> DataFrame:
    """``key, pos, subroot, proof`` of the nodes at height ``lowest``; ``tops`` have ``key, height, subroot, proof`` of every tree."""
    at = None
    for height in range(len(levels), lowest - 1, -1):
        here = tops.filter(F.col("height") == height).select("key", F.lit(0).cast("bigint").alias("pos"), "subroot", "proof")
        if height < len(levels):
            below = _below(levels[height], at, "subroot").select("key", "pos", "subroot", "proof")
            here = here.unionByName(below)
        at = here
    return at


def manifest(df: DataFrame, group: str, key: str, values: Sequence[str], carry: Sequence[Column] = ()) -> DataFrame:
    """``row`` (a struct of ``carry``, all columns where none are named), ``leaf``, ``subroot``, ``root`` and ``proof``, the siblings to the left and right at every level up to
    the root, for every row of ``df``; ``values`` name the columns that make up a leaf."""
    row = F.struct(*(carry or [F.col(c) for c in df.columns]))
    leaves = df.select(F.struct(F.col(group).cast("string").alias("g")).alias("key"), F.col(key).alias("order"), leaf([F.col(v) for v in values]).alias("digest"), row.alias("row"))
    placed = numbered(leaves, ["key"], ["order", "digest"])
    levels, tops = _tree(placed, "row")
    tops = stored(tops, "tops")
    groups = numbered(tops.select(F.struct(F.lit(0).alias("g")).alias("key"), F.col("key").alias("order"), "digest", "height"), ["key"], ["order"])
    over, root = _tree(groups, "order", "height")
    # The root is one digest; an empty table has none.
    top = root.select("digest").first()
    root_digest = F.lit(top["digest"] if top else None).cast("string")
    blank = F.array().cast(PROOF)
    if over:
        starts = root.select("key", "height", F.col("digest").alias("subroot"), blank.alias("proof"))
        of_group = _below(over[0], _proofs(over, starts, 1).select("key", "pos", "proof")).select(
            F.col("child.order").alias("key"), F.col("child.height").alias("height"), F.col("child.digest").alias("subroot"), "proof")
    else:
        of_group = tops.select("key", "height", F.col("digest").alias("subroot"), blank.alias("proof"))
    of_group = stored(of_group, "groups")
    single = placed.filter("n = 1").join(of_group, "key").select("row", F.col("digest").alias("leaf"), "subroot", "proof")
    out = single
    if levels:
        below = _below(levels[0], stored(_proofs(levels, of_group, 1), "proofs"), "subroot")
        out = single.unionByName(below.select("child.row", F.col("child.digest").alias("leaf"), "subroot", "proof"))
    return out.select("row", "leaf", "subroot", root_digest.alias("root"), "proof")
