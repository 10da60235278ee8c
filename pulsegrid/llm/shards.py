"""Sharding by fixed virtual slots.

A record is hashed into one of some thousands of slots and stays there for good. The bytes of every slot are counted
(map-side combined, one row per slot), and a slot-to-shard map is drawn up from them so that all shards hold nearly the
same bytes. The map is small (one row per slot), kept as a versioned table, and edited when shards are added or removed:
an edit moves as few slots as it takes. Rows meet the map by a broadcast join, bounded by the number of slots.

Defined results: a null text has size 1 and checksum 0; a null id is hashed like any other value, along with the text, so
that records without an id spread over the slots. Repeated rows (equal id, checksum and size) share a slot and get places side by
side, unless they make up a sixteenth of a shard's bytes or rows: such copies are dealt over all slots by a number they got when
the digests were stored, for a slot cannot be split. An empty table
gives an empty result and a map that deals the slots out evenly. Extra columns are not carried along.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import stored, utf8_size

SLOTS = 4096
MAP_SCHEMA = "vslot int, shard int, bytes bigint, rows bigint, first bigint"


@dataclass(frozen=True)
class Slot:
    vslot: int
    shard: int
    bytes: int
    rows: int
    first: int  # how many rows of the same shard lie in slots before this one


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per record: key, size, checksum of the text and a number of its own, which holds once the rows are stored."""
    checksum = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return df.select(F.col(key), (utf8_size(F.col(text)) + 1).alias("size"), checksum.alias("text_crc32"), F.monotonically_increasing_id().alias("number"))


def slotted(rows: DataFrame, key: str = "doc_id", slots: int = SLOTS, shards: int = 8) -> DataFrame:
    """Adds the virtual slot to stored digests.

    Copies of one record are counted map-side. Groups with over a sixteenth of a shard's mean bytes or rows are fewer than 32 * ``shards``, so
    their list may be broadcast; it decides whether a row's number takes part in the hash.
    """
    groups = rows.groupBy(key, "text_crc32", "size").agg(F.count("*").alias("n"))
    whole = rows.agg(F.sum("size").alias("all_bytes"), F.count("*").alias("all_rows"))
    share = 16 * shards
    many = groups.filter("n > 1").join(F.broadcast(whole), (F.col("n") * F.col("size") * share > F.col("all_bytes")) | (F.col("n") * share > F.col("all_rows")))
    many = many.select(F.struct(key, "text_crc32", "size").alias("record"), F.lit(True).alias("dealt"))
    marked = rows.withColumn("record", F.struct(key, "text_crc32", "size")).join(F.broadcast(many), "record", "left")
    number = F.when(F.col("dealt"), F.col("number"))  # null, and without effect on the hash, for all other rows
    return marked.select(key, "size", "text_crc32", F.pmod(F.xxhash64(key, "text_crc32", "size", number), F.lit(slots)).cast("int").alias("vslot"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) of every slot; the driver gets at most one row per slot."""
    found = {r["vslot"]: (r["b"], r["n"]) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    return [found.get(s, (0, 0)) for s in range(slots)]


def _placed(owner: list[int], loads: list[tuple[int, int]]) -> list[Slot]:
    rows_before: dict[int, int] = {}
    out = []
    for s, (size, rows) in enumerate(loads):
        out.append(Slot(s, owner[s], size, rows, rows_before.get(owner[s], 0)))
        rows_before[owner[s]] = rows_before.get(owner[s], 0) + rows
    return out


def first_map(loads: list[tuple[int, int]], shards: int) -> list[Slot]:
    """Largest slot first, each to the shard that holds least."""
    owner = [0] * len(loads)
    heap = [(0, 0, k) for k in range(shards)]
    for s in sorted(range(len(loads)), key=lambda s: (-loads[s][0], s)):
        size, count, k = heapq.heappop(heap)
        owner[s] = k
        heapq.heappush(heap, (size + loads[s][0], count + 1, k))
    return _placed(owner, loads)


def edited_map(old: list[Slot], loads: list[tuple[int, int]], shards: int) -> list[Slot]:
    """The map for another number of shards or other loads. Slots of shards that are gone must move; of the others, only
    those move that bring an overfull shard down towards the mean, from the largest that fits."""
    owner = [s.shard if s.shard < shards else -1 for s in old]
    held = [0] * shards
    for s, k in enumerate(owner):
        if k >= 0:
            held[k] += loads[s][0]
    mean = sum(size for size, _ in loads) / shards
    loose = [s for s, k in enumerate(owner) if k < 0]
    for s in sorted(range(len(owner)), key=lambda s: (-loads[s][0], s)):
        k = owner[s]
        if k >= 0 and loads[s][0] and held[k] - loads[s][0] >= mean:
            held[k] -= loads[s][0]
            owner[s] = -1
            loose.append(s)
    for s in sorted(loose, key=lambda s: (-loads[s][0], s)):
        k = min(range(shards), key=lambda k: (held[k], k))
        owner[s] = k
        held[k] += loads[s][0]
    return _placed(owner, loads)


def save_map(spark: SparkSession, folder: str, version: int, slots: list[Slot]) -> DataFrame:
    """Store a version of the map; versions already written are never changed."""
    rows = [(s.vslot, s.shard, s.bytes, s.rows, s.first) for s in slots]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{folder}/version={version}")
    return load_map(spark, folder, version)


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def read_slots(slot_map: DataFrame) -> list[Slot]:
    """A stored map as the driver edits it: one row per slot."""
    return sorted((Slot(**r.asDict()) for r in slot_map.collect()), key=lambda s: s.vslot)


def placed(rows: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds the shard of every record and its place in the shard: from 0, without gaps.

    Rows are ordered within their slot only, a small share of the data; the map knows how many rows of the shard
    lie in the slots before.
    """
    joined = rows.join(F.broadcast(slot_map.select("vslot", "shard", "first")), "vslot")
    order = Window.partitionBy("vslot").orderBy(F.col(key), "text_crc32", "size")
    return joined.withColumn("slot", (F.col("first") + F.row_number().over(order) - 1).cast("bigint")).drop("first")


def sharded(df: DataFrame, folder: str, shards: int = 8, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Draw up version 0 of the map for ``shards`` shards and version 1, edited for one more; deal the records out.

    Returns key, size, text_crc32, vslot, shard, slot (place in the shard) and next_shard (under version 1).
    """
    spark = df.sparkSession
    rows = stored(slotted(stored(digests(df, key, text), "digests"), key, slots, shards), "slots")
    loads = slot_loads(rows, slots)
    now = first_map(loads, shards)
    current = save_map(spark, folder, 0, now)
    grown = save_map(spark, folder, 1, edited_map(now, loads, shards + 1))
    after = grown.select("vslot", F.col("shard").alias("next_shard"))
    return placed(rows, current, key).join(F.broadcast(after), "vslot")


def imbalance(slots: list[Slot]) -> float:
    """The fullest shard's bytes over the mean, less one."""
    held: dict[int, int] = {}
    for s in slots:
        held[s.shard] = held.get(s.shard, 0) + s.bytes
    total = sum(held.values())
    return max(held.values()) * len(held) / total - 1 if total else 0.0
