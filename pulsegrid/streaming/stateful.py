"""Stateful processors: rows released in event-time order, and the nearest row of another stream.

Both keep what they wait for in the state store and act on event-time timers, so results do not depend on how rows fall into batches, as long as
none is later than the watermark allows. Work on released rows is done on arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Processors with several states and timers need the store that keeps them on disk."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _milliseconds(us: int) -> int:
    """The first millisecond at which a watermark has passed ``us``."""
    return -(-int(us) // 1000)


def _rows(pdf: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Plain tuples for the state store: missing values are None, whole numbers are whole even where pandas holds them as floats."""
    columns = []
    for field in schema.fields:
        kind = int if isinstance(field.dataType, T.IntegralType) else bool if isinstance(field.dataType, T.BooleanType) else None
        values = pdf[field.name].tolist()
        columns.append([None if v is None or v is pd.NaT or v is pd.NA or v != v else v if kind is None else kind(v) for v in values])
    return list(zip(*columns))


class InEventOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then hands them, in order, to ``fold(rows, carry) -> (rows, carry)``.

    A key has one timer, at the first moment it waits for.
    """

    def __init__(self, held: T.StructType, order: Sequence[str], fold: Callable, carry: str, out: Sequence[str], key: str):
        self.schema, self.order, self.fold, self.carry_schema, self.out, self.key = held, list(order), fold, carry, list(out), key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.carry = handle.getValueState("carry", self.carry_schema)
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake(self, at: int) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is not None and now <= at:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.held.appendList(_rows(pdf, self.schema))
                self._wake(_milliseconds(pdf["us"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame(list(self.held.get()), columns=self.schema.names)
        free = held["us"] <= passed
        wait = held[~free]
        if len(wait):
            self.held.put(_rows(wait, self.schema))
            self._wake(_milliseconds(wait["us"].min()))
        else:
            self.held.clear()
        if free.any():
            rows = held[free].rename(columns=lambda c: c.removeprefix("v_")).sort_values(self.order, kind="stable", ignore_index=True)
            rows, carry = self.fold(rows, self.carry.get() if self.carry.exists() else None)
            self.carry.update(carry)
            if len(rows):
                yield rows.assign(**{self.key: key[0]})[self.out]

    def close(self) -> None:
        pass


def in_event_order(stream: DataFrame, key: str, ts: str, tie: Sequence[str], keep: Sequence[str], fold: Callable, added: Mapping[str, str], carry: str, *, late: str) -> DataFrame:
    """``key, us, tie, keep`` and the columns ``added`` of every row that ``fold`` gives back. Rows at most ``late`` behind the latest one come in
    their place by event time (then ``tie``); later ones and rows without a time are dropped. Rows within ``late`` of the end of a stream still wait."""
    names = list(dict.fromkeys([*tie, *keep]))
    names = [c for c in names if c not in (key, "us")]
    # Columns whose names begin with an underscore do not reach a processor: all get a prefix on the way.
    rows = stream.withWatermark(ts, late).filter(F.col(ts).isNotNull()).select(
        F.col(key).alias("k"), F.col(ts).alias("at"), F.unix_micros(ts).alias("us"), *[F.col(c).alias(f"v_{c}") for c in names])
    held = T.StructType([rows.schema["us"], *[rows.schema[f"v_{c}"] for c in names]])
    more = T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in added.items())).fields if added else []
    out = T.StructType([T.StructField(key, rows.schema["k"].dataType), rows.schema["us"], *[T.StructField(c, rows.schema[f"v_{c}"].dataType) for c in names], *more])
    use_state_store(stream.sparkSession)
    processor = InEventOrder(held, ["us", *[c for c in tie if c != "us"]], fold, carry, out.names, key)
    return rows.groupBy("k").transformWithStateInPandas(processor, out, "Append", "EventTime")


class NearestInBucket(StatefulProcessor):
    """Requests and telemetry of one (shard of the keys, bucket), matched key by key when no nearer row can come in time."""

    def __init__(self, held: T.StructType, out: T.StructType, by: list, request: list, value: list, tie: str, within: int, width: int, unmatched: bool):
        self.schema, self.out, self.by, self.request, self.value, self.tie = held, out, by, request, value, tie
        self.within, self.width, self.unmatched = within, width, unmatched

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getListState("asked", self.schema)
        self.seen = handle.getListState("seen", self.schema)
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for state, own in ((self.asked, pdf[pdf["asks"]]), (self.seen, pdf[~pdf["asks"]])):
                if len(own):
                    state.appendList(_rows(own, self.schema))
        if not self.timer.exists():
            at = _milliseconds((key[-1] + 1) * self.width + self.within)
            self.handle.registerTimer(at)
            self.timer.update((at,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, seen = (pd.DataFrame(list(s.get()) if s.exists() else [], columns=self.schema.names) for s in (self.asked, self.seen))
        for state in (self.asked, self.seen, self.timer):
            state.clear()
        if len(asked):
            out = self._matched(asked, seen)
            if len(out):
                yield out[self.out.names]

    def _matched(self, asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        keys = [f"k_{c}" for c in self.by]
        owner = pd.concat([asked[keys], seen[keys]], ignore_index=True).groupby(keys, dropna=False, sort=False).ngroup().to_numpy("int64")
        asker, owner = owner[:len(asked)], owner[len(asked):]
        seen = seen.assign(owner=owner).sort_values(["owner", "us", f"v_{self.tie}"], kind="stable", ignore_index=True)
        at, times, owner = asked["us"].to_numpy("int64"), seen["us"].to_numpy("int64"), seen["owner"].to_numpy("int64")
        out = asked[["us", *keys, *[f"v_{c}" for c in self.request]]].rename(columns=lambda c: c[2:] if c[:2] in ("k_", "v_") else c)
        far = np.iinfo("int64").max
        if len(times):
            moments, moment = np.unique(np.concatenate([at, times]), return_inverse=True)
            places, place = owner * len(moments) + moment[len(at):], asker * len(moments) + moment[:len(at)]  # order of key and time as one number
            after = np.searchsorted(places, place, side="left")
            last, following = np.maximum(after - 1, 0), np.minimum(after, len(times) - 1)
            # Of rows at one moment the first by tie: the first of the moment before, the first at or after.
            before = np.searchsorted(places, places[last], side="left")
            left = np.where((after > 0) & (owner[last] == asker), at - times[before], far)
            right = np.where((after < len(times)) & (owner[following] == asker), times[following] - at, far)
            pick, gap = np.where(left <= right, before, following), np.minimum(left, right)
        else:
            pick, gap = np.zeros(len(at), int), np.full(len(at), far)
        near = gap <= self.within
        found = seen.iloc[np.where(near, pick, 0)] if len(times) else seen.reindex([0] * len(at))
        out["other_us"] = pd.Series(found["us"].to_numpy(), index=out.index, dtype="object").where(near, None)
        for c in self.value:
            out[c] = pd.Series(found[f"v_{c}"].to_numpy(), index=out.index, dtype="object").where(near, None)
        for c in ("other_us", *self.value):
            kind = self.out[c].dataType
            if isinstance(kind, (T.IntegralType,)):
                out[c] = out[c].astype("Int64")
        return out if self.unmatched else out[near]

    def close(self) -> None:
        pass
