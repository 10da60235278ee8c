"""Time columns. Tables carry zone-less timestamps; arithmetic runs on UTC microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000
HOUR = 3600 * MICROS
DAY = 24 * HOUR


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts) -> Column:
    """Microseconds since the epoch of a zone-less (or UTC) timestamp. The session zone must be UTC."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def seconds(ts) -> Column:
    return micros(ts) / F.lit(float(MICROS))


def from_micros(us) -> Column:
    return F.timestamp_micros(_col(us)).cast("timestamp_ntz")


def floor_micros(us, step: int) -> Column:
    c = _col(us)
    return c - F.pmod(c, F.lit(step))


def trunc_ntz(unit: str, ts) -> Column:
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")
