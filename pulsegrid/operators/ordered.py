"""Ordered scans that do not need a whole key in one task.

A window over ``(key, time)`` sorts each key in one task, which fails when one run holds a large share of
all rows. Here every key is cut into slices of its order column. Rows are shuffled once, by (key, slice);
each slice is reduced to one carry row; the carries (one row per key and slice) are scanned in order and
joined back on (key, slice), the partitioning the rows already have.

Frames of a bounded number of rows use blocks of consecutive rows instead, with the few neighbouring
rows each block needs copied in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keys import PACKED, col, keyed, packed, spare

SLICE = "__slice"


def slice_of(order_col, width) -> Column:
    """Slice number of a row: ``width`` is in the unit of the order column."""
    return F.floor(col(order_col) / F.lit(width)).cast("bigint")


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], width, slice_col) -> DataFrame:
    if SLICE in df.columns:  # kept by the scan before, together with the partitioning of its rows
        return df
    return df.select("*", packed(keys), (slice_col if slice_col is not None else slice_of(order[0], width)).alias(SLICE))


DEALT_ROWS = 500_000  # rows of a task of a scan that holds whole lines


def dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], *, width) -> DataFrame:
    """Rows shuffled for the scans that follow by (key, slice), over as many tasks as their number asks for, so a task's rows do not grow with the table."""
    base, keys = keyed(df, by)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // DEALT_ROWS))
    return _sliced(base, keys, order, width, None).repartition(parts, PACKED, SLICE)


def _order(order: Sequence[str], reverse: bool = False) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def fill(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Mapping[str, Column | str], *,
         width=None, slice_col: Column | None = None, direction: str = "previous",
         strict: bool = False, keep_slice: bool = False) -> DataFrame:
    """Add, per output name, the nearest non-null value at or before (after) each row of its key.

    ``strict`` leaves the row itself out, which makes ``fill`` a null-skipping lag or lead. With
    ``keep_slice`` a scan that follows finds the rows partitioned as it needs them.
    """
    back = direction == "previous"
    df, keys = keyed(df, by)
    df = _sliced(df, keys, order, width, slice_col)
    names = list(cols)
    held = df.select("*", *[col(c).alias(f"__h_{n}") for n, c in cols.items()])
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    pick = F.max_by if back else F.min_by
    edges = held.groupBy(PACKED, SLICE).agg(
        *[pick(F.col(f"__h_{n}"), F.when(F.col(f"__h_{n}").isNotNull(), position)).alias(f"__e_{n}")
          for n in names])
    across = W.partitionBy(PACKED).orderBy(F.col(SLICE).asc() if back else F.col(SLICE).desc()) \
        .rowsBetween(W.unboundedPreceding, -1)
    carries = edges.select(PACKED, SLICE, *[F.last(f"__e_{n}", ignorenulls=True).over(across).alias(f"__c_{n}")
                                          for n in names])
    within = W.partitionBy(PACKED, SLICE).orderBy(*_order(order, reverse=not back)) \
        .rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    joined = held.join(carries, [PACKED, SLICE], "left")
    out = joined.select(
        *[c for c in df.columns if c not in names],
        *[F.coalesce(F.last(f"__h_{n}", ignorenulls=True).over(within), F.col(f"__c_{n}")).alias(n)
          for n in names])
    return out.drop(*([] if keep_slice else [SLICE, PACKED]), *spare(by))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str] | None = None,
            *, maxima: Mapping[str, Column | str] | None = None, width=None, slice_col: Column | None = None,
            strict: bool = False, keep_slice: bool = False) -> DataFrame:
    """Add running sums (0 when nothing precedes) and running maxima (null when nothing precedes)."""
    sums, maxima = dict(sums or {}), dict(maxima or {})
    df, keys = keyed(df, by)
    df = _sliced(df, keys, order, width, slice_col)
    held = df.select("*", *[col(c).alias(f"__s_{n}") for n, c in sums.items()],
                     *[col(c).alias(f"__m_{n}") for n, c in maxima.items()])
    edges = held.groupBy(PACKED, SLICE).agg(*[F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums],
                                           *[F.max(f"__m_{n}").alias(f"__m_{n}") for n in maxima])
    across = W.partitionBy(PACKED).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    carries = edges.select(PACKED, SLICE, *[F.sum(f"__s_{n}").over(across).alias(f"__cs_{n}") for n in sums],
                           *[F.max(f"__m_{n}").over(across).alias(f"__cm_{n}") for n in maxima])
    within = W.partitionBy(PACKED, SLICE).orderBy(*_order(order)) \
        .rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    joined = held.join(carries, [PACKED, SLICE], "left")
    zero = F.lit(0)
    out = joined.select(
        *[c for c in df.columns if c not in sums and c not in maxima],
        *[(F.coalesce(F.col(f"__cs_{n}"), zero) + F.coalesce(F.sum(f"__s_{n}").over(within), zero)).alias(n)
          for n in sums],
        *[F.greatest(F.col(f"__cm_{n}"), F.max(f"__m_{n}").over(within)).alias(n) for n in maxima])
    return out.drop(*([] if keep_slice else [SLICE, PACKED]), *spare(by))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn", *, width=None,
             slice_col: Column | None = None) -> DataFrame:
    """Row number within the key, from 1."""
    return running(df, by, order, {name: F.lit(1).cast("bigint")}, width=width, slice_col=slice_col)


BLOCK = "__blk"


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], rn: str, *, before: int, after: int, width=None,
            slice_col: Column | None = None, block: int = 200_000) -> DataFrame:
    """Cut keys into blocks of ``block`` consecutive rows, numbered by ``rn`` (from 1; added if absent).

    Rows near an edge are copied into the neighbouring blocks whose frames reach them, so the copies cost
    (before + after) / block. ``core`` tells the rows that belong to a block from the copies.
    """
    if rn not in df.columns:
        df = numbered(df, keys, order, rn, width=width, slice_col=slice_col)
    pos = F.col(rn) - 1
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((pos - after) / block))
    last = F.floor((pos + before) / block)
    return df.withColumn(BLOCK, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))


def core(rn: str, block: int) -> Column:
    return F.col(BLOCK) == F.floor((F.col(rn) - 1) / block)


def framed(df: DataFrame, by: Sequence[str], order: Sequence[str], exprs: Callable[[W], Mapping[str, Column]], *,
           before: int = 0, after: int = 0, width=None, slice_col: Column | None = None,
           block: int = 200_000, index: str | None = None) -> DataFrame:
    """Window expressions whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    ``exprs(w)`` receives the ordered window specification and returns name -> column. ``index`` names a
    row number the frame already has.
    """
    df, keys = keyed(df, by)
    rn = index or "__rn"
    copies = blocked(df, keys, order, rn, before=before, after=after, width=width, slice_col=slice_col, block=block)
    added = exprs(W.partitionBy(*keys, BLOCK).orderBy(rn))
    out = copies.select(*[c for c in copies.columns if c not in added],
                        *[c.alias(n) for n, c in added.items()]).filter(core(rn, block))
    return out.drop(BLOCK, *spare(by), *([] if index else ["__rn"]))


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Mapping[str, tuple[str, int]], *,
           width=None, slice_col: Column | None = None, **kw) -> DataFrame:
    """Row-offset values: name -> (column, offset); a positive offset looks back, a negative one ahead."""
    offsets = [o for _, o in cols.values()]
    if set(offsets) <= {1}:
        packed = {n: F.struct(F.col(c).alias("x")) for n, (c, _) in cols.items()}
        out = fill(df, by, order, packed, width=width, slice_col=slice_col, strict=True)
        return out.select(*[F.col(c)["x"].alias(c) if c in cols else F.col(c) for c in out.columns])
    if set(offsets) <= {-1}:
        packed = {n: F.struct(F.col(c).alias("x")) for n, (c, _) in cols.items()}
        out = fill(df, by, order, packed, width=width, slice_col=slice_col, strict=True, direction="next")
        return out.select(*[F.col(c)["x"].alias(c) if c in cols else F.col(c) for c in out.columns])
    return framed(df, by, order,
                  lambda w: {n: (F.lag(c, o) if o >= 0 else F.lead(c, -o)).over(w) for n, (c, o) in cols.items()},
                  before=max(0, *offsets), after=max(0, *[-o for o in offsets]), width=width,
                  slice_col=slice_col, **kw)
