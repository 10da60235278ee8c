"""Row filters and eligibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import col, join_on, keyed, spare
from .quantiles import quantiles


def succeeded(error_type, success) -> Column:
    """A request succeeded by its error type or its success flag."""
    return F.coalesce(col(error_type) == "normal_success", F.lit(False)) | F.coalesce(col(success) == 1, F.lit(False))


def clean_rows(df: DataFrame, ok: Column, status: str, role: str, wanted_role: str, latencies: Sequence[str],
               t: str, start, end) -> DataFrame:
    """Successful rows with status 200, the wanted role, every latency present, inside the closed window."""
    keep = ok & (F.col(status) == 200) & (F.col(role) == wanted_role) & F.col(t).between(start, end)
    for c in latencies:
        keep &= F.col(c).isNotNull()
    return df.filter(keep)


def measurement_window(df: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str, valid: str) -> DataFrame:
    """Half-open window per run: ``in_window``, and ``eligible`` where the run's manifest is valid too."""
    out = join_on(df, windows.select(*by, start, end, valid), by, "left")
    inside = F.coalesce((F.col(t) >= F.col(start)) & (F.col(t) < F.col(end)), F.lit(False))
    return out.withColumn("in_window", inside).withColumn("eligible", inside & F.coalesce(F.col(valid), F.lit(False))) \
        .drop(start, end, valid)


def observed(df: DataFrame, windows: DataFrame, by: Sequence[str], t: str, start: str, end: str) -> DataFrame:
    """Closed observation window per key; a key without both bounds keeps all its rows."""
    out = join_on(df, windows.select(*by, start, end), by, "left")
    open_ = F.col(start).isNull() | F.col(end).isNull()
    return out.filter(open_ | F.col(t).between(F.col(start), F.col(end))).drop(start, end)


def trim_to(df: DataFrame, other: DataFrame, by: Sequence[str], t: str, other_t: str) -> DataFrame:
    """Rows up to the last timestamp of the other table, per key."""
    left, keys = keyed(df, by)
    right, _ = keyed(other, by)
    out = join_on(left, right.groupBy(*keys).agg(F.max(other_t).alias("__z")), keys)
    return out.filter(F.col(t) <= F.col("__z")).drop("__z", *spare(by))


def eligibility(df: DataFrame, t: str, warmup, telemetry: Sequence[str], samples: str, min_samples: int) -> DataFrame:
    """Separate eligibility for thermal and for tail-latency analysis."""
    warm = F.col(t) >= warmup
    thermal = warm
    for c in telemetry:
        thermal &= F.col(c).isNotNull()
    return df.withColumn("thermal_eligible", thermal).withColumn("tail_eligible", warm & (F.coalesce(F.col(samples), F.lit(0)) >= min_samples))


def clip(df: DataFrame, by: Sequence[str], value: str, q: float, drop: bool = False) -> DataFrame:
    """Cap the values of each key at a quantile, or drop the rows above it."""
    base, keys = keyed(df, by)
    out = join_on(base, quantiles(base, keys, {"__cap": (value, q)}), keys, "left").drop(*spare(by))
    if drop:
        return out.filter(F.col(value) <= F.col("__cap")).drop("__cap")
    return out.withColumn(value, F.when(F.col(value).isNotNull(), F.least(value, "__cap"))).drop("__cap")


def check_columns(df: DataFrame, required: Sequence[str] = (), forbidden: Sequence[str] = (),
                  exclusive: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Reject a frame, when the query is built, that breaks a column contract."""
    have = set(df.columns)
    problems = [f"missing column {c}" for c in required if c not in have] + [f"forbidden column {c}" for c in forbidden if c in have] \
        + [f"columns {a} and {b} exclude each other" for a, b in exclusive if a in have and b in have]
    if problems:
        raise ValueError("; ".join(problems))
    return df


def first_with_rows(df: DataFrame, by: Sequence[str], name: str, alternatives: Sequence[str]) -> DataFrame:
    """Of alternative metric names keep, per key, the rows of the first that has any."""
    rank = F.coalesce(*[F.when(F.col(name) == a, F.lit(i)) for i, a in enumerate(alternatives)])
    ranked = df.withColumn("__rank", rank).filter(F.col("__rank").isNotNull())
    base, keys = keyed(ranked, by)
    best = base.groupBy(*keys).agg(F.min("__rank").alias("__best"))
    return join_on(base, best, keys).filter(F.col("__rank") == F.col("__best")).drop("__rank", "__best", *spare(by))


def select_labels(df: DataFrame, labels: str, equals: Mapping[str, str] | None = None, differs: Mapping[str, str] | None = None,
                  matches: Mapping[str, str] | None = None, avoids: Mapping[str, str] | None = None) -> DataFrame:
    """Label selectors; an absent label reads as the empty text, and patterns match whole values."""
    at = lambda k: F.coalesce(F.try_element_at(F.col(labels), F.lit(k)), F.lit(""))
    keep = F.lit(True)
    for k, v in (equals or {}).items():
        keep &= at(k) == v
    for k, v in (differs or {}).items():
        keep &= at(k) != v
    for k, v in (matches or {}).items():
        keep &= at(k).rlike(f"^(?:{v})$")
    for k, v in (avoids or {}).items():
        keep &= ~at(k).rlike(f"^(?:{v})$")
    return df.filter(keep)
