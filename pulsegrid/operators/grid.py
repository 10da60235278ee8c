"""Time grids: per-bucket service summaries, dense bins and trailing quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import col, join_on, keyed, spare
from .quantiles import summarise


def ratio(part: Column, whole: Column, default=None) -> Column:
    out = F.when(whole != 0, part / whole)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def dense_bins(bounds: DataFrame, start: str, end: str, name: str, step: int = 1, chunk: int = 4096) -> DataFrame:
    """One row per bin ``start, start+step, … ≤ end`` of each row of ``bounds``.

    Bins are produced in two explodes, so a long run is never one big array in one row.
    """
    wide = step * chunk
    starts = bounds.filter(F.col(start) <= F.col(end)).withColumn(
        "__chunk", F.explode(F.sequence(F.col(start), F.col(end), F.lit(wide).cast("bigint"))))
    last = F.least(F.col(end), F.col("__chunk") + F.lit(wide - step))
    return starts.withColumn(name, F.explode(F.sequence(F.col("__chunk"), last, F.lit(step).cast("bigint")))) \
        .drop("__chunk")


def service_grid(df: DataFrame, ts: str, by: Sequence[str], bucket: Column, ok: Column, timeout: Column,
                 latency: Mapping[str, str], carry_median: Mapping[str, str] | None = None,
                 carry_first: Mapping[str, str] | None = None, quantiles: Mapping[str, float] | None = None,
                 bucket_name: str = "bucket", order: Sequence[str] | None = None,
                 approx: bool = False) -> DataFrame:
    """Per-bucket counts and rates over all rows, latency quantiles over the successful ones."""
    quantiles = quantiles or {"med": 0.5, "p95": 0.95}
    position = F.struct(*[F.col(c) for c in (order or [ts])])
    base = df.withColumn(bucket_name, bucket).withColumn("__ok", F.coalesce(ok, F.lit(False))) \
        .withColumn("__to", F.coalesce(timeout, F.lit(False)))
    aggs = {
        "request_rows": F.count(F.lit(1)),
        "success_rows": F.sum(F.col("__ok").cast("bigint")),
        "failure_rows": F.sum((~F.col("__ok")).cast("bigint")),
        "timeout_rows": F.sum(F.col("__to").cast("bigint")),
    }
    for name, c in (carry_first or {}).items():
        aggs[name] = F.min_by(F.col(c), F.when(F.col(c).isNotNull(), position))
    specs = {f"{name}_{q}": (F.when(F.col("__ok"), F.col(c)), v)
             for name, c in latency.items() for q, v in quantiles.items()}
    specs |= {name: (c, 0.5) for name, c in (carry_median or {}).items()}
    out = summarise(base, [*by, bucket_name], aggs, specs, approx=approx)
    return out.withColumn("success_rate", ratio(F.col("success_rows"), F.col("request_rows"))) \
        .withColumn("fail_rate", ratio(F.col("failure_rows"), F.col("request_rows"))) \
        .withColumn("timeout_rate", ratio(F.col("timeout_rows"), F.col("request_rows")))


def arrival_bins(df: DataFrame, by: Sequence[str], scheduled: str = "scheduled_s", bucket_s: int = 1,
                 duration: DataFrame | None = None) -> DataFrame:
    """Offered-load accounting by scheduled arrival.

    Expects columns ``launch_status, completed, success, error_type, schedule_delay_ms, inflight,
    latency_ms``. ``duration`` (by + ``duration_s``) asks for every bin up to that length, empty ones too.
    """
    launched = F.col("launch_status") == "launched"
    dropped = F.col("launch_status") == "dropped_max_inflight"
    done = launched & F.col("completed")
    good = done & F.coalesce(F.col("success"), F.lit(False))
    late = F.coalesce(F.col("schedule_delay_ms"), F.lit(0.0)) > bucket_s * 1000
    base = df.filter(F.col(scheduled).isNotNull()).withColumn(
        "bin", F.floor(F.col(scheduled) / bucket_s).cast("bigint"))

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    out = summarise(base, [*by, "bin"], {
        "scheduled_request_count": F.count(F.lit(1)),
        "launched_request_count": n(launched),
        "dropped_max_inflight_count": n(dropped),
        "completed_count": n(done),
        "successful_count": n(good),
        "__failed": n(F.col("success") == F.lit(False)),
        "__timeouts": n(F.col("error_type") == "timeout"),
        "inflight_max": F.max(F.coalesce(F.col("inflight"), F.lit(0))),
        "schedule_misses": n(dropped | late),
    }, {p: (F.when(good, F.col("latency_ms")), q) for p, q in
        (("latency_p50", .5), ("latency_p95", .95), ("latency_p99", .99))})
    if duration is not None:
        bins = dense_bins(duration.select(*by, F.lit(0).cast("bigint").alias("__a"),
                                          (F.ceil(F.col("duration_s") / bucket_s) - 1).cast("bigint").alias("__z")),
                          "__a", "__z", "bin").drop("__a", "__z")
        out = join_on(bins, out, [*by, "bin"], "left")
        counts = [c for c, t in out.dtypes if t in ("bigint", "int") and c not in by and c != "bin"]
        out = out.fillna(0, counts)
    total = F.col("scheduled_request_count")
    return out.select(
        *by, (F.col("bin") * bucket_s).alias("elapsed_s"), (total / F.lit(float(bucket_s))).alias("offered_rps"),
        *[c for c in out.columns if c not in by and c != "bin" and not c.startswith("__")],
        ratio(F.col("completed_count"), F.col("launched_request_count"), 0).alias("completion_fraction"),
        ratio(F.col("successful_count"), F.col("completed_count"), 0).alias("success_fraction"),
        ratio(F.col("__failed"), total, 0).alias("fail_rate"),
        ratio(F.col("__timeouts"), total, 0).alias("timeout_rate"))


def completion_bins(df: DataFrame, by: Sequence[str], completed: str = "complete_s", bucket_s: int = 1) -> DataFrame:
    """Realised activity by completion time; bins without completions do not appear."""
    base = df.filter(F.col(completed).isNotNull()).withColumn(
        "bin", F.floor(F.col(completed) / bucket_s).cast("bigint"))
    good = F.coalesce(F.col("success"), F.lit(False))

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    out = summarise(base, [*by, "bin"], {
        "completed_request_count": F.count(F.lit(1)),
        "successful_count": n(good),
        "failed_count": n(F.col("success") == F.lit(False)),
        "timeout_count": n(F.col("error_type") == "timeout"),
    }, {p: (F.when(good, F.col("latency_ms")), q) for p, q in
        (("latency_p50", .5), ("latency_p95", .95), ("latency_p99", .99))})
    total = F.col("completed_request_count")
    return out.select(*by, (F.col("bin") * bucket_s).alias("elapsed_s"),
                      (total / F.lit(float(bucket_s))).alias("realized_completed_rps"),
                      *[c for c in out.columns if c not in by and c != "bin"],
                      (F.col("successful_count") / total).alias("success_fraction"),
                      (F.col("timeout_count") / total).alias("timeout_fraction"))


def resampled(df: DataFrame, by: Sequence[str], t: str, step: int, ok: Column, latency: str) -> DataFrame:
    """Dense resample between each key's first and last bucket: counts are 0 and statistics null in gaps."""
    base, keys = keyed(df, by)
    base = base.withColumn("bucket", (F.floor(F.col(t) / step) * step).cast("bigint")).withColumn("__ok", ok)
    good = F.when(F.col("__ok"), F.col(latency))
    out = summarise(base, [*keys, "bucket"], {
        "request_count": F.count(F.lit(1)), "success_mean": F.avg(F.col("__ok").cast("double")),
        "latency_mean": F.avg(good), "latency_max": F.max(good),
    }, {"latency_p50": (good, .5), "latency_p95": (good, .95), "latency_p99": (good, .99)})
    bounds = base.groupBy(*keys).agg(F.min("bucket").alias("__a"), F.max("bucket").alias("__z"))
    bins = dense_bins(bounds, "__a", "__z", "bucket", step).drop("__a", "__z")
    out = join_on(bins, out, [*keys, "bucket"], "left").fillna(0, ["request_count"])
    return out if by else out.drop("__all")


def trailing_quantiles(df: DataFrame, by: Sequence[str], t: str, value: str, window_s: int = 10,
                       min_samples: int = 5) -> DataFrame:
    """Quantiles over ``[s-w+1, s+1)`` for every second ``0 … floor(max t)`` of a run.

    Each completion is sent to the at most ``window_s`` seconds it serves, so the cost is linear in rows.
    """
    base, keys = keyed(df.filter(F.col(t).isNotNull() & F.col(value).isNotNull()), by)
    second = F.floor(F.col(t)).cast("bigint")
    ends = base.groupBy(*keys).agg(F.greatest(F.max(second), F.lit(0)).alias("__z"))
    seconds = dense_bins(ends.withColumn("__a", F.lit(0).cast("bigint")), "__a", "__z", "elapsed_s") \
        .drop("__a", "__z")
    served = base.withColumn("elapsed_s", F.explode(F.sequence(second, second + F.lit(window_s - 1))))
    stats = summarise(served, [*keys, "elapsed_s"], {"n": F.count(F.lit(1)), "mean": F.avg(value)},
                      {"p50": (value, .5), "p95": (value, .95), "p99": (value, .99)})
    out = join_on(seconds, stats, [*keys, "elapsed_s"], "left").fillna(0, ["n"])
    enough = F.col("n") >= min_samples
    out = out.select(
        *keys, "elapsed_s", F.col("n").alias("completion_count"), enough.alias("sample_sufficient"),
        F.when(enough, "ok").otherwise(f"insufficient_completion_count<{min_samples}").alias("quality_status"),
        *[F.when(enough, F.col(c)).alias(f"rolling_latency_{c}") for c in ("p50", "mean", "p95", "p99")])
    return out if by else out.drop("__all")


def elapsed_axis(df: DataFrame, by: Sequence[str], t: str, elapsed: str | None = None, unit: float = 1.0) -> DataFrame:
    """Add ``elapsed_s``: the named column where the frame has it, else time since the key's first row."""
    if elapsed and elapsed in df.columns:
        return df.withColumn("elapsed_s", F.col(elapsed).cast("double"))
    base, keys = keyed(df, by)
    first = base.groupBy(*keys).agg(F.min(t).alias("__t0"))
    return join_on(base, first, keys).withColumn("elapsed_s", (F.col(t) - F.col("__t0")) / unit).drop("__t0", *spare(by))
