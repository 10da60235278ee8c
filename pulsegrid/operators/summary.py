"""Grouped summaries of request logs, telemetry and availability samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .align import near_join
from .grid import dense_bins, ratio
from .keys import col, cut, is_small, join_on, keyed
from .ordered import fill, framed, lagged, numbered, running
from .selection import last_n
from .quantiles import nearest, quantiles, rounded, summarise, average_rank  # noqa: F401


def n_if(cond) -> Column:
    return F.sum(F.when(col(cond), 1).otherwise(0)).cast("bigint")


def round_half(c, digits: int) -> Column:
    return F.round(col(c), digits)


def phase_summary(df: DataFrame, by: Sequence[str], ok: str, values: Sequence[str], approx: bool = False,
                  digits: int = 3) -> DataFrame:
    """Latency profile of the successful rows of each key (null keys kept), rounded; success rate to 6."""
    aggs, specs = {"rows": F.count(F.lit(1)), "success_rate": F.round(F.avg(F.col(ok).cast("double")), 6)}, {}
    for v in values:
        good = F.when(F.col(ok), F.col(v))
        aggs |= {f"{v}_mean": F.round(F.avg(good), digits), f"{v}_max": F.round(F.max(good), digits)}
        specs |= {f"{v}_p50": (good, .5), f"{v}_p95": (good, .95), f"{v}_p99": (good, .99)}
    out = summarise(df, by, aggs, specs, approx=approx)
    return out.select(*[F.round(c, digits).alias(c) if c in specs else F.col(c) for c in out.columns])


def two_level_medians(df: DataFrame, inner: Sequence[str], outer: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median per inner key, then the median of those medians per outer key."""
    first = cut(summarise(df, inner, {"rows": F.count(F.lit(1))}, {v: (v, .5) for v in values}))
    return summarise(first, outer, {"groups": F.count(F.lit(1)), "rows": F.sum("rows")},
                     {f"{v}_median": (v, .5) for v in values})


def label_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).orderBy(*by)


def long_form(df: DataFrame, keep: Sequence[str], values: Sequence[str], name: str = "metric",
              value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(v).cast("double").alias(v) for v in values]) \
        .unpivot(list(keep), list(values), name, value)


def series_profile(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    long = long_form(df, by, values)
    return summarise(long, [*by, "metric"], {
        "count": F.count("value"), "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value")},
        {"p50": ("value", .5), "p95": ("value", .95), "p99": ("value", .99)})


def mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median, median absolute deviation, quartile range and a robust scale with floor 1.0."""
    df, keys = keyed(df, by)
    centre = quantiles(df, keys, {"median": (value, .5), "__q1": (value, .25), "__q3": (value, .75)})
    spread = quantiles(join_on(df, centre, keys), keys, {"mad": (F.abs(F.col(value) - F.col("median")), .5)})
    out = join_on(centre, spread, keys)
    scale = F.col("mad") * F.lit(1.4826)
    out = out.select(*keys, "median", "mad", (F.col("__q3") - F.col("__q1")).alias("iqr"),
                     F.when(scale > 1e-9, scale).otherwise(1.0).alias("robust_scale"))
    return out if by else out.drop("__all")


def calibration_summary(arrival: DataFrame, completion: DataFrame, raw: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per-run totals, drop ratio, throughput, error rates and medians of the per-bin quantiles."""
    a = summarise(arrival, by, {
        "arrival_bins": F.count(F.lit(1)), "scheduled": F.sum("scheduled_request_count"),
        "dropped": F.sum("dropped_max_inflight_count")}, {"offered_rps_median": ("offered_rps", .5)})
    c = summarise(completion, by, {
        "completed": F.sum("completed_request_count"), "successful": F.sum("successful_count"),
        "failed": F.sum("failed_count"), "timeouts": F.sum("timeout_count")},
        {"completed_rps_median": ("realized_completed_rps", .5),
         **{f"latency_{p}_median": (f"latency_{p}", .5) for p in ("p50", "p95", "p99")}})
    r = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("raw_request_rows"))
    out = join_on(join_on(r, a, by, "left"), c, by, "left").fillna(0, ["completed", "successful", "failed", "timeouts"])
    done = F.col("completed")
    return out.select(
        *by, "raw_request_rows", "arrival_bins", "offered_rps_median", "scheduled",
        ratio(F.col("dropped"), F.col("scheduled")).alias("drop_ratio"),
        ratio(done, F.col("arrival_bins")).alias("throughput_per_bin"), "completed_rps_median", "completed",
        "successful", ratio(F.col("timeouts"), done).alias("timeout_rate"),
        ratio(F.col("failed"), done).alias("error_rate"),
        *[f"latency_{p}_median" for p in ("p50", "p95", "p99")])


def replicate_summary(df: DataFrame, level: str, values: Sequence[str], completed: str, reason: str) -> DataFrame:
    """Across-run spread per load level. ``df`` has one row per run; ``reason`` is a small label set."""
    long = long_form(df, [level], values)
    stats = summarise(long, [level, "metric"], {"runs": F.count("value"), "min": F.min("value"), "max": F.max("value")},
                      {"median": ("value", .5), "__q1": ("value", .25), "__q3": ("value", .75)})
    stats = stats.withColumn("iqr", F.col("__q3") - F.col("__q1")).drop("__q1", "__q3")
    flags = df.groupBy(level).agg(
        F.bool_and(completed).alias("all_completed"),
        F.concat_ws(";", F.array_sort(F.collect_set(F.when(F.col(reason) != "", F.col(reason))))).alias("reasons"))
    return join_on(stats, flags, [level])


def freshness(age: Column, strict_s: float = 5.0, caution_s: float = 30.0) -> Column:
    return F.when(age.isNull(), "missing").when(age <= strict_s, "ok_for_10_30s_warning") \
        .when(age <= caution_s, "caution_for_10_30s_warning").otherwise("not_primary_for_10_30s_warning")


def sample_age_summary(samples: DataFrame, by: Sequence[str], strict_s: float = 5, caution_s: float = 30) -> DataFrame:
    """Per query: result counts, errors, missing stamps, age and duration quantiles and the decision.

    ``samples`` has ``result_count, error, sample_ts_max, age_s, duration_s``.
    """
    out = summarise(samples, by, {
        "result_count_min": F.min("result_count"), "result_count_max": F.max("result_count"),
        "error_count": n_if(F.coalesce(F.col("error"), F.lit("")) != ""),
        "missing_ts_count": n_if(F.col("sample_ts_max").isNull()),
        "observations": F.count("age_s"), "age_max_s": F.max("age_s"), "duration_max_s": F.max("duration_s")},
        {"age_p50_s": ("age_s", .5), "age_p95_s": ("age_s", .95), "duration_p50_s": ("duration_s", .5),
         "duration_p95_s": ("duration_s", .95)})
    return out.withColumn("decision", freshness(F.col("age_max_s"), strict_s, caution_s))


def sample_records(samples: DataFrame, by: Sequence[str], stamp: str, finished: str, head: int = 20) -> DataFrame:
    """One record per query: its age quantiles, and its distinct timestamps with the first of them listed."""
    age = F.col(finished) - F.col(stamp)
    stats = summarise(samples, by, {"result_count": F.count(F.lit(1)), "age_min_s": F.min(age), "age_max_s": F.max(age)}, {"age_p50_s": (age, .5)})
    distinct = samples.filter(F.col(stamp).isNotNull()).select(*by, F.round(stamp, 6).alias("__ts")).distinct()
    sizes = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_count"))
    first = last_n(distinct.withColumn("__neg", -F.col("__ts")), by, ["__neg"], head)
    heads = first.groupBy(*by).agg(F.array_sort(F.collect_list("__ts")).alias("distinct_head"))
    out = join_on(join_on(stats, sizes, by, "left"), heads, by, "left").fillna(0, ["distinct_count"])
    return out.withColumn("distinct_omitted", F.greatest(F.lit(0), F.col("distinct_count") - head))


def freshness_probe(df: DataFrame, by: Sequence[str], order: Sequence[str], ok: str, age: str, stamp: str,
                    width) -> DataFrame:
    """Age quantiles and quantiles of the step between successive *changed* sample timestamps."""
    stats = summarise(df, by, {"rows": F.count(F.lit(1)), "ok_rows": n_if(F.col(ok) & F.col(age).isNotNull()),
                               "age_max_s": F.max(F.when(F.col(ok), F.col(age))),
                               "distinct_stamps": F.count_distinct(F.when(F.col(ok), F.col(stamp)))},
                      {"age_p50_s": (F.when(F.col(ok), F.col(age)), .5), "age_p95_s": (F.when(F.col(ok), F.col(age)), .95)})
    good = df.filter(F.col(ok) & F.col(age).isNotNull() & F.col(stamp).isNotNull())
    steps = fill(good, by, order, {"__prev": stamp}, width=width, strict=True) \
        .withColumn("__step", F.when(F.col(stamp) != F.col("__prev"), F.col(stamp) - F.col("__prev")))
    return join_on(stats, quantiles(steps, by, {"step_p50_s": ("__step", .5), "step_p95_s": ("__step", .95)}), by, "left")


def availability_summary(df: DataFrame, by: Sequence[str], order: Sequence[str], sample_interval_s: float, width,
                         state: str = "state", reason: str = "reason", sample_reason: str = "sample_reason",
                         transient: str = "transient") -> DataFrame:
    """Availability of each node. ``order[0]`` is in microseconds; down time is samples x nominal interval."""
    t = order[0]
    prev = lagged(df, by, order, {"__prev": (state, 1)}, width=width)
    named = F.coalesce(F.col(reason), F.lit("")) != ""
    entered = (F.col(state) == "DOWN") & (F.coalesce(F.col("__prev"), F.lit("UP")) != "DOWN") & named

    def reasons(*names):
        return n_if(F.col(reason).isin(*names))

    out = prev.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), n_if(F.col(state) == "DOWN").alias("down"),
        n_if(F.col(state) == "DEGRADED").alias("degraded"), n_if(F.col(transient)).alias("transient"),
        n_if(F.col(sample_reason).isin("compute_check_failed", "compute_check_timeout")).alias("impaired"),
        n_if(entered).alias("outage_events"), ((F.max(t) - F.min(t)) / 1e6).alias("duration_s"),
        reasons("sentinel_unreachable").alias("__su"), reasons("compute_latency_high").alias("__cl"),
        reasons("compute_check_timeout", "compute_check_failed").alias("__cf"))
    per = lambda c: F.round(F.col(c) / (F.col("samples") / 1000.0), 6)
    step = F.lit(float(sample_interval_s))
    return out.select(
        *by, "samples", "down", "degraded", "transient", "impaired", "outage_events",
        F.round("duration_s", 3).alias("duration_s"), F.round(F.col("duration_s") / step, 3).alias("expected_samples"),
        F.round(F.when(F.col("samples") > 1, F.col("duration_s") / (F.col("samples") - 1)).otherwise(step), 6)
        .alias("effective_interval_s"),
        (F.col("down") * step).alias("down_seconds"),
        F.round((F.col("samples") - F.col("down")) / F.col("samples") * 100.0, 6).alias("availability_pct"),
        per("degraded").alias("degraded_per_1000"), per("__su").alias("unreachable_per_1000"),
        per("__cl").alias("latency_high_per_1000"), per("__cf").alias("compute_failed_per_1000"))


def reason_counts(df: DataFrame, by: Sequence[str], reason: str) -> DataFrame:
    """``reason:count`` text per key; the reasons of a state machine are a small fixed set."""
    counted = df.filter(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(*by, reason).agg(
        F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", reason, F.col("__n").cast("string")))), ";").alias("reasons"))


def counters(df: DataFrame, by: Sequence[str], name: str, members: Sequence[str]) -> DataFrame:
    """Counts per key and label, with a zero row for each of the fixed ``members`` that is absent."""
    seen = df.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    wanted = df.select(*by).distinct().withColumn(name, F.explode(F.array(*[F.lit(m) for m in members])))
    return join_on(wanted, seen, [*by, name], "left").fillna(0, ["n"])


def ever_seen(df: DataFrame, by: Sequence[str], status: str, members: Sequence[str]) -> DataFrame:
    """Per key: whether each status was ever observed."""
    return df.groupBy(*by).agg(*[F.bool_or(F.col(status) == m).alias(f"ever_{m.lower()}") for m in members])


def counter_steps(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, width) -> DataFrame:
    """Increase of a counter since its previous sample; a drop is a restart and counts from zero."""
    prev = lagged(df, series, order, {"__p": (value, 1), "__pt": (order[0], 1)}, width=width)
    step = F.when(F.col("__p").isNull(), None).when(F.col(value) < F.col("__p"), F.col(value)) \
        .otherwise(F.col(value) - F.col("__p"))
    return prev.withColumn("increase", step).withColumn("elapsed", F.col(order[0]) - F.col("__pt")).drop("__p", "__pt")


def counter_rate(df: DataFrame, series: Sequence[str], group: Sequence[str], order: Sequence[str], value: str,
                 window: int, width, unit: float = 1.0, scale: float = 1.0) -> DataFrame:
    """Rate per window summed over the series of each group. ``window`` and ``order[0]`` share a unit,
    of which ``unit`` make one second; ``scale`` 8 turns bytes into bits."""
    steps = counter_steps(df, series, order, value, width)
    w = (F.floor(F.col(order[0]) / window) * window).cast("bigint")
    return steps.filter(F.col("increase").isNotNull()).groupBy(*group, w.alias("window_start")).agg(
        (F.sum("increase") / F.lit(window / unit) * F.lit(scale)).alias("rate"), F.count(F.lit(1)).alias("samples"))


def smoothed_rate(rates: DataFrame, by: Sequence[str], t: str, rate: str, step: int, span: int) -> DataFrame:
    """Average of the rates evaluated in the trailing ``span``; each rate is sent to the windows it serves."""
    served = rates.withColumn("__at", F.explode(F.sequence(F.col(t), F.col(t) + F.lit(span - step), F.lit(step).cast("bigint"))))
    averaged = served.groupBy(*by, "__at").agg(F.avg(rate).alias("smoothed"), F.count(F.lit(1)).alias("points"))
    return join_on(rates.select(*by, t), averaged.withColumnRenamed("__at", t), [*by, t])


def benchmark_result(df: DataFrame, by: Sequence[str], elapsed: str, ok: str, latency: str, prompt: str,
                     completion: str) -> DataFrame:
    """Throughput, token rates, means and rounded-index latency quantiles of one benchmark run per key."""
    out = summarise(df, by, {
        "completed": n_if(F.col(ok)), "failed": n_if(~F.col(ok)), "__el": F.max(elapsed),
        "__pt": F.sum(prompt), "__ct": F.sum(completion), "mean_latency_s": F.round(F.avg(latency), 3),
        "mean_prompt_tokens": F.round(F.avg(prompt), 3), "mean_completion_tokens": F.round(F.avg(completion), 3)},
        {"latency_p50_s": (latency, rounded(.5)), "latency_p95_s": (latency, rounded(.95))})
    el = F.round(F.greatest(F.col("__el"), F.lit(0.001)), 3)
    rate = lambda c: F.when(F.col(c) > 0, F.round(F.col(c) / el, 3)).otherwise(0.0)
    return out.select(
        *by, "completed", "failed", F.when(F.col("failed") == 0, "succeeded").otherwise("completed_with_errors").alias("status"),
        el.alias("elapsed_s"), F.round(F.col("completed") / el, 3).alias("throughput_rps"),
        rate("__pt").alias("prompt_tps"), rate("__ct").alias("generation_tps"),
        F.when((F.col("__pt") + F.col("__ct")) > 0, F.round((F.col("__pt") + F.col("__ct")) / el, 3)).otherwise(0.0).alias("total_tps"),
        "mean_latency_s", "mean_prompt_tokens", "mean_completion_tokens",
        F.round("latency_p50_s", 3).alias("latency_p50_s"), F.round("latency_p95_s", 3).alias("latency_p95_s"))


def accumulate_chunks(df: DataFrame, by: Sequence[str], completed: str, failed: str, tokens: Mapping[str, str],
                      means: Mapping[str, str], elapsed: str) -> DataFrame:
    """Continuous run from its chunks: completed-weighted means in seconds, totals over elapsed time."""
    done = F.col(completed)
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(done).alias("completed"), F.sum(failed).alias("failed"),
        F.max(elapsed).alias("__el"), *[F.sum(c).alias(f"__t_{n}") for n, c in tokens.items()],
        *[F.sum(F.when(done > 0, F.col(c) * done)).alias(f"__w_{n}") for n, c in means.items()])
    el = F.round(F.greatest(F.col("__el"), F.lit(0.001)), 3)
    return out.select(
        *by, "chunks", "completed", "failed", F.round(F.col("completed") / el, 3).alias("throughput_rps"),
        *[F.when(F.col(f"__t_{n}") > 0, F.round(F.col(f"__t_{n}") / el, 3)).otherwise(0.0).alias(f"{n}_tps") for n in tokens],
        *[F.when(F.col("completed") > 0, F.round(F.col(f"__w_{n}") / F.col("completed") / 1000.0, 4)).alias(f"mean_{n}_s")
          for n in means])


def progress_buckets(df: DataFrame, by: Sequence[str], bucket: str, sums: Mapping[str, Column], trailing: int = 5,
                     width: int = 100_000) -> DataFrame:
    """Zero-filled per-second buckets from 0 to the last one, with rates over the buckets present of the last few."""
    seen = df.groupBy(*by, bucket).agg(*[c.alias(n) for n, c in sums.items()])
    bounds = seen.groupBy(*by).agg(F.lit(0).cast("bigint").alias("__a"), F.max(bucket).alias("__z"))
    bins = dense_bins(bounds, "__a", "__z", bucket).drop("__a", "__z")
    full = join_on(bins, seen, [*by, bucket], "left").fillna(0, list(sums)) \
        .withColumn("__i", F.col(bucket) + 1)
    return framed(full, by, [bucket], lambda w: {
        f"current_{n}": F.round(F.sum(n).over(w.rowsBetween(1 - trailing, 0))
                                / F.count(F.lit(1)).over(w.rowsBetween(1 - trailing, 0)), 3) for n in sums},
        before=trailing - 1, index="__i", block=width).drop("__i")


def step_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, and the population standard deviation where there are at least two values."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                               F.when(F.count(value) >= 2, F.stddev_pop(value)).alias("stddev_pop"))


def pearson(x: str, y: str, minimum: int = 3) -> Column:
    """Correlation over complete pairs; null under ``minimum`` pairs or when a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    usable = (F.count(a) >= minimum) & (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(usable, F.corr(a, b))


def feature_profile(df: DataFrame, features: Sequence[str], load: str) -> DataFrame:
    """Candidate profile of each feature column and its relation to the offered load (few levels)."""
    long = long_form(df, [load], features, "feature", "value").withColumn("__load", F.col(load).cast("double"))
    stats = summarise(long, ["feature"], {
        "rows": F.count(F.lit(1)), "non_missing": F.count("value"), "unique_count": F.count_distinct("value"),
        "mean": F.avg("value"), "std": F.when(F.count("value") > 1, F.stddev_samp("value")),
        "min": F.min("value"), "max": F.max("value"), "pearson_with_load": pearson("__load", "value")},
        {"median": ("value", .5)}).withColumn("missing_rate", 1 - F.col("non_missing") / F.col("rows"))
    levels = quantiles(long.filter(F.col("__load").isNotNull()), ["feature", load], {"__m": ("value", .5)})
    text = levels.groupBy("feature").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(load), F.round("__m", 4).alias("m")))),
        lambda s: F.concat_ws(":", s[load].cast("string"), F.format_string("%.4f", s["m"]))), "; ").alias("median_by_load"))
    return join_on(stats, text, ["feature"], "left")


def fold_features(df: DataFrame, folds: DataFrame, run: str, features: Sequence[str], targets: Sequence[str],
                  forbidden: Sequence[str]) -> DataFrame:
    """Feature decision per fold from its training rows. ``folds`` is (fold, run, is_test), small per run.

    Runs that train the same folds are counted together; only their sums and distinct values are multiplied by the folds."""
    alike = folds.filter(~F.col("is_test")).groupBy(run).agg(F.sort_array(F.collect_list(F.struct("fold"))).alias("__folds"))
    first = alike.groupBy("__folds").agg(F.min(F.struct(F.col(run).alias("r"))).alias("__alike"))
    runs = cut(join_on(alike, first, ["__folds"]).select(run, "__folds", "__alike"))
    sets = runs.select("__alike", "__folds").distinct().select("__alike", F.explode("__folds").alias("__f")).select("__alike", F.col("__f.fold").alias("fold"))
    long = long_form(join_on(df, runs.select(run, "__alike"), [run], small=is_small(runs)), ["__alike"], features, "feature", "value")
    per = long.groupBy("__alike", "feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("k"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    per = join_on(per, sets, ["__alike"]).withColumn("__of", F.sum("k").over(W.partitionBy("fold", "feature"))) \
        .withColumn("__mean", F.sum(F.col("m") * F.col("k")).over(W.partitionBy("fold", "feature")) / F.nullif(F.col("__of"), F.lit(0)))
    squares = F.sum(F.col("k") * (F.col("v") + (F.col("m") - F.col("__mean")) * (F.col("m") - F.col("__mean"))))
    sums = per.groupBy("fold", "feature").agg(F.sum("n").alias("train_rows"), F.sum("k").alias("non_missing"),
                                              F.when(F.sum("k") > 1, F.sqrt(squares / (F.sum("k") - 1))).alias("std"))
    values = join_on(long.filter(F.col("value").isNotNull()).distinct(), sets, ["__alike"]).select("fold", "feature", "value").distinct()
    unique = values.groupBy("fold", "feature").agg(F.count(F.lit(1)).alias("unique_count"))
    out = join_on(sums, unique, ["fold", "feature"], "left").select(
        "fold", "feature", "train_rows", "non_missing", F.coalesce("unique_count", F.lit(0).cast("bigint")).alias("unique_count"), "std")
    few = F.col("non_missing") < F.greatest(F.lit(12), F.floor(F.col("train_rows") * 0.5))
    flat = (F.col("unique_count") <= 1) | F.col("std").isNull() | (F.col("std") < 1e-9)
    return out.withColumn("missing_rate", 1 - F.col("non_missing") / F.greatest(F.col("train_rows"), F.lit(1))).withColumn(
        "decision", F.when(F.col("feature").isin(*forbidden), "forbidden_primary_feature")
        .when(F.col("feature").isin(*targets), "target_leakage_feature")
        .when(few, "too_many_missing_values").when(flat, "constant_or_near_constant_in_training_fold")
        .otherwise("selected"))


def gap_list(fields: Mapping[str, Column]) -> Column:
    """``a_missing;b_missing`` for the fields that are null or empty."""
    return F.concat_ws(";", *[F.when(c.isNull() | (c.cast("string") == ""), F.lit(f"{n}_missing")) for n, c in fields.items()])


def time_thirds(df: DataFrame, by: Sequence[str], t: str, values: Sequence[str], length: Column | None = None) -> DataFrame:
    """Medians of the early, middle and late third of each run, cut by elapsed time against its row count."""
    size = df.groupBy(*by).agg((length if length is not None else F.count(F.lit(1))).alias("__n"))
    tagged = join_on(df, size, by).withColumn(
        "segment", F.when(F.col(t) < F.col("__n") / 3, "early").when(F.col(t) < 2 * F.col("__n") / 3, "middle").otherwise("late"))
    return summarise(tagged, [*by, "segment"], {"rows": F.count(F.lit(1))}, {f"{v}_median": (v, .5) for v in values})


def terciles(df: DataFrame, by: Sequence[str], t: str, ok: str, values: Sequence[str], digits: int = 3) -> DataFrame:
    """Summary of the parts below, between and above the tercile cut points of ``t``."""
    cuts = quantiles(df, by, {"__q1": (t, 1 / 3), "__q2": (t, 2 / 3)})
    tagged = join_on(df, cuts, by).withColumn(
        "segment", F.when(F.col(t) <= F.col("__q1"), "early").when(F.col(t) <= F.col("__q2"), "mid").otherwise("late"))
    good = {v: F.when(F.col(ok), F.col(v)) for v in values}
    return summarise(tagged, [*by, "segment"], {
        "rows": F.count(F.lit(1)), "success_rows": n_if(F.col(ok)),
        **{f"{v}_mean": F.avg(c) for v, c in good.items()}}, {f"{v}_p95": (c, .95) for v, c in good.items()}, digits=digits)


def segment_summary(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], *, n: int = 3,
                    width=None) -> DataFrame:
    """Median per equal-count segment and the change from the first segment to the last."""
    placed = numbered(df, by, order, "__rn", width=width)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    tagged = join_on(placed, size, by).withColumn(
        "segment", F.least(F.floor((F.col("__rn") - 1) * n / F.col("__size")), F.lit(n - 1)).cast("int"))
    med = summarise(tagged, [*by, "segment"], {"rows": F.count(F.lit(1))}, {v: (v, .5) for v in values})
    return med.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        *[(F.max(F.when(F.col("segment") == n - 1, F.col(v))) - F.max(F.when(F.col("segment") == 0, F.col(v))))
          .alias(f"{v}_first_to_last") for v in values])


def exceedance_timing(df: DataFrame, by: Sequence[str], t: str, flag: str, warmup) -> DataFrame:
    on = F.coalesce(F.col(flag), F.lit(False))
    early = on & (F.col(t) < warmup)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), n_if(on).alias("exceedances"),
                              n_if(early).alias("early_exceedances"), F.min(F.when(on, F.col(t))).alias("first_exceedance"))
    return out.withColumn("early_fraction", ratio(F.col("early_exceedances"), F.col("exceedances"), 0))


def forecast_metrics(df: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, bias (actual minus predicted) and R² over the rows that have both sides."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(actual) - F.col(predicted)
    sst = F.var_pop(actual) * F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"), F.when(sst > 0, 1 - F.sum(err * err) / sst).alias("r2"))


def false_alarms(df: DataFrame, by: Sequence[str], exceeds: str, valid: str, level: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Exceedances per healthy hour (one row per second) of each run, then their spread per level."""
    runs = df.filter(F.col(valid)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(exceeds).cast("double")).alias("exceedance_rate"),
        (n_if(F.col(exceeds)) / F.greatest(F.count(F.lit(1)) / 3600.0, F.lit(1e-9))).alias("per_healthy_hour"))
    spread = summarise(runs, level, {"runs": F.count(F.lit(1))}, {
        "median_per_hour": ("per_healthy_hour", .5), "p95_per_hour": ("per_healthy_hour", .95),
        "median_rate": ("exceedance_rate", .5)})
    return runs, spread


def binned_relation(df: DataFrame, x: str, y: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    binned = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("bin", F.floor(F.col(x) / width) * width)
    return summarise(binned, [*by, "bin"], {"n": F.count(F.lit(1))}, {
        "median": (y, .5), "p25": (y, .25), "p75": (y, .75), "p95": (y, .95)})


def empirical_distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    from .keys import value_code

    counted, keys = keyed(df.filter(F.col(value).isNotNull()), by)
    counted = counted.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("__t"))
    placed = running(counted, keys, [value], {"__c": F.col("n")}, slice_col=value_code(value))
    out = join_on(placed, total, keys).withColumn("share", F.col("__c") / F.col("__t")).drop("__c", "__t")
    return out if by else out.drop("__all")


def event_study(df: DataFrame, onsets: DataFrame, by: Sequence[str], t: str, onset: str, lo, hi, step,
                values: Sequence[str]) -> DataFrame:
    """Medians in bins of time relative to the onsets of the same key (bins round half to even)."""
    rel = near_join(df, onsets, by, t, onset, lo, hi).withColumn(
        "rel_bin", F.bround((F.col(t) - F.col(onset)) / step) * step)
    return summarise(rel, ["rel_bin"], {"rows": F.count(F.lit(1))}, {f"{v}_median": (v, .5) for v in values})


def event_windows(df: DataFrame, onsets: DataFrame, by: Sequence[str], t: str, onset: str,
                  windows: Sequence[tuple[float, float]], values: Sequence[str]) -> DataFrame:
    """Median and p90 in named half-open windows around each onset."""
    rel = near_join(df, onsets, by, t, onset, min(a for a, _ in windows), max(b for _, b in windows)) \
        .withColumn("__rel", F.col(t) - F.col(onset))
    label = F.coalesce(*[F.when((F.col("__rel") >= a) & (F.col("__rel") < b), f"{a}_to_{b}") for a, b in windows])
    tagged = rel.withColumn("window", label).filter(F.col("window").isNotNull())
    return summarise(tagged, ["window"], {"rows": F.count(F.lit(1))}, {
        **{f"{v}_median": (v, .5) for v in values}, **{f"{v}_p90": (v, .9) for v in values}})


def sweep_rows(df: DataFrame, by: Sequence[str], seconds: Column, ok: Column, status: str) -> DataFrame:
    """Attempted and successful rates and a status histogram text (status codes are a small set)."""
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("attempted"), n_if(ok).alias("successful"), seconds.alias("__s"))
    hist = df.groupBy(*by, status).agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).agg(F.array_join(F.array_sort(
        F.collect_list(F.concat_ws(":", F.col(status), F.col("__n").cast("string")))), ";").alias("status_histogram"))
    out = join_on(totals, hist, by)
    return out.select(*by, "attempted", "successful", ratio(F.col("attempted"), F.col("__s")).alias("attempted_rps"),
                      ratio(F.col("successful"), F.col("__s")).alias("successful_rps"), "status_histogram")


def baseline_gate(df: DataFrame, by: Sequence[str], ok: str, latency: str, health_ok: str, *, min_success_pct=99.999,
                  slow_ms=1000.0, max_ms=500.0) -> DataFrame:
    """Whether a run may serve as a clean normal baseline."""
    good = F.when(F.col(ok), F.col(latency))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), (F.avg(F.col(ok).cast("double")) * 100).alias("success_pct"),
        F.max(good).alias("max_ms"), n_if(good > slow_ms).alias("slow"), n_if(~F.col(health_ok)).alias("health_failures"))
    return out.withColumn("clean", F.coalesce(
        (F.col("success_pct") >= min_success_pct) & (F.col("slow") == 0) & (F.col("max_ms") <= max_ms)
        & (F.col("health_failures") == 0), F.lit(False)))


def rule_table(facts: DataFrame, by: Sequence[str], rules: Sequence[tuple[str, Column, Column, str]]) -> DataFrame:
    """Rows ``(check, status, observed, required)`` from one row of facts per key."""
    return facts.select(*by, F.explode(F.array(*[F.struct(
        F.lit(name).alias("check"), F.when(F.coalesce(passed, F.lit(False)), "pass").otherwise("fail").alias("status"),
        observed.cast("double").alias("observed"), F.lit(required).alias("required"))
        for name, passed, observed, required in rules])).alias("__r")).select(*by, "__r.*")


def abort_conditions(arrival: DataFrame, telemetry: DataFrame, by: Sequence[str], temperature: str, *, limit: float = 0.2,
                     max_temperature: float | None = None) -> DataFrame:
    """Whether a run must stop, and why: telemetry or arrivals missing, too hot, or a bin with too many drops,
    timeouts or errors."""
    heat = telemetry.groupBy(*by).agg(F.count(F.lit(1)).alias("telemetry_rows"), F.max(temperature).alias("temperature_max"))
    bins = arrival.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__bins"),
        F.max(F.col("dropped_max_inflight_count") / F.greatest(F.col("scheduled_request_count"), F.lit(1))).alias("drop_max"),
        F.max("timeout_rate").alias("timeout_max"), F.max("fail_rate").alias("fail_max"))
    out = join_on(bins, heat, by, "full_outer").fillna(0, ["__bins", "telemetry_rows"])
    hot = F.col("temperature_max") > max_temperature if max_temperature is not None else F.lit(False)
    rules = [("missing_gpu_telemetry", F.col("telemetry_rows") == 0), ("gpu_temperature_over_operator_limit", hot),
             ("client_max_inflight_saturation", F.col("drop_max") > limit), ("timeout_burst", F.col("timeout_max") > limit),
             ("error_burst", F.col("fail_max") > limit), ("missing_arrival_summary", F.col("__bins") == 0)]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])), ",")
    return out.withColumn("reasons", reasons).withColumn("abort", F.col("reasons") != "").drop("__bins")


def semantic_audit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Whether two sources report the same quantity: correlation, mean and median absolute difference."""
    diff = F.abs(F.col(x) - F.col(y))
    out = summarise(df, by, {"overlap_rows": F.count(F.lit(1)), "corr": pearson(x, y), "mae": F.avg(diff)},
                    {"median_abs_diff": (diff, .5)})
    med = F.col("median_abs_diff")
    return out.withColumn(
        "decision", F.when(F.col("corr").isNull(), "insufficient evidence")
        .when((F.col("corr") >= 0.7) & (F.when(med.isNull() | (med == 0), 999.0).otherwise(med) <= 10), "same semantic metric")
        .when((F.abs("corr") < 0.3) | (F.coalesce(med, F.lit(0.0)) > 20), "mismatched semantic metric")
        .otherwise("insufficient evidence"))


def band_summary(df: DataFrame, by: Sequence[str], matched: Column, in_band: Column, values: Sequence[str]) -> DataFrame:
    ok, band = F.coalesce(matched, F.lit(False)), F.coalesce(matched & in_band, F.lit(False))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), n_if(ok).alias("matched_rows"), n_if(band).alias("within_band_rows"),
        *[F.round(F.avg(F.when(ok, F.col(v))), 4).alias(f"{v}_all") for v in values],
        *[F.round(F.avg(F.when(band, F.col(v))), 4).alias(f"{v}_in_band") for v in values])
    return out.withColumn("within_band_ratio", F.round(ratio(F.col("within_band_rows"), F.col("matched_rows")), 4))


def usage_rollup(df: DataFrame, by: Sequence[str], value: str, labels: str = "labels") -> DataFrame:
    """Usage per key: the pod-level aggregate samples where there are any, else the sum of the container
    samples without pause images."""
    lab = lambda k: F.col(labels)[k]
    named = ~F.coalesce(lab("namespace"), F.lit("")).isin("", "[none]") & ~F.coalesce(lab("pod"), F.lit("")).isin("", "[none]")
    slice_ = named & F.coalesce(lab("id").endswith(".slice"), F.lit(False)) & (lab("container") == "[none]") \
        & (lab("image") == "[none]") & (lab("name") == "[none]") & (lab("cpu") == "total")
    scope = named & F.coalesce(lab("id").endswith(".scope"), F.lit(False)) \
        & ~F.coalesce(lab("image").contains("pause:"), F.lit(False))
    return df.groupBy(*by).agg(F.sum(F.when(slice_, F.col(value))).alias("slice_sum"),
                               F.sum(F.when(scope, F.col(value))).alias("scope_sum")) \
        .withColumn("usage", F.coalesce("slice_sum", "scope_sum"))


def cooled_down(kind: Column, cpu: Column, ram: Column, gpu: Column, vram: Column, base_ram: Column, base_vram: Column,
                cpu_max=10.0, gpu_max=5.0, vram_margin=2.0, ram_margin=3.0) -> Column:
    """Whether a node is back near its baseline; which resources count depends on the previous task."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cpu, ram, gpu, vram, base_ram, base_vram = map(z, (cpu, ram, gpu, vram, base_ram, base_vram))
    quiet = (cpu <= cpu_max) & (gpu <= gpu_max)
    vram_ok = vram <= F.greatest(F.lit(2.0), base_vram + vram_margin)
    return F.when(kind == "cpu_bound", quiet & vram_ok).when(kind == "ram_bound", quiet & (ram <= base_ram + ram_margin)) \
        .when(kind == "vram_bound", (cpu <= 20.0) & (gpu <= gpu_max) & vram_ok).otherwise(quiet)


def run_summary(df: DataFrame, by: Sequence[str], t: str, flag: str, clean: Column, error_type: str, latency: str) -> DataFrame:
    """Rows, success over the parseable flags, clean-latency profile and achieved rates (``t`` in microseconds)."""
    word = F.lower(F.trim(F.col(flag)))
    num = F.when(word.isin("1", "1.0", "true"), 1.0).when(word.isin("0", "0.0", "false"), 0.0)
    good = F.when(clean, F.col(latency))
    span = (F.max(t) - F.min(t)) / 1e6
    out = summarise(df, by, {
        "rows": F.count(F.lit(1)), "success_rate": F.avg(num), "clean_rows": F.count(good), "clean_mean": F.avg(good),
        "clean_min": F.min(good), "clean_max": F.max(good),
        "achieved_rps": F.when(span > 0, F.count(F.lit(1)) / span), "successful_rps": F.when(span > 0, n_if(clean) / span)},
        {"clean_p50": (good, .5), "clean_p90": (good, .9), "clean_p95": (good, .95), "clean_p99": (good, .99)})
    kinds = reason_counts(df.withColumn("__e", F.when(F.coalesce(F.col(error_type), F.lit("")) == "", "<empty>")
                                        .otherwise(F.col(error_type))), by, "__e").withColumnRenamed("reasons", "error_types")
    return join_on(out, kinds, by, "left")
