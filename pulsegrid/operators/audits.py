"""Audits as tables of checks: readiness of a campaign, soundness of a method, counts of a history, collation of a batch of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import join_on
from .quantiles import quantiles
from .scoring import classifier_metrics
from .summary import n_if, rule_table

# Check names, and the words that mark a manifest as unusable.
TRUE_WORDS = ("true", "1")
HISTORY_FILTERS = {
    "all": None, "inference": ("single_inference",), "serving": ("serving_benchmark", "controlled_batch"),
    "throughput": ("offline_throughput_benchmark", "llamacpp_offline_benchmark"),
}


def readiness(runs: DataFrame, by: Sequence[str], *, eligible_rows: str, ineligible: str, temperature_drift: str, clock_drift: str, episodes: str,
              min_replicates: int, min_rows: int, max_temperature_drift: float, max_clock_drift: float) -> DataFrame:
    """The six readiness checks of every campaign in ``by`` from one row per run, as ``(check, status, observed, required)``; a drift nobody measured fails."""
    marked = F.lower(F.col(ineligible).cast("string")).isin(*TRUE_WORDS)
    facts = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum(eligible_rows), F.lit(0)).alias("rows"), n_if(marked).alias("marked"),
        F.max(F.abs(temperature_drift)).alias("temperature"), F.max(F.abs(clock_drift)).alias("clock"), F.coalesce(F.sum(episodes), F.lit(0)).alias("episodes"))
    c = F.col
    return rule_table(facts, by, [
        ("normal_long_replicates", c("runs") >= min_replicates, c("runs"), str(min_replicates)),
        ("formal_measurement_rows", c("rows") >= min_rows, c("rows"), str(min_rows)),
        ("manifest_validity", c("marked") == 0, c("marked"), "0"),
        ("gpu_temp_internal_drift", c("temperature") <= max_temperature_drift, c("temperature"), f"<= {max_temperature_drift}"),
        ("sm_clock_internal_drift", c("clock") <= max_clock_drift, c("clock"), f"<= {max_clock_drift}"),
        ("service_state_normalized_latency_episodes", c("episodes") == 0, c("episodes"), "0")])


def readiness_decision(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """What the checks of a campaign amount to."""
    failed = n_if(F.col("status") == "fail")
    return checks.groupBy(*by).agg(failed.alias("failed_checks"), F.when(failed > 0, "not_ready_collect_more_normal_or_fix_contract").otherwise(
        "method_ready_but_live_cooling_executor_still_fail_closed").alias("decision"))


def methodology_audit(rows: DataFrame, *, run: str, cycle: str, profile: str, t: str, warning: str, onset: str, label: str, score: str, train: Column, in_thresholds: Column,
                      features: Mapping[str, tuple[int, int]], forbidden: Sequence[str], label_frame: tuple[int, int], endpoint: Sequence[str], required_endpoint: Sequence[str],
                      horizon: float, least_train: int = 200, least_test: int = 50) -> DataFrame:
    """``(check, status, observed)`` on a table of scored rows. ``features`` and ``label_frame`` give the first and last row, relative to the present one, that a feature or the label looks at.

    The control fits nothing: a model of time alone orders rows by time, upwards or downwards as the training rows have it, so its average precision is that of the time itself.
    """
    one = rows.withColumn("__train", F.coalesce(train, F.lit(False))).withColumn("__thr", F.coalesce(in_thresholds, F.lit(False)))
    y = F.col(label).cast("double")
    up = F.avg(F.when(F.col("__train") & (y == 1), F.col(t))) >= F.avg(F.when(F.col("__train") & (y == 0), F.col(t)))
    facts = one.agg(
        F.count_distinct(profile).alias("profiles"), F.count_distinct(run).alias("runs"), F.count_distinct(F.struct(run, cycle)).alias("cycles"),
        n_if(F.col("__thr") & ~F.col("__train")).alias("outside"), n_if(F.col("__train")).alias("trained"), n_if(~F.col("__train")).alias("tested"),
        F.coalesce(up, F.lit(True)).alias("up"))
    leads = one.groupBy(cycle).agg(F.min(F.when(F.col(warning), F.col(t))).alias("w"), F.min(onset).alias("o")).filter("w is not null")
    near = leads.agg(F.count(F.lit(1)).alias("warned"), F.avg((F.abs(F.col("o") - F.col("w") - horizon) <= 1).cast("double")).alias("exactish"))
    facts = join_on(facts.withColumn("__all", F.lit(0)), near.withColumn("__all", F.lit(0)), ["__all"])
    test = one.filter(~F.col("__train")).withColumn("__y", F.col(label).cast("int")).withColumn("__down", -F.col(t))
    control = [classifier_metrics(test, [], s, "__y", 0).select(F.col("average_precision").alias(n), F.lit(0).alias("__all")) for s, n in ((t, "ap_up"), ("__down", "ap_down"))]
    by_run = classifier_metrics(one.withColumn("__y", F.col(label).cast("int")), [run], score, "__y", 0).filter("average_precision is not null")
    spread = quantiles(by_run.withColumn("__all", F.lit(0)), ["__all"], {"run_ap": ("average_precision", .5)})
    for more in (*control, spread):
        facts = join_on(facts, more, ["__all"], "left")
    c, number = F.col, F.lit
    ap = F.when(c("up"), c("ap_up")).otherwise(c("ap_down"))
    enough = (c("trained") > least_train) & (c("tested") > least_test)
    good = lambda passed: F.when(passed, "PASS").otherwise("FAIL")
    checks = [
        ("primary_features_exclude_template_and_control_metadata", good(number(not set(features) & set(forbidden))), number(len(set(features) & set(forbidden)))),
        ("rolling_features_use_past_and_current_only", good(number(all(z <= 0 for _, z in features.values()))), number(max([z for _, z in features.values()], default=0))),
        ("early_warning_label_uses_future_only", good(number(label_frame[0] >= 0 and label not in features)), number(label_frame[0])),
        ("normal_thresholds_training_only", good(c("outside") == 0), c("outside")),
        ("timeout_error_in_endpoint", good(number(set(required_endpoint) <= set(endpoint))), number(len(set(required_endpoint) & set(endpoint)))),
        ("leave_one_profile_out_feasibility", F.when(c("profiles") <= 1, "NOT_APPLICABLE").otherwise("PENDING"), c("profiles")),
        ("leave_one_cycle_out_equivalence", good(c("cycles") == c("runs")), c("cycles")),
        ("lead_time_not_only_horizon_artifact", F.when(c("warned") > 0, F.when(c("exactish") > 0.5, "WARN").otherwise("PASS")), c("exactish")),
        ("template_time_only_negative_control", F.when(enough, F.when(ap >= 0.95, "WARN").otherwise("PASS")), ap),
        ("groupwise_validation_by_run", F.when(c("run_ap").isNotNull(), "PASS"), c("run_ap"))]
    table = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), s.alias("status"), v.cast("double").alias("observed")) for n, s, v in checks]))
    return facts.select(table.alias("__r")).select("__r.*").filter("status is not null")


def history_counts(history: DataFrame, by: Sequence[str], kind: str, filters: Mapping[str, Sequence[str] | None] = HISTORY_FILTERS, shown: int = 5) -> DataFrame:
    """Per key and filter: entries shown, and how many of the filter's entries are inferences and how many benchmarks. A filter that nothing passes has no row."""
    hits = F.array_compact(F.array(*[F.when(F.lit(True) if kinds is None else F.col(kind).isin(*kinds), F.lit(n)) for n, kinds in filters.items()]))
    single = F.coalesce(F.col(kind) == "single_inference", F.lit(False))
    out = history.withColumn("filter", F.explode(hits)).groupBy(*by, "filter").agg(
        F.least(F.count(F.lit(1)), F.lit(shown)).alias("shown"), n_if(single).alias("inferences"), n_if(~single).alias("benchmarks"))
    return out


def collated_batch(manifest: DataFrame, aligned: DataFrame, service: DataFrame, key: str, *, status: str, phase: str, phases: Mapping[str, str], statistics: Sequence[str],
                   summary: Sequence[str]) -> DataFrame:
    """One row for every run of a batch that ended well and has an aligned summary: its summary columns, and ``phase_statistic`` of every named phase and statistic. A phase
    without a summary leaves nulls; of a phase given twice the last by statistic order is not defined by the source, so the greatest is taken."""
    spread = service.groupBy(key).agg(*[F.max(F.when(F.col(phase) == name, F.col(s))).alias(f"{short}_{s}") for s in statistics for name, short in phases.items()])
    good = manifest.filter(F.col(status) == "ok")
    return join_on(join_on(good, aligned.select(key, *summary), [key]), spread, [key], "left")

