"""Inventory, workload and fleet roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import col, join_on
from .summary import counters, n_if


def levels_rollup(df: DataFrame, by: Sequence[str], ready: Column, sums: Mapping[str, str]) -> DataFrame:
    """One level of a namespace / deployment / pod roll-up: sizes, readiness and summed usage."""
    r = F.coalesce(ready, F.lit(False))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pods"), n_if(r).alias("ready_pods"), F.bool_and(r).alias("all_ready"),
        *[F.sum(c).alias(n) for n, c in sums.items()])


def phase_counts(df: DataFrame, by: Sequence[str], phase: str, phases: Sequence[str]) -> DataFrame:
    return counters(df, by, phase, phases)


def device_memory(total: Column, used: Column, free: Column, reserved: Column) -> Column:
    """Total memory as reported, else the sum of its parts when all are known."""
    return F.coalesce(total, used + free + reserved)


def fleet_devices(df: DataFrame, by: Sequence[str], avg: Sequence[str] = (), high: Sequence[str] = (),
                  low: Sequence[str] = (), total: Sequence[str] = ()) -> DataFrame:
    """Device statistics per node; absent readings are skipped."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("devices"), *[F.avg(c).alias(f"{c}_avg") for c in avg], *[F.max(c).alias(f"{c}_max") for c in high],
        *[F.min(c).alias(f"{c}_min") for c in low], *[F.sum(c).alias(f"{c}_sum") for c in total])


def missing_fields(fields: Mapping[str, str]) -> Column:
    """Names of the expected fields a device does not report, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in sorted(fields.items())])), ",")


def missing_on_all(df: DataFrame, by: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """Per node, the fields no device reports."""
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("devices"), *[F.count(c).alias(f"__{n}") for n, c in fields.items()])
    return counted.select(*by, "devices", F.array_join(F.array_compact(F.array(
        *[F.when(F.col(f"__{n}") == 0, F.lit(n)) for n in sorted(fields)])), ",").alias("missing_on_all"))


def distinct_members(df: DataFrame, by: Sequence[str], member: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(member).alias(name))


def workload_status(replicas: DataFrame, by: Sequence[str], ready: str, phase: str, metrics: Sequence[str], peak: str,
                    stamp: str, now: Column, desired: str) -> DataFrame:
    """Status of each workload from its replicas: readiness, metrics coverage, summed rates, freshness."""
    observed = F.coalesce(*[F.col(m).isNotNull() for m in metrics][:1])
    for m in [*metrics[1:], peak]:
        observed = observed | F.col(m).isNotNull()
    observed = observed if len(metrics) > 1 else observed | F.col(peak).isNotNull()
    out = replicas.groupBy(*by).agg(
        F.max(desired).alias("desired"), n_if(F.col(ready)).alias("ready"), n_if(observed).alias("metrics_available"),
        *[F.sum(m).alias(m) for m in metrics], F.max(peak).alias(f"{peak}_max"), F.max(stamp).alias("metrics_ts"))
    return out.withColumn("metrics_unavailable", F.greatest(F.col("ready") - F.col("metrics_available"), F.lit(0))) \
        .withColumn("freshness_s", F.when(F.col("metrics_ts") > 0, F.round(F.greatest(now - F.col("metrics_ts"), F.lit(0.0)), 3))
                    .otherwise(0.0)) \
        .withColumn("status", F.when(F.col("ready") == 0, "not_ready").when(F.col("metrics_available") == 0, "metrics_unavailable")
                    .otherwise("ready"))


def replica_status(ready: Column, phase: Column, has_metric: Column) -> Column:
    return F.when(ready & has_metric, "ready").when(ready, "metrics_unavailable") \
        .when(F.coalesce(phase, F.lit("")) != "", "not_ready").otherwise("pending")


def named_member(items, name: str, field: str, key: str = "name") -> Column:
    """Field of the first array member of that name (null when there is none)."""
    return F.try_element_at(F.filter(col(items), lambda x: x[key] == name), F.lit(1))[field]


def snapshot_means(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("snapshots"), *[F.avg(v).alias(f"{v}_mean") for v in values])


def fleet_summary(nodes: DataFrame, by: Sequence[str], health: str, states: Sequence[str], name: str,
                  peaks: Mapping[str, str]) -> DataFrame:
    """Health counts and the node with the highest value of each measure (ties: the smaller name)."""
    # max_by over (value, reversed name order) needs a total order: compare the value, then the smaller name.
    aggs = [n_if(F.col(health) == s).alias(f"{s}_nodes") for s in states]
    for label, c in peaks.items():
        aggs += [F.max(c).alias(f"__max_{label}")]
    totals = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"), *aggs)
    tops = join_on(nodes, totals.select(*by, *[f"__max_{label}" for label in peaks]), by).groupBy(*by).agg(
        *[F.min(F.when(F.col(c) == F.col(f"__max_{label}"), F.col(name))).alias(f"top_{label}") for label, c in peaks.items()])
    return join_on(totals.drop(*[f"__max_{label}" for label in peaks]), tops, by)


def local_presence(nodes: DataFrame, pods: DataFrame, node: str, pod_node: str) -> DataFrame:
    """Pods on each node with a zero row where there are none."""
    counted = pods.groupBy(F.col(pod_node).alias(node)).agg(F.count(F.lit(1)).alias("local_pods"))
    out = join_on(nodes, counted, [node], "left").fillna(0, ["local_pods"])
    return out.withColumn("presence", F.when(F.col("local_pods") > 0, "present").otherwise("none"))
