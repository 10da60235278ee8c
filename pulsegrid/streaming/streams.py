"""Structured Streaming forms of the operators. Each takes and returns streaming DataFrames; ``run`` drains
what is available into a table in a shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid.operators.align import enrich  # noqa: F401  (works on a stream as it is)
from pulsegrid.operators.keys import delete_folder, path_exists, scratch_folder
from pulsegrid.operators.sequence import confirmed
from pulsegrid.operators.summary import freshness, n_if

from .stateful import NearestInBucket, in_event_order, use_state_store as _stateful


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder (or one file) as a stream with the schema they have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern may name one file as well as a folder; a plain path must be a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, folder: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process everything available into a Parquet table and return it; a restart with the same folder goes on
    where the last run stopped."""
    spark = stream.sparkSession
    folder = folder or f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start(f"{folder}/table")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def _summary(stream: DataFrame, ts: str, window: Column, by: Sequence[str], late: str, ok: Column, latency: str) -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(window.alias("__w"), *by).agg(
        F.count(F.lit(1)).alias("requests"), n_if(ok).alias("successes"), F.avg(F.when(ok, F.col(latency))).alias("latency_mean"),
        F.max(F.when(ok, F.col(latency))).alias("latency_max"))
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *by, "requests", "successes",
                      "latency_mean", "latency_max")


def tumbling_summary(stream: DataFrame, ts: str, by: Sequence[str], ok: Column, latency: str, *, width: str = "1 second", late: str = "30 seconds") -> DataFrame:
    """Service summary per window; a window is final once the watermark has passed its end."""
    return _summary(stream, ts, F.window(ts, width), by, late, ok, latency)


def trailing_throughput(stream: DataFrame, ts: str, by: Sequence[str], ok: Column, latency: str, *, span: str = "5 seconds", step: str = "1 second",
                        late: str = "30 seconds", seconds: float = 5.0) -> DataFrame:
    """Throughput over the trailing ``span`` at every ``step``."""
    out = _summary(stream, ts, F.window(ts, span, step), by, late, ok, latency)
    return out.withColumn("rps", F.col("requests") / F.lit(float(seconds)))


def outage_sessions(stream: DataFrame, ts: str, by: Sequence[str], failed: Column, *, gap: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Failures of a key that follow each other within ``gap``."""
    out = stream.filter(failed).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("__w"), *by).agg(
        F.count(F.lit(1)).alias("failures"), F.min(ts).alias("first_failure"), F.max(ts).alias("last_failure"))
    return out.drop("__w")


def failure_streak_stream(stream: DataFrame, key: str, ts: str, tie: Sequence[str], failed: str, keep: Sequence[str], *, late: str) -> DataFrame:
    """Failure streak of every sample of a node, as ``key, us, tie, failed, keep, streak``. Samples are taken in order of event time once the watermark has
    passed them, so those that come late within ``late`` count in their place; the state of a node is one number and what it waits for."""
    def streaks(rows, carry):
        bad = rows[failed].fillna(False).to_numpy(bool)
        at = np.arange(1, len(bad) + 1)
        good = np.maximum.accumulate(np.where(bad, 0, at))
        streak = np.where(good > 0, at - good, at + (carry[0] if carry else 0))
        return rows.assign(streak=streak), (int(streak[-1]),)

    return in_event_order(stream, key, ts, tie, [failed, *keep], streaks, {"streak": "bigint"}, "streak bigint", late=late)


def confirmed_state(stream: DataFrame, key: str, ts: str, tie: Sequence[str], sample_state: str, sample_reason: str, *, confirm: int = 3, late: str = "30 seconds") -> DataFrame:
    """Effective state of every availability sample: an unreachable node is down after ``confirm`` failures in a row."""
    lost = stream.withColumn("__lost", F.coalesce(F.col(sample_reason) == "sentinel_unreachable", F.lit(False)))
    rows = failure_streak_stream(lost, key, ts, tie, "__lost", [sample_state, sample_reason], late=late)
    state, reason, transient = confirmed(F.col(sample_state), F.col(sample_reason), F.col("streak"), confirm)
    return rows.select(key, "us", *tie, "streak", state.alias("state"), reason.alias("reason"), transient.alias("transient"))


def debounce_stream(stream: DataFrame, key: str, ts: str, refractory_us: int, keep: Sequence[str], *, late: str) -> DataFrame:
    """Alerts at least ``refractory_us`` after the last kept one of their key, as ``key, us, keep``. Alerts wait until the watermark has passed them, so
    one that comes late within ``late`` can take the place of a later one, as it would in a batch. Of alerts at one moment the first by ``keep`` is taken."""
    def kept(rows, carry):
        times = rows["us"].to_numpy("int64")
        chosen, last = [], carry[0] if carry else None
        at = 0 if last is None else int(np.searchsorted(times, last + refractory_us))
        while at < len(times):  # one step for every alert that is kept
            chosen.append(at)
            last = int(times[at])
            at = int(np.searchsorted(times, last + refractory_us))
        return rows.iloc[chosen], (last,)

    return in_event_order(stream, key, ts, list(keep), [], kept, {}, "last bigint", late=late)


def enrich_stream(stream: DataFrame, table: DataFrame, on: Sequence[str], defaults: Mapping[str, str]) -> DataFrame:
    """Join a stream with an inventory table; entities it lacks get the defaults."""
    out = stream.join(table, list(on), "left")
    return out.fillna(dict(defaults))


def near_stream(requests: DataFrame, telemetry: DataFrame, by: Sequence[str], ts: str, other_ts: str, *, within: str, late: str) -> DataFrame:
    """Pairs of the two streams at most ``within`` apart, by key."""
    left = requests.withWatermark(ts, late)
    right = telemetry.select(*[F.col(c).alias(f"__r_{c}") if c in by else F.col(c) for c in telemetry.columns]).withWatermark(other_ts, late)
    cond = F.col(other_ts).between(F.col(ts) - F.expr(f"INTERVAL {within}"), F.col(ts) + F.expr(f"INTERVAL {within}"))
    for c in by:
        cond = (F.col(c) == F.col(f"__r_{c}")) & cond
    return left.join(right, cond).drop(*[f"__r_{c}" for c in by])


def nearest_pair(pairs: DataFrame, key: Sequence[str], ts: str, other_ts: str, value: Sequence[str], tie: str) -> DataFrame:
    """Of the pairs of each request keep the closest (then the earlier, then the smaller ``tie``)."""
    gap = F.abs(F.unix_micros(F.col(ts)) - F.unix_micros(F.col(other_ts)))
    return pairs.groupBy(*key).agg(F.min_by(F.struct(other_ts, *value), F.struct(gap, F.col(other_ts), F.col(tie))).alias("__b")).select(*key, "__b.*")


SHARDS = 64  # groups of keys that are matched at once; fixed, as a restarted stream must find its state


def nearest_stream(requests: DataFrame, telemetry: DataFrame, by: Sequence[str], ts: str, other_ts: str, value: Sequence[str], *, within_us: int,
                   late: str, request: Sequence[str], tie: str, width_us: int | None = None, unmatched: bool = False) -> DataFrame:
    """For each request the nearest telemetry row of its key at most ``within_us`` away (then the earlier one, then the smaller ``tie``): ``by, request, us, other_us, value``.

    Both sides meet per (shard of the keys, time bucket), as a group of its own for each of very many keys costs more than its few rows; telemetry is
    copied to the buckets it may serve. A bucket is held until the watermark is past its end by
    ``within_us``, when nothing that could be nearer can still come in time; then its requests are matched at once and its state is dropped. The watermark
    is that of the slower side. ``unmatched`` gives requests without telemetry too.
    """
    width = width_us or max(8 * within_us, 1)
    tag = [*request, *value, tie]
    left_kinds, right_kinds = dict(requests.dtypes), dict(telemetry.dtypes)
    kinds = {**{c: left_kinds[c] for c in request}, **{c: right_kinds[c] for c in (*value, tie)}}

    def side(df: DataFrame, t: str, own: Sequence[str], buckets: Column, is_request: bool) -> DataFrame:
        us = F.unix_micros(t)
        # Keys travel as text that is never missing: beside a missing key pandas would hold whole numbers as floats.
        return df.withWatermark(t, late).filter(F.col(t).isNotNull()).select(
            F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in by]), F.lit(SHARDS)).alias("shard"), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"k_{c}") for c in by],
            F.col(t).alias("__ts"), us.alias("us"), F.lit(is_request).alias("asks"), F.explode(buckets).alias("bucket"),
            *[(F.col(c) if c in own else F.lit(None)).cast(kinds[c]).alias(f"v_{c}") for c in dict.fromkeys(tag)])

    at, other = F.unix_micros(ts), F.unix_micros(other_ts)
    both = side(requests, ts, request, F.array(F.floor(at / width)), True).unionByName(
        side(telemetry, other_ts, [*value, tie], F.sequence(F.floor((other - within_us) / width), F.floor((other + within_us) / width)), False))
    held = T.StructType([T.StructField("us", T.LongType()), *[both.schema[f"k_{c}"] for c in by], *[both.schema[f"v_{c}"] for c in dict.fromkeys(tag)]])
    out = T.StructType([*[T.StructField(c, T.StringType()) for c in by], *[T.StructField(c, both.schema[f"v_{c}"].dataType) for c in request], T.StructField("us", T.LongType()),
                        T.StructField("other_us", T.LongType()), *[T.StructField(c, both.schema[f"v_{c}"].dataType) for c in value]])
    _stateful(both.sparkSession)
    found = both.groupBy("shard", "bucket").transformWithStateInPandas(
        NearestInBucket(held, out, list(by), list(request), list(value), tie, within_us, width, unmatched), out, "Append", "EventTime")
    return found.select(*[F.when(F.col(c) != "", F.substring(F.col(c), F.lit(2), F.length(c))).cast(left_kinds[c]).alias(c) if c in by else F.col(c) for c in out.names])


def split_late(stream: DataFrame, ts: str, arrival: str, folder: str, *, allowed_s: float, strict_s: float = 5, caution_s: float = 30) -> tuple[DataFrame, DataFrame]:
    """Sample age class of every record; records older than allowed on arrival go to a side table.

    Each batch writes its own part of both tables, so a repeated batch replaces what it wrote.
    """
    spark = stream.sparkSession
    age = (F.unix_micros(arrival) - F.unix_micros(ts)) / 1e6
    rows = stream.withColumn("age_s", age).withColumn("age_class", freshness(F.col("age_s"), strict_s, caution_s))

    def write(batch: DataFrame, batch_id: int):
        late = F.coalesce(F.col("age_s") > allowed_s, F.lit(False))
        batch.filter(~late).write.mode("overwrite").parquet(f"{folder}/on_time/batch={batch_id}")
        batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = rows.schema
    return tuple(spark.read.schema(schema).parquet(f"{folder}/{n}") for n in ("on_time", "late"))


def abort_monitor(stream: DataFrame, ts: str, by: Sequence[str], dropped: Column, timeout: Column, failed: Column, temperature: str, *, width: str, late: str,
                  limit: float = 0.2, max_temperature: float | None = None) -> DataFrame:
    """Safety rules per window: drop, timeout and error bursts and the temperature limit."""
    share = lambda c: n_if(c) / F.count(F.lit(1))
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("__w"), *by).agg(
        share(dropped).alias("drop_rate"), share(timeout).alias("timeout_rate"), share(failed).alias("error_rate"), F.max(temperature).alias("temperature_max"))
    rules = {"client_max_inflight_saturation": F.col("drop_rate") > limit, "timeout_burst": F.col("timeout_rate") > limit, "error_burst": F.col("error_rate") > limit}
    if max_temperature is not None:
        rules["gpu_temperature_over_operator_limit"] = F.col("temperature_max") > max_temperature
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ",")
    return out.select(F.col("__w.start").alias("window_start"), *by, "drop_rate", "timeout_rate", "error_rate", "temperature_max", reasons.alias("reasons")) \
        .withColumn("abort", F.col("reasons") != "")


def snapshot_and_log(stream: DataFrame, key: Sequence[str], order: Sequence[str], folder: str, *, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Append every sample to a log and keep the latest sample of each key.

    Keys are dealt to ``buckets`` sets of files by hash. A batch reads and writes only the buckets its keys fall in, as a new version; a manifest per batch (one row a bucket)
    says which version of each bucket holds. Nothing is changed in place, so a repeated batch gives the same files and a lost executor loses nothing, and a reader
    of one manifest sees one state throughout. Versions that neither this manifest nor the one before names are deleted.
    """
    spark = stream.sparkSession
    schema = stream.schema
    rest = [c for c in schema.names if c not in key]
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def held(manifest: Mapping[int, int], which) -> DataFrame | None:
        paths = [f"{folder}/snapshot/version={manifest[b]}/bucket={b}" for b in sorted(which) if b in manifest]
        return spark.read.schema(schema).parquet(*paths) if paths else None

    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
        rows = spark.read.schema(schema).parquet(f"{folder}/log/batch={batch_id}")
        before = read_manifest(spark, folder, batch_id - 1)
        touched = [r[0] for r in rows.select(bucket.alias("b")).distinct().collect()]  # ``buckets`` numbers at most
        if touched:
            old = held(before, touched)
            rows = rows if old is None else rows.unionByName(old)
            latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b")).select(*key, "__b.*").select(*schema.names)
            latest.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/snapshot/version={batch_id}")
        after = before | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(after.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch_id}")
        for b, version in read_manifest(spark, folder, batch_id - 2).items():
            if version not in (before.get(b), after[b]):
                delete_folder(spark, f"{folder}/snapshot/version={version}/bucket={b}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.schema("bucket int, version bigint, batch bigint").parquet(f"{folder}/manifest").agg(F.max("batch")).first()[0] if path_exists(spark, f"{folder}/manifest") else None
    manifest = {} if last is None else read_manifest(spark, folder, last)
    snapshot = held(manifest, manifest)
    empty = spark.createDataFrame([], schema)
    log = spark.read.schema(schema).parquet(f"{folder}/log").select(*schema.names) if path_exists(spark, f"{folder}/log") else empty
    return log, empty if snapshot is None else snapshot


def read_manifest(spark: SparkSession, folder: str, batch: int) -> dict[int, int]:
    """Bucket to version after a batch; empty where there is none."""
    path = f"{folder}/manifest/batch={batch}"
    if batch < 0 or not path_exists(spark, path):
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").parquet(path).collect()}


def without_repeats(stream: DataFrame, ts: str, key: Sequence[str], *, late: str) -> DataFrame:
    """Samples read again within the watermark are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))
