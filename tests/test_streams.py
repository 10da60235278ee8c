"""Streams that arrive in several batches give what one batch gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import sequence as Q
from pulsegrid.streaming import streams as J

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Events in time order over four files with rising names."""
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(EVENTS).select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                                             F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("latency_ms"),
                                             (F.col("event_type") == "error").alias("bad"))
    cuts = rows.approxQuantile("us", [0.25, 0.5, 0.75], 0.0)
    for i, (a, z) in enumerate(zip([0, *cuts], [*cuts, 2**62])):
        rows.filter((F.col("us") >= a) & (F.col("us") < z)).coalesce(1).write.parquet(f"{folder}/src/part={i}")
    return rows, f"{folder}/src/"


def stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


HOUR = 3600 * 10 ** 6


def passed(rows, late_us):
    """What the last watermark has passed."""
    return rows.filter(F.col("us") <= (rows.agg(F.max("us")).first()[0] // 1000) * 1000 - late_us)


def same(got, want):
    got, want = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert got and got == want


@pytest.fixture(scope="module")
def shuffled(spark, parts, tmp_path_factory):
    """The same events, each within a day of its place: the files overlap in time."""
    rows, _ = parts
    folder = tmp_path_factory.mktemp("shuffled")
    moved = F.col("us") + F.pmod(F.xxhash64("event_id"), F.lit(20 * HOUR))
    for i, (a, z) in enumerate([(0, 0.3), (0.3, 0.6), (0.6, 1.1)]):
        lo, hi = rows.select(F.min("us"), F.max("us")).first()
        span = hi - lo + 20 * HOUR
        rows.filter((moved >= lo + a * span) & (moved < lo + z * span)).coalesce(1).write.parquet(f"{folder}/src/part={i}")
    return rows, f"{folder}/src/"


def test_streaks_of_samples_that_come_late(spark, shuffled):
    rows, path = shuffled
    got = J.run(J.failure_streak_stream(stream(spark, path), "run_id", "ts", ["event_id"], "bad", [], late="24 hours"))
    want = Q.failure_streaks(rows, ["run_id"], ["us", "event_id"], "bad", "streak", width=10**12)
    same(got.select("run_id", "event_id", "streak"), passed(want, 24 * HOUR).select("run_id", "event_id", "streak"))


def test_late_alerts_give_what_a_batch_gives(spark, shuffled):
    rows, path = shuffled
    got = J.run(J.debounce_stream(stream(spark, path).filter("latency_ms > 20"), "run_id", "ts", 24 * HOUR, ["event_id"], late="24 hours"))
    alerts = passed(rows.filter("latency_ms > 20"), 24 * HOUR)
    want = Q.debounce(alerts.withColumn("f", F.lit(True)), ["run_id"], "us", "f", 24 * HOUR, width=72 * HOUR)
    same(got.select("run_id", "us"), want.select("run_id", "us"))


def test_rows_later_than_allowed_are_dropped(spark, tmp_path):
    for i, d in enumerate([(1, 2, 5), (9,), (3, 10), (12,)]):  # day 3 comes when a batch with day 9 has passed
        spark.createDataFrame([(1, x) for x in d], "k long, d long").select("k", "d", F.timestamp_micros(F.col("d") * 24 * HOUR).alias("ts"), F.lit(True).alias("bad")) \
            .coalesce(1).write.parquet(f"{tmp_path}/src/part={i}")
    got = J.run(J.failure_streak_stream(stream(spark, f"{tmp_path}/src/"), "k", "ts", ["d"], "bad", [], late="1 day"))
    assert sorted(map(tuple, got.select("d", "streak").collect())) == [(1, 1), (2, 2), (5, 3), (9, 4), (10, 5)]


def test_nearest_in_the_stream_is_the_nearest_in_a_batch(spark, shuffled):
    rows, path = shuffled
    within, width = 6 * HOUR, 50 * HOUR
    req = stream(spark, path).filter("bad").select("run_id", "event_id", "ts")
    tel = stream(spark, path).filter("not bad").select("run_id", F.col("ts").alias("tel_ts"), "latency_ms", F.col("event_id").alias("tel_id"))
    got = J.run(J.nearest_stream(req, tel, ["run_id"], "ts", "tel_ts", ["latency_ms"], within_us=within, late="24 hours", request=["event_id"], tie="tel_id", width_us=width, unmatched=True))
    ends = [r[0] for r in rows.groupBy("bad").agg(F.max("us")).select("max(us)").collect()]
    mark = min(ends) // 1000 * 1000 - 24 * HOUR
    asked = rows.filter("bad").filter((F.floor(F.col("us") / width) + 1) * width + within <= mark).select("run_id", "event_id", "us")
    other = rows.filter("not bad").select("run_id", F.col("us").alias("other_us"), F.col("latency_ms").alias("v"), F.col("event_id").alias("tel_id"))
    pairs = asked.join(other, "run_id").filter(F.abs(F.col("us") - F.col("other_us")) <= within)
    best = pairs.groupBy("event_id").agg(F.min_by(F.struct("other_us", "v"), F.struct(F.abs(F.col("us") - F.col("other_us")), "other_us", "tel_id")).alias("b"))
    want = asked.join(best, "event_id", "left").select("event_id", F.coalesce("b.other_us", F.lit(-1)), F.coalesce("b.v", F.lit(-1.0)))
    same(got.select("event_id", F.coalesce("other_us", F.lit(-1)), F.coalesce("latency_ms", F.lit(-1.0))), want)


def test_snapshot_across_batches(spark, parts, tmp_path):
    rows, path = parts
    s = lambda: stream(spark, path).select("run_id", "us", "event_id")
    log, snapshot = J.snapshot_and_log(s(), ["run_id"], ["us", "event_id"], str(tmp_path), buckets=8)
    want = rows.groupBy("run_id").agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))
    assert log.count() == rows.count()
    same(snapshot.select("run_id", "event_id"), want)
    log, snapshot = J.snapshot_and_log(s(), ["run_id"], ["us", "event_id"], str(tmp_path), buckets=8)  # nothing new: the same again
    same(snapshot.select("run_id", "event_id"), want)


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    for i, keys in enumerate([range(40), [3], [3], [5]]):
        spark.createDataFrame([(k, i) for k in keys], "k long, v long").coalesce(1).write.parquet(f"{tmp_path}/src/part={i}")
    _, snapshot = J.snapshot_and_log(stream(spark, f"{tmp_path}/src/").select("k", "v"), ["k"], ["v"], f"{tmp_path}/out", buckets=8)
    assert {r["k"]: r["v"] for r in snapshot.collect()} == {k: {3: 2, 5: 3}.get(k, 0) for k in range(40)}
    versions = [J.read_manifest(spark, f"{tmp_path}/out", b) for b in range(4)]
    assert [sum(v == b for v in m.values()) for b, m in enumerate(versions)] == [8, 1, 1, 1]
    left = {p.name for p in (tmp_path / "out/snapshot/version=1").glob("bucket=*")}
    assert not left  # replaced by version 2, and no manifest but an older one names it


def test_windows_across_batches(spark, parts):
    rows, path = parts
    got = J.run(J.tumbling_summary(stream(spark, path), "ts", [], ~F.col("bad"), "latency_ms", width="6 hours", late="1 day"))
    want = {r[0]: r[1] for r in rows.groupBy(F.window("ts", "6 hours")["start"].alias("w")).count().collect()}
    seen = {r["window_start"]: r["requests"] for r in got.collect()}
    assert seen and all(want[w] == n for w, n in seen.items())
