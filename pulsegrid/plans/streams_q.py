"""Streaming queries: the event file is read as a stream and drained into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsegrid.operators.keys import scratch_folder
from pulsegrid.streaming import streams as J

from .registry import query, rounded
from .views import REQ


def live(t, name="events"):
    s = J.read_stream(t.spark, f"{t.path}/events.parquet")
    return s.select("event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("latency_ms"),
                    (F.col("event_type") != "error").alias("ok"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def folder(t) -> str:
    return f"{scratch_folder(t.spark)}/{uuid.uuid4().hex}"


def plain(df):
    """Zone-less timestamps, rounded doubles."""
    return rounded(df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if k == "timestamp" else F.col(c) for c, k in df.dtypes]))


_MARK = "wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS wm FROM events)"


@query("j01_tumbling_summary", sql=f"""WITH {REQ}, {_MARK}, g AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS requests, count(*) FILTER (ok) AS successes,
 round(avg(latency_ms) FILTER (ok), 6) AS latency_mean, max(latency_ms) FILTER (ok) AS latency_max FROM req GROUP BY 1, 2) SELECT g.* FROM g, wm WHERE window_end <= wm""")
def _(t):
    return plain(J.run(J.tumbling_summary(live(t), "ts", [], F.col("ok"), "latency_ms", width="1 hour", late="1 hour")))


@query("j02_trailing_throughput", sql=f"""WITH {REQ}, {_MARK}, x AS (SELECT *, date_trunc('hour', ts) - unnest(range(0, 5)) * INTERVAL 1 HOUR AS window_start FROM req), g AS (SELECT window_start, window_start + INTERVAL 5 HOUR AS window_end, count(*) AS requests,
 count(*) FILTER (ok) AS successes, round(avg(latency_ms) FILTER (ok), 6) AS latency_mean, max(latency_ms) FILTER (ok) AS latency_max, round(count(*) / 18000, 6) AS rps FROM x GROUP BY 1, 2) SELECT g.* FROM g, wm WHERE window_end <= wm""")
def _(t):
    return plain(J.run(J.trailing_throughput(live(t), "ts", [], F.col("ok"), "latency_ms", span="5 hours", step="1 hour", late="1 hour", seconds=18000)))


@query("j03_outage_sessions", sql=f"""WITH {REQ}, wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS wm FROM req WHERE NOT ok), f AS (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts) AS p FROM req WHERE NOT ok),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts) AS s FROM f), g AS (SELECT run_id, count(*) AS failures, min(ts) AS first_failure, max(ts) AS last_failure FROM i GROUP BY run_id, s)
SELECT g.* FROM g, wm WHERE last_failure + INTERVAL 12 HOUR <= wm""")
def _(t):
    return plain(J.run(J.outage_sessions(live(t), "ts", ["run_id"], ~F.col("ok"), gap="12 hours", late="1 hour")))


@query("j04_confirmed_state", sql=f"""WITH {REQ}, {_MARK}, s AS (SELECT *, row_number() OVER w AS rn FROM req WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id)), x AS (SELECT *, CASE WHEN NOT ok AND k < 5 THEN 'node_not_ready' WHEN NOT ok THEN 'sentinel_unreachable' WHEN latency_ms > 100 THEN 'compute_latency_high' ELSE '' END AS sr FROM s),
y AS (SELECT *, rn - coalesce(max(rn) FILTER (sr <> 'sentinel_unreachable') OVER (PARTITION BY run_id ORDER BY us, event_id), 0) AS streak FROM x)
SELECT run_id, us, event_id, streak, CASE WHEN sr = 'node_not_ready' OR (sr = 'sentinel_unreachable' AND streak >= 2) THEN 'DOWN' WHEN sr <> '' THEN 'DEGRADED' ELSE 'UP' END AS state,
 CASE WHEN sr = 'sentinel_unreachable' AND streak >= 2 THEN 'sentinel_confirmed_outage' ELSE sr END AS reason, sr = 'sentinel_unreachable' AND streak < 2 AS transient FROM y, wm WHERE ts <= wm""")
def _(t):
    bad = ~F.col("ok")
    sr = F.when(bad & (F.col("k") < 5), "node_not_ready").when(bad, "sentinel_unreachable").when(F.col("latency_ms") > 100, "compute_latency_high").otherwise("")
    s = live(t).withColumn("sr", sr).withColumn("ss", F.when(sr == "node_not_ready", "DOWN").when(sr != "", "DEGRADED").otherwise("UP"))
    return J.run(J.confirmed_state(s, "run_id", "ts", ["event_id"], "ss", "sr", confirm=2, late="1 hour"))


@query("j05_debounced_alerts", sql="WITH RECURSIVE " + REQ + """, wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS wm FROM req WHERE latency_ms > 20), al AS (SELECT run_id, us, event_id, row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) AS i FROM req, wm WHERE latency_ms > 20 AND ts <= wm),
db AS (SELECT run_id, i, us, event_id, us AS kept, TRUE AS keep FROM al WHERE i = 1 UNION ALL SELECT a.run_id, a.i, a.us, a.event_id, CASE WHEN a.us - d.kept >= 86400000000 THEN a.us ELSE d.kept END, a.us - d.kept >= 86400000000 FROM db d JOIN al a ON a.run_id = d.run_id AND a.i = d.i + 1)
SELECT run_id, us, event_id FROM db WHERE keep""")
def _(t):
    return J.run(J.debounce_stream(live(t).filter("latency_ms > 20"), "run_id", "ts", 86400000000, ["event_id"], late="1 hour"))


@query("j06_stream_enrichment", sql="SELECT event_id, user_id AS run_id, coalesce(c_mktsegment, 'unknown') AS c_mktsegment FROM events LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) ON c_custkey = user_id")
def _(t):
    inv = t.customer.filter("c_acctbal > 2000").select(F.col("c_custkey").alias("run_id"), "c_mktsegment")
    return J.run(J.enrich_stream(live(t).select("event_id", "run_id"), inv, ["run_id"], {"c_mktsegment": "unknown"}))


_TOL, _WIDE = 12 * 3600 * 10**6, 4 * 86400 * 10**6  # twelve hours to either side, met in buckets of four days


@query("j07_nearest_telemetry", sql=f"""WITH {REQ}, wm AS (SELECT epoch_us(least(date_trunc('millisecond', max(ts) FILTER (event_type = 'error')), date_trunc('millisecond', max(ts) FILTER (event_type = 'view'))) - INTERVAL 1 DAY) AS wm FROM req),
a AS (SELECT req.* FROM req, wm WHERE event_type = 'error' AND (us // {_WIDE} + 1) * {_WIDE} + {_TOL} <= wm), b AS (SELECT run_id, us AS tel_us, k AS temp, event_id AS tel_id FROM req WHERE event_type = 'view'),
p AS (SELECT a.run_id, a.event_id, us, tel_us, temp, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(us - tel_us), tel_us, tel_id) AS o FROM a LEFT JOIN b ON a.run_id = b.run_id AND tel_us BETWEEN us - {_TOL} AND us + {_TOL})
SELECT run_id, event_id, us, tel_us AS other_us, temp FROM p WHERE o = 1""")
def _(t):
    req = live(t).filter("event_type = 'error'").select("run_id", "event_id", "ts")
    tel = live(t).filter("event_type = 'view'").select("run_id", F.col("ts").alias("tel_ts"), F.col("k").alias("temp"), F.col("event_id").alias("tel_id"))
    return J.run(J.nearest_stream(req, tel, ["run_id"], "ts", "tel_ts", ["temp"], within_us=_TOL, late="1 day", request=["event_id"], tie="tel_id", width_us=_WIDE, unmatched=True))


@query("j07_request_telemetry_join", sql=f"""WITH {REQ}, a AS (SELECT * FROM req WHERE event_type = 'error'), b AS (SELECT run_id, ts AS tel_ts, k AS temp, event_id AS tel_id FROM req WHERE event_type = 'view'),
p AS (SELECT a.event_id, tel_ts, temp, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(tel_ts)), tel_ts, tel_id) AS o FROM a JOIN b ON a.run_id = b.run_id AND tel_ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts + INTERVAL 12 HOUR)
SELECT event_id, tel_ts, temp FROM p WHERE o = 1""")
def _(t):
    req = live(t).filter("event_type = 'error'").select("run_id", "event_id", "ts")
    tel = live(t).filter("event_type = 'view'").select("run_id", F.col("ts").alias("tel_ts"), F.col("k").alias("temp"), F.col("event_id").alias("tel_id"))
    pairs = J.run(J.near_stream(req, tel, ["run_id"], "ts", "tel_ts", within="12 HOURS", late="1 day"))
    return plain(J.nearest_pair(pairs, ["event_id"], "ts", "tel_ts", ["temp"], "tel_id"))


@query("j08_late_accounting", sql="""SELECT CASE WHEN value <= 5 THEN 'ok_for_10_30s_warning' WHEN value <= 30 THEN 'caution_for_10_30s_warning' ELSE 'not_primary_for_10_30s_warning' END AS age_class, value > 60 AS late, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    s = live(t).select("event_id", "ts", F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("latency_ms") * 1000000).cast("bigint")).alias("arrived"))
    good, late = J.split_late(s, "ts", "arrived", folder(t), allowed_s=60)
    return good.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True))).groupBy("age_class", "late").agg(F.count(F.lit(1)).alias("n"))


@query("j09_abort_monitor", sql=f"""WITH {REQ}, {_MARK}, g AS (SELECT date_trunc('hour', ts) AS window_start, round(count(*) FILTER (k >= 85) / count(*), 6) AS drop_rate, round(count(*) FILTER (NOT ok AND k < 50) / count(*), 6) AS timeout_rate, round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, max(k) AS temperature_max FROM req GROUP BY 1)
SELECT g.*, concat_ws(',', CASE WHEN drop_rate > 0.2 THEN 'client_max_inflight_saturation' END, CASE WHEN timeout_rate > 0.2 THEN 'timeout_burst' END, CASE WHEN error_rate > 0.2 THEN 'error_burst' END, CASE WHEN temperature_max > 97 THEN 'gpu_temperature_over_operator_limit' END) AS reasons,
 drop_rate > 0.2 OR timeout_rate > 0.2 OR error_rate > 0.2 OR temperature_max > 97 AS abort FROM g, wm WHERE window_start + INTERVAL 1 HOUR <= wm""")
def _(t):
    bad = ~F.col("ok")
    return plain(J.run(J.abort_monitor(live(t), "ts", [], F.col("k") >= 85, bad & (F.col("k") < 50), bad, "k", width="1 hour", late="1 hour", max_temperature=97)))


@query("j10_latest_snapshot", sql="SELECT user_id AS run_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS latency_ms FROM events GROUP BY 1")
def _(t):
    s = live(t).select("run_id", "ts", "event_id", "latency_ms")
    return plain(J.snapshot_and_log(s, ["run_id"], ["ts", "event_id"], folder(t))[1])


@query("j11_without_repeats", sql="SELECT event_id, user_id AS run_id FROM events")
def _(t):
    s = live(t)
    return J.run(J.without_repeats(s.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2)))), "ts", ["event_id"], late="1 hour").select("event_id", "run_id"))
