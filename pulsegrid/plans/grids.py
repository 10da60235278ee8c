"""Grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.times import HOUR, trunc_ntz
from pulsegrid.operators import grid

from .registry import query, rounded
from .views import OPEN, REQ, openloop, requests

_Q = "round(quantile_cont({c}, {q}){f}, 6)"


@query("e01_service_grid", sql=f"""WITH {REQ}
SELECT run_id, date_trunc('hour', ts) AS bucket, count(*) AS request_rows, count(*) FILTER (ok) AS success_rows,
 count(*) FILTER (NOT ok) AS failure_rows, count(*) FILTER (NOT ok AND k < 30) AS timeout_rows,
 min_by(event_type, event_id) AS first_type,
 round(quantile_cont(latency_ms, 0.5) FILTER (ok), 6) AS latency_ms_med,
 round(quantile_cont(latency_ms, 0.95) FILTER (ok), 6) AS latency_ms_p95,
 round(quantile_cont(k, 0.5), 6) AS k_med,
 round(count(*) FILTER (ok) / count(*), 6) AS success_rate, round(count(*) FILTER (NOT ok) / count(*), 6) AS fail_rate,
 round(count(*) FILTER (NOT ok AND k < 30) / count(*), 6) AS timeout_rate
FROM req GROUP BY 1, 2""")
def _(t):
    return rounded(grid.service_grid(
        requests(t), "ts", ["run_id"], trunc_ntz("hour", "ts"), F.col("ok"), ~F.col("ok") & (F.col("k") < 30),
        {"latency_ms": "latency_ms"}, carry_median={"k_med": "k"}, carry_first={"first_type": "event_type"},
        order=["event_id"]))


@query("e01_service_grid_fleet", sql=f"""WITH {REQ}
SELECT date_trunc('hour', ts) AS bucket, count(*) AS request_rows, count(*) FILTER (ok) AS success_rows,
 count(*) FILTER (NOT ok) AS failure_rows, count(*) FILTER (NOT ok AND k < 30) AS timeout_rows,
 round(quantile_cont(latency_ms, 0.5) FILTER (ok), 6) AS latency_ms_med,
 round(quantile_cont(latency_ms, 0.95) FILTER (ok), 6) AS latency_ms_p95,
 round(count(*) FILTER (ok) / count(*), 6) AS success_rate, round(count(*) FILTER (NOT ok) / count(*), 6) AS fail_rate,
 round(count(*) FILTER (NOT ok AND k < 30) / count(*), 6) AS timeout_rate
FROM req GROUP BY 1""")
def _(t):
    return rounded(grid.service_grid(
        requests(t), "ts", [], trunc_ntz("hour", "ts"), F.col("ok"), ~F.col("ok") & (F.col("k") < 30),
        {"latency_ms": "latency_ms"}))


_ARRIVAL = """count(*) AS scheduled_request_count, count(*) FILTER (NOT dropped) AS launched_request_count,
 count(*) FILTER (dropped) AS dropped_max_inflight_count, count(*) FILTER (completed) AS completed_count,
 count(*) FILTER (completed AND success) AS successful_count, max(inflight) AS inflight_max,
 count(*) FILTER (dropped OR schedule_delay_ms > 1000) AS schedule_misses,
 count(*) FILTER (NOT success) AS failed, count(*) FILTER (error_type = 'timeout') AS timeouts,
 quantile_cont(latency_ms, 0.5) FILTER (completed AND success) AS p50,
 quantile_cont(latency_ms, 0.95) FILTER (completed AND success) AS p95,
 quantile_cont(latency_ms, 0.99) FILTER (completed AND success) AS p99"""


@query("e02_arrival_bins", sql=f"""WITH {OPEN}, g AS (
 SELECT run_id, CAST(floor(scheduled_s / 6) AS BIGINT) AS bin, {_ARRIVAL.replace('1000', '6000')} FROM ol GROUP BY 1, 2),
d AS (SELECT run_id, CAST(ceil(max(scheduled_s) / 6) AS BIGINT) AS n FROM ol GROUP BY 1),
b AS (SELECT run_id, unnest(range(0, n)) AS bin FROM d)
SELECT b.run_id, b.bin * 6 AS elapsed_s, round(coalesce(scheduled_request_count, 0) / 6.0, 6) AS offered_rps,
 coalesce(scheduled_request_count, 0) AS scheduled_request_count,
 coalesce(launched_request_count, 0) AS launched_request_count,
 coalesce(dropped_max_inflight_count, 0) AS dropped_max_inflight_count,
 coalesce(completed_count, 0) AS completed_count, coalesce(successful_count, 0) AS successful_count,
 coalesce(inflight_max, 0) AS inflight_max, coalesce(schedule_misses, 0) AS schedule_misses,
 round(p50, 6) AS latency_p50, round(p95, 6) AS latency_p95, round(p99, 6) AS latency_p99,
 round(CASE WHEN launched_request_count > 0 THEN completed_count / launched_request_count ELSE 0 END, 6) AS completion_fraction,
 round(CASE WHEN completed_count > 0 THEN successful_count / completed_count ELSE 0 END, 6) AS success_fraction,
 round(coalesce(failed / scheduled_request_count, 0), 6) AS fail_rate,
 round(coalesce(timeouts / scheduled_request_count, 0), 6) AS timeout_rate
FROM b LEFT JOIN g USING (run_id, bin)""")
def _(t):
    ol = openloop(t)
    spans = ol.groupBy("run_id").agg(F.max("scheduled_s").alias("duration_s"))
    out = rounded(grid.arrival_bins(ol, ["run_id"], bucket_s=6, duration=spans))
    return out


@query("e03_completion_bins", sql=f"""WITH {OPEN}
SELECT run_id, CAST(floor(complete_s / 6) AS BIGINT) * 6 AS elapsed_s, round(count(*) / 6.0, 6) AS realized_completed_rps,
 count(*) AS completed_request_count, count(*) FILTER (success) AS successful_count,
 count(*) FILTER (NOT success) AS failed_count, count(*) FILTER (error_type = 'timeout') AS timeout_count,
 round(quantile_cont(latency_ms, 0.5) FILTER (success), 6) AS latency_p50,
 round(quantile_cont(latency_ms, 0.95) FILTER (success), 6) AS latency_p95,
 round(quantile_cont(latency_ms, 0.99) FILTER (success), 6) AS latency_p99,
 round(count(*) FILTER (success) / count(*), 6) AS success_fraction,
 round(count(*) FILTER (error_type = 'timeout') / count(*), 6) AS timeout_fraction
FROM ol WHERE complete_s IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return rounded(grid.completion_bins(openloop(t), ["run_id"], bucket_s=6))


@query("e04_resample", sql=f"""WITH {REQ}, g AS (
 SELECT run_id, us // 3600000000 * 3600000000 AS bucket, count(*) AS n, avg(CAST(ok AS DOUBLE)) AS sm,
 avg(latency_ms) FILTER (ok) AS m, max(latency_ms) FILTER (ok) AS mx, quantile_cont(latency_ms, .5) FILTER (ok) AS p50,
 quantile_cont(latency_ms, .95) FILTER (ok) AS p95, quantile_cont(latency_ms, .99) FILTER (ok) AS p99
 FROM req GROUP BY 1, 2),
b AS (SELECT run_id, unnest(range(min(bucket), max(bucket) + 1, 3600000000)) AS bucket FROM g GROUP BY 1)
SELECT b.run_id, b.bucket, coalesce(n, 0) AS request_count, round(sm, 6) AS success_mean, round(m, 6) AS latency_mean,
 mx AS latency_max, round(p50, 6) AS latency_p50, round(p95, 6) AS latency_p95, round(p99, 6) AS latency_p99
FROM b LEFT JOIN g USING (run_id, bucket)""")
def _(t):
    return rounded(grid.resampled(requests(t), ["run_id"], "us", HOUR, F.col("ok"), "latency_ms"))


@query("f14_trailing_quantiles", sql=f"""WITH {OPEN}, x AS (
 SELECT run_id, CAST(floor(complete_s) AS BIGINT) AS s, latency_ms FROM ol WHERE complete_s IS NOT NULL AND success),
b AS (SELECT run_id, unnest(range(0, max(s) + 1)) AS elapsed_s FROM x GROUP BY 1),
w AS (SELECT run_id, s + unnest(range(0, 10)) AS elapsed_s, latency_ms FROM x),
g AS (SELECT run_id, elapsed_s, count(*) AS n, avg(latency_ms) AS m, quantile_cont(latency_ms, .5) AS p50,
 quantile_cont(latency_ms, .95) AS p95, quantile_cont(latency_ms, .99) AS p99 FROM w GROUP BY 1, 2)
SELECT b.run_id, b.elapsed_s, coalesce(n, 0) AS completion_count, coalesce(n, 0) >= 2 AS sample_sufficient,
 CASE WHEN n >= 2 THEN 'ok' ELSE 'insufficient_completion_count<2' END AS quality_status,
 round(CASE WHEN n >= 2 THEN p50 END, 6) AS rolling_latency_p50, round(CASE WHEN n >= 2 THEN m END, 6) AS rolling_latency_mean,
 round(CASE WHEN n >= 2 THEN p95 END, 6) AS rolling_latency_p95, round(CASE WHEN n >= 2 THEN p99 END, 6) AS rolling_latency_p99
FROM b LEFT JOIN g USING (run_id, elapsed_s)""")
def _(t):
    done = openloop(t).filter(F.col("success") & F.col("complete_s").isNotNull())
    return rounded(grid.trailing_quantiles(done, ["run_id"], "complete_s", "latency_ms", 10, 2))
