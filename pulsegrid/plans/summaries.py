"""Summary and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, HOUR, trunc_ntz
from pulsegrid.operators import audits as A, grid, summary as S
from pulsegrid.operators.quantiles import floored, nearest, quantiles, rounded as rounded_index, summarise

from .registry import query, rounded
from .views import OPEN, REQ, openloop, requests

def _q(c, q, f="", d=6):
    """SQL of a rounded linear quantile."""
    return f"round(quantile_cont({c}, {q}){f}, {d})"


@query("e05_phase_cycle_summary", sql=f"""WITH {REQ}
SELECT run_id % 10 AS grp, CAST(floor(us / 6.048e11) AS BIGINT) AS cycle, CASE WHEN k >= 10 THEN event_type END AS phase,
 count(*) AS rows, round(avg(CAST(k % 7 <> 0 AS DOUBLE)), 6) AS success_rate,
 round(avg(latency_ms) FILTER (k % 7 <> 0), 9) AS latency_ms_mean, max(latency_ms) FILTER (k % 7 <> 0) AS latency_ms_max,
 {_q('latency_ms', .5, ' FILTER (k % 7 <> 0)', 9)} AS latency_ms_p50, {_q('latency_ms', .95, ' FILTER (k % 7 <> 0)', 9)} AS latency_ms_p95,
 {_q('latency_ms', .99, ' FILTER (k % 7 <> 0)', 9)} AS latency_ms_p99 FROM req GROUP BY 1, 2, 3""")
def _(t):
    r = requests(t).select(
        (F.col("run_id") % 10).alias("grp"), F.floor(F.col("us") / 6.048e11).alias("cycle"),
        F.when(F.col("k") >= 10, F.col("event_type")).alias("phase"), (F.col("k") % 7 != 0).alias("success"), "latency_ms")
    return S.phase_summary(r, ["grp", "cycle", "phase"], "success", ["latency_ms"], digits=9)


@query("e06_two_level_medians", sql=f"""WITH a AS (
 SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS n, quantile_cont(l_extendedprice, .5) AS p, quantile_cont(l_quantity, .5) AS q
 FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, count(*) AS "groups", CAST(sum(n) AS BIGINT) AS rows, {_q('p', .5)} AS l_extendedprice_median,
 {_q('q', .5)} AS l_quantity_median FROM a GROUP BY 1""")
def _(t):
    return rounded(S.two_level_medians(t.lineitem, ["l_suppkey", "l_linenumber", "l_returnflag"], ["l_returnflag"],
                                       ["l_extendedprice", "l_quantity"]))


@query("e07_label_counts", sql="SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders GROUP BY 1, 2")
def _(t):
    return S.label_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("e08_series_profile", sql="WITH u AS (" + " UNION ALL ".join(
    f"SELECT l_suppkey, '{c}' AS metric, {c} AS value FROM lineitem" for c in
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + f""")
SELECT l_suppkey, metric, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
 {_q('value', .5)} AS p50, {_q('value', .95)} AS p95, {_q('value', .99)} AS p99 FROM u GROUP BY 1, 2""")
def _(t):
    return rounded(S.series_profile(t.lineitem, ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("e09_quantiles_linear", sql=f"""WITH {REQ} SELECT event_type, {_q('latency_ms', .5)} AS p50, {_q('latency_ms', .9)} AS p90,
 {_q('latency_ms', .999)} AS p999, {_q('k', .25)} AS k_p25 FROM req GROUP BY 1""")
def _(t):
    return rounded(quantiles(requests(t), ["event_type"], {
        "p50": ("latency_ms", .5), "p90": ("latency_ms", .9), "p999": ("latency_ms", .999), "k_p25": ("k", .25)}))


@query("e10_quantiles_by_rank", sql=f"""WITH {REQ}, s AS (SELECT run_id, list_sort(list(latency_ms)) AS v, count(*) AS n FROM req GROUP BY 1)
SELECT run_id, v[greatest(1, CAST(ceil(0.95 * n) AS BIGINT))] AS nearest_p95, v[greatest(1, CAST(floor(0.95 * n) AS BIGINT))] AS floored_p95,
 v[greatest(1, CAST(floor(0.5 * n) AS BIGINT))] AS floored_p50 FROM s""")
def _(t):
    return rounded(quantiles(requests(t), ["run_id"], {
        "nearest_p95": ("latency_ms", nearest(.95)), "floored_p95": ("latency_ms", floored(.95)),
        "floored_p50": ("latency_ms", floored(.5))}))


@query("e11_quantiles_rounded_index", sql=f"""WITH {REQ}, s AS (SELECT run_id, list_sort(list(latency_ms)) AS v, count(*) AS n FROM req GROUP BY 1)
SELECT run_id, round(v[1 + CAST(round_even((n - 1) * 0.5, 0) AS BIGINT)], 3) AS p50,
 round(v[1 + CAST(round_even((n - 1) * 0.95, 0) AS BIGINT)], 3) AS p95 FROM s""")
def _(t):
    return rounded(quantiles(requests(t), ["run_id"], {"p50": ("latency_ms", rounded_index(.5)),
                                                      "p95": ("latency_ms", rounded_index(.95))}), 3)


@query("e12_median_deviation", sql=f"""WITH {REQ}, m AS (SELECT run_id, quantile_cont(latency_ms, .5) AS med,
 quantile_cont(latency_ms, .75) - quantile_cont(latency_ms, .25) AS iqr FROM req GROUP BY 1),
d AS (SELECT run_id, any_value(med) AS med, any_value(iqr) AS iqr, quantile_cont(abs(latency_ms - med), .5) AS mad FROM req JOIN m USING (run_id) GROUP BY 1)
SELECT run_id, round(med, 6) AS median, round(mad, 6) AS mad, round(iqr, 6) AS iqr,
 round(CASE WHEN mad * 1.4826 > 1e-9 THEN mad * 1.4826 ELSE 1.0 END, 6) AS robust_scale FROM d""")
def _(t):
    return rounded(S.mad(requests(t), ["run_id"], "latency_ms"))


def _bins(t):
    ol = openloop(t)
    return (grid.arrival_bins(ol, ["run_id"], bucket_s=6), grid.completion_bins(ol, ["run_id"], bucket_s=6), ol)


_BINS = OPEN + """, ar AS (SELECT run_id, floor(scheduled_s / 6) AS b, count(*) AS n, count(*) FILTER (dropped) AS d, count(*) / 6.0 AS rps FROM ol GROUP BY 1, 2),
co AS (SELECT run_id, floor(complete_s / 6) AS b, count(*) AS n, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS bad,
 count(*) FILTER (error_type = 'timeout') AS tmo, count(*) / 6.0 AS rps, quantile_cont(latency_ms, .5) FILTER (success) AS p50,
 quantile_cont(latency_ms, .95) FILTER (success) AS p95, quantile_cont(latency_ms, .99) FILTER (success) AS p99
 FROM ol WHERE complete_s IS NOT NULL GROUP BY 1, 2)"""


@query("e14_calibration_summary", sql=f"""WITH {_BINS},
a AS (SELECT run_id, count(*) AS bins, CAST(sum(n) AS BIGINT) AS scheduled, sum(d) AS d, quantile_cont(rps, .5) AS rps FROM ar GROUP BY 1),
c AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ok) AS BIGINT) AS ok, sum(bad) AS bad, sum(tmo) AS tmo, quantile_cont(rps, .5) AS rps,
 quantile_cont(p50, .5) AS p50, quantile_cont(p95, .5) AS p95, quantile_cont(p99, .5) AS p99 FROM co GROUP BY 1)
SELECT a.run_id, scheduled AS raw_request_rows, bins AS arrival_bins, round(a.rps, 6) AS offered_rps_median, scheduled,
 round(d / scheduled, 6) AS drop_ratio, round(n / bins, 6) AS throughput_per_bin, round(c.rps, 6) AS completed_rps_median,
 n AS completed, ok AS successful, round(tmo / n, 6) AS timeout_rate, round(bad / n, 6) AS error_rate,
 round(p50, 6) AS latency_p50_median, round(p95, 6) AS latency_p95_median, round(p99, 6) AS latency_p99_median
FROM a JOIN c USING (run_id)""")
def _(t):
    arrival, completion, raw = _bins(t)
    return rounded(S.calibration_summary(arrival, completion, raw, ["run_id"]))


@query("e15_replicate_summary", sql=f"""WITH {REQ}, r AS (SELECT run_id, run_id % 4 AS level, avg(latency_ms) AS mean_latency, max(latency_ms) AS max_latency,
 count(*) FILTER (NOT ok) < 22 AS completed, CASE WHEN count(*) FILTER (NOT ok) >= 22 THEN 'errors' WHEN max(latency_ms) > 250 THEN 'slow' ELSE '' END AS reason
 FROM req GROUP BY 1),
u AS (SELECT level, 'mean_latency' AS metric, mean_latency AS v FROM r UNION ALL SELECT level, 'max_latency', max_latency FROM r),
f AS (SELECT level, bool_and(completed) AS ac, coalesce(string_agg(DISTINCT reason, ';' ORDER BY reason) FILTER (reason <> ''), '') AS reasons FROM r GROUP BY 1)
SELECT u.level, metric, count(v) AS runs, round(min(v), 6) AS min, round(max(v), 6) AS max, {_q('v', .5)} AS median,
 round(quantile_cont(v, .75) - quantile_cont(v, .25), 6) AS iqr, any_value(ac) AS all_completed, any_value(reasons) AS reasons
FROM u JOIN f USING (level) GROUP BY 1, 2""")
def _(t):
    bad = S.n_if(~F.col("ok"))
    runs = requests(t).groupBy("run_id").agg(
        F.avg("latency_ms").alias("mean_latency"), F.max("latency_ms").alias("max_latency"), (bad < 22).alias("completed"),
        F.when(bad >= 22, "errors").when(F.max("latency_ms") > 250, "slow").otherwise("").alias("reason")) \
        .withColumn("level", F.col("run_id") % 4)
    return rounded(S.replicate_summary(runs, "level", ["mean_latency", "max_latency"], "completed", "reason"))


@query("e16_sample_age_summary", sql=f"""WITH {REQ}, s AS (SELECT k % 20 AS query_index, run_id AS result_count, CASE WHEN ok THEN '' ELSE 'failed' END AS error,
 CASE WHEN event_type <> 'signup' THEN us END AS stamp, CASE WHEN event_type <> 'signup' THEN latency_ms / 10 END AS age, latency_ms / 100 AS dur FROM req)
SELECT query_index, min(result_count) AS result_count_min, max(result_count) AS result_count_max, count(*) FILTER (error <> '') AS error_count,
 count(*) FILTER (stamp IS NULL) AS missing_ts_count, count(age) AS observations, round(max(age), 6) AS age_max_s, round(max(dur), 6) AS duration_max_s,
 {_q('age', .5)} AS age_p50_s, {_q('age', .95)} AS age_p95_s, {_q('dur', .5)} AS duration_p50_s, {_q('dur', .95)} AS duration_p95_s,
 CASE WHEN max(age) IS NULL THEN 'missing' WHEN max(age) <= 5 THEN 'ok_for_10_30s_warning' WHEN max(age) <= 30 THEN 'caution_for_10_30s_warning' ELSE 'not_primary_for_10_30s_warning' END AS decision
FROM s GROUP BY 1""")
def _(t):
    shown = F.col("event_type") != "signup"
    s = requests(t).select(
        (F.col("k") % 20).alias("query_index"), F.col("run_id").alias("result_count"), F.when(F.col("ok"), "").otherwise("failed").alias("error"),
        F.when(shown, F.col("us")).alias("sample_ts_max"), F.when(shown, F.col("latency_ms") / 10).alias("age_s"),
        (F.col("latency_ms") / 100).alias("duration_s"))
    return rounded(S.sample_age_summary(s, ["query_index"]))


@query("e17_sample_record", sql=f"""WITH {REQ}, o AS (SELECT o_custkey, list(epoch_us(o_orderdate) / 86400e6) AS st, max(epoch_us(o_orderdate)) / 86400e6 + 1 AS fin
 FROM orders GROUP BY 1), a AS (SELECT *, list_sort(list_transform(st, lambda x: fin - x)) AS ages, list_sort(list_distinct(list_transform(st, lambda x: round(x, 6)))) AS ds FROM o)
SELECT o_custkey, len(ages) AS result_count, round(ages[1], 6) AS age_min_s, round(quantile_cont_l, 6) AS age_p50_s, round(ages[len(ages)], 6) AS age_max_s,
 len(ds) AS distinct_count, greatest(0, len(ds) - 5) AS distinct_omitted, array_to_string(list_transform(ds[1:5], lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS head
FROM (SELECT *, (ages[1 + CAST(floor((len(ages) - 1) / 2) AS BIGINT)] + ages[1 + CAST(ceil((len(ages) - 1) / 2) AS BIGINT)]) / 2 AS quantile_cont_l FROM a)""")
def _(t):
    from pulsegrid.operators.keys import join_on
    o = t.orders.select("o_custkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86400e6)).alias("stamp"))
    ends = o.groupBy("o_custkey").agg((F.max("stamp") + 1).alias("finished"))
    out = S.sample_records(join_on(o, ends, ["o_custkey"]), ["o_custkey"], "stamp", "finished", head=5)
    return rounded(out.withColumn("head", F.array_join(F.transform("distinct_head", lambda x: x.cast("bigint").cast("string")), ","))
                   .drop("distinct_head"))


@query("e18_freshness_probe", sql=f"""WITH {REQ}, g AS (SELECT *, us // 3600000000 AS stamp, latency_ms / 10 AS age FROM req),
p AS (SELECT run_id, stamp, lag(stamp) OVER (PARTITION BY run_id ORDER BY us, event_id) AS pv FROM g WHERE ok),
s AS (SELECT run_id, quantile_cont(stamp - pv, .5) FILTER (stamp <> pv) AS p50, quantile_cont(stamp - pv, .95) FILTER (stamp <> pv) AS p95 FROM p GROUP BY 1)
SELECT run_id, count(*) AS rows, count(*) FILTER (ok) AS ok_rows, round(max(age) FILTER (ok), 6) AS age_max_s, count(DISTINCT stamp) FILTER (ok) AS distinct_stamps,
 {_q('age', .5, ' FILTER (ok)')} AS age_p50_s, {_q('age', .95, ' FILTER (ok)')} AS age_p95_s, round(any_value(p50), 6) AS step_p50_s, round(any_value(p95), 6) AS step_p95_s
FROM g JOIN s USING (run_id) GROUP BY 1""")
def _(t):
    r = requests(t).withColumn("stamp", F.floor(F.col("us") / HOUR)).withColumn("age", F.col("latency_ms") / 10)
    return rounded(S.freshness_probe(r, ["run_id"], ["us", "event_id"], "ok", "age", "stamp", DAY))


def states(t):
    """Events as availability samples of a node."""
    bad = ~F.col("ok")
    state = F.when(bad & (F.col("k") < 40), "DOWN").when(bad | (F.col("latency_ms") > 100), "DEGRADED").otherwise("UP")
    reason = F.when(bad & (F.col("k") < 20), "sentinel_unreachable").when(bad & (F.col("k") < 40), "compute_check_timeout") \
        .when(bad, "compute_check_failed").when(F.col("latency_ms") > 100, "compute_latency_high").otherwise("")
    return requests(t).withColumn("state", state).withColumn("reason", reason).withColumn("sample_reason", reason) \
        .withColumn("transient", bad & (F.col("k") >= 90))


STATES = REQ + """, st AS (SELECT *, CASE WHEN NOT ok AND k < 40 THEN 'DOWN' WHEN NOT ok OR latency_ms > 100 THEN 'DEGRADED' ELSE 'UP' END AS state,
 CASE WHEN NOT ok AND k < 20 THEN 'sentinel_unreachable' WHEN NOT ok AND k < 40 THEN 'compute_check_timeout' WHEN NOT ok THEN 'compute_check_failed'
 WHEN latency_ms > 100 THEN 'compute_latency_high' ELSE '' END AS reason, NOT ok AND k >= 90 AS transient FROM req)"""


@query("e19_availability_summary", sql=f"""WITH {STATES}, p AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY run_id ORDER BY us, event_id), 'UP') AS pv FROM st),
a AS (SELECT run_id, count(*) AS n, count(*) FILTER (state = 'DOWN') AS down, count(*) FILTER (state = 'DEGRADED') AS deg, count(*) FILTER (transient) AS tr,
 count(*) FILTER (reason IN ('compute_check_failed', 'compute_check_timeout')) AS imp, count(*) FILTER (state = 'DOWN' AND pv <> 'DOWN') AS outs,
 (max(us) - min(us)) / 1e6 AS dur, count(*) FILTER (reason = 'sentinel_unreachable') AS su, count(*) FILTER (reason = 'compute_latency_high') AS cl FROM p GROUP BY 1)
SELECT run_id, n AS samples, down, deg AS degraded, tr AS transient, imp AS impaired, outs AS outage_events, round(dur, 3) AS duration_s, round(dur / 5, 3) AS expected_samples,
 round(dur / (n - 1), 6) AS effective_interval_s, down * 5.0::DOUBLE AS down_seconds, round((n - down) / n * 100.0, 6) AS availability_pct, round(deg / (n / 1000.0), 6) AS degraded_per_1000,
 round(su / (n / 1000.0), 6) AS unreachable_per_1000, round(cl / (n / 1000.0), 6) AS latency_high_per_1000, round(imp / (n / 1000.0), 6) AS compute_failed_per_1000 FROM a""")
def _(t):
    return rounded(S.availability_summary(states(t), ["run_id"], ["us", "event_id"], 5, DAY))


@query("e19_reason_counts", sql=f"""WITH {STATES}, g AS (SELECT run_id, reason, count(*) AS n FROM st WHERE reason <> '' GROUP BY 1, 2)
SELECT run_id, string_agg(reason || ':' || n, ';' ORDER BY reason || ':' || n) AS reasons FROM g GROUP BY 1""")
def _(t):
    return S.reason_counts(states(t), ["run_id"], "reason")


@query("e20_phase_counters", sql="""WITH w AS (SELECT DISTINCT o_orderpriority, unnest(['F', 'O', 'P', 'X']) AS o_orderstatus FROM orders),
g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, coalesce(n, 0) AS n FROM w LEFT JOIN g USING (o_orderpriority, o_orderstatus)""")
def _(t):
    return S.counters(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P", "X"])


@query("e20_ever_seen", sql="""SELECT o_custkey, bool_or(o_orderstatus = 'F') AS ever_f, bool_or(o_orderstatus = 'O') AS ever_o,
 bool_or(o_orderstatus = 'P') AS ever_p FROM orders GROUP BY 1""")
def _(t):
    return S.ever_seen(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


_STEPS = REQ + """, cs AS (SELECT run_id, event_type, us, k, lag(k) OVER (PARTITION BY run_id, event_type ORDER BY us, event_id) AS pv FROM req),
inc AS (SELECT run_id, event_type, us, CASE WHEN k < pv THEN k ELSE k - pv END AS increase FROM cs WHERE pv IS NOT NULL)"""


@query("e23_counter_rate", sql=f"""WITH {_STEPS} SELECT run_id, us // 86400000000 * 86400000000 AS window_start,
 round(sum(increase) / 86400.0 * 8, 6) AS rate, count(*) AS samples FROM inc GROUP BY 1, 2""")
def _(t):
    return rounded(S.counter_rate(requests(t), ["run_id", "event_type"], ["run_id"], ["us", "event_id"], "k", DAY, DAY, 1e6, 8.0))


@query("e24_smoothed_rate", sql=f"""WITH {_STEPS}, r AS (SELECT run_id, us // 86400000000 * 86400000000 AS w, sum(increase) / 86400.0 AS rate FROM inc GROUP BY 1, 2),
s AS (SELECT run_id, w + unnest(range(0, 3)) * 86400000000 AS w, rate FROM r)
SELECT r.run_id, r.w AS window_start, round(avg(s.rate), 9) AS smoothed, count(*) AS points FROM r JOIN s ON r.run_id = s.run_id AND r.w = s.w GROUP BY 1, 2""")
def _(t):
    rates = S.counter_rate(requests(t), ["run_id", "event_type"], ["run_id"], ["us", "event_id"], "k", DAY, DAY, 1e6)
    return rounded(S.smoothed_rate(rates, ["run_id"], "window_start", "rate", DAY, 3 * DAY), 9)


@query("e27_benchmark_result", sql=f"""WITH {REQ}, b AS (SELECT run_id, count(*) FILTER (ok) AS c, count(*) FILTER (NOT ok) AS f, round(greatest(max(latency_ms), 0.001), 3) AS el,
 sum(k) FILTER (ok) AS pt, sum(k * 2) FILTER (ok) AS ct, avg(latency_ms) FILTER (ok) AS ml, avg(k) FILTER (ok) AS mp, avg(k * 2) FILTER (ok) AS mc,
 list_sort(list(latency_ms) FILTER (ok)) AS v FROM req GROUP BY 1)
SELECT run_id, c AS completed, f AS failed, CASE WHEN f = 0 THEN 'succeeded' ELSE 'completed_with_errors' END AS status, el AS elapsed_s, round(c / el, 3) AS throughput_rps,
 round(pt / el, 3) AS prompt_tps, round(ct / el, 3) AS generation_tps, round((pt + ct) / el, 3) AS total_tps, round(ml, 3) AS mean_latency_s,
 round(mp, 3) AS mean_prompt_tokens, round(mc, 3) AS mean_completion_tokens, round(v[1 + CAST(round_even((c - 1) * 0.5, 0) AS BIGINT)], 3) AS latency_p50_s,
 round(v[1 + CAST(round_even((c - 1) * 0.95, 0) AS BIGINT)], 3) AS latency_p95_s FROM b""")
def _(t):
    r = requests(t).select("run_id", "ok", F.col("latency_ms").alias("el"), F.when(F.col("ok"), F.col("latency_ms")).alias("lat"),
                           F.when(F.col("ok"), F.col("k")).alias("pt"), F.when(F.col("ok"), F.col("k") * 2).alias("ct"))
    return S.benchmark_result(r, ["run_id"], "el", "ok", "lat", "pt", "ct")


@query("e28_accumulate_chunks", sql=f"""WITH {REQ}, c AS (SELECT run_id, event_type, count(*) FILTER (ok) AS c, count(*) FILTER (NOT ok) AS f, sum(k) AS ti, avg(latency_ms) AS e, max(us) / 1e12 AS el
 FROM req GROUP BY 1, 2), s AS (SELECT run_id, count(*) AS chunks, CAST(sum(c) AS BIGINT) AS completed, CAST(sum(f) AS BIGINT) AS failed, round(max(el), 3) AS el, sum(ti) AS ti,
 sum(e * c) FILTER (c > 0) AS w FROM c GROUP BY 1)
SELECT run_id, chunks, completed, failed, round(completed / el, 3) AS throughput_rps, round(ti / el, 3) AS input_tps,
 CASE WHEN completed > 0 THEN round(w / completed / 1000.0, 4) END AS mean_e2el_s FROM s""")
def _(t):
    chunks = requests(t).groupBy("run_id", "event_type").agg(
        S.n_if("ok").alias("c"), S.n_if(~F.col("ok")).alias("f"), F.sum("k").alias("ti"), F.avg("latency_ms").alias("e"),
        (F.max("us") / 1e12).alias("el"))
    return S.accumulate_chunks(chunks, ["run_id"], "c", "f", {"input": "ti"}, {"e2el": "e"}, "el")


@query("e29_progress_buckets", sql=f"""WITH {REQ}, g AS (SELECT run_id, CAST(floor((us - 1704067200000000) / 3.6e9) AS BIGINT) AS second, count(*) FILTER (ok) AS completed, CAST(sum(k) AS BIGINT) AS tokens FROM req GROUP BY 1, 2),
b AS (SELECT run_id, unnest(range(0, max(second) + 1)) AS second FROM g GROUP BY 1),
f AS (SELECT b.run_id, b.second, coalesce(completed, 0) AS completed, coalesce(tokens, 0) AS tokens FROM b LEFT JOIN g USING (run_id, second))
SELECT *, round(sum(completed) OVER w / count(*) OVER w, 3) AS current_completed, round(sum(tokens) OVER w / count(*) OVER w, 3) AS current_tokens
FROM f WINDOW w AS (PARTITION BY run_id ORDER BY second ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t):
    r = requests(t).withColumn("second", F.floor((F.col("us") - 1704067200000000) / 3.6e9).cast("bigint"))
    return S.progress_buckets(r, ["run_id"], "second", {"completed": S.n_if("ok"), "tokens": F.sum("k")}, width=300)


@query("e30_step_spread", sql="""SELECT l_suppkey, l_linenumber, count(l_tax) AS n, round(avg(l_tax), 6) AS mean,
 round(CASE WHEN count(l_tax) >= 2 THEN stddev_pop(l_tax) END, 6) AS stddev_pop FROM lineitem GROUP BY 1, 2""")
def _(t):
    return rounded(S.step_spread(t.lineitem, ["l_suppkey", "l_linenumber"], "l_tax"))


_FEAT = ("l_extendedprice", "l_discount", "l_tax")


@query("e31_feature_profile", sql="WITH u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, l_linenumber AS lv, {c} AS value FROM lineitem" for c in _FEAT) + f"""),
m AS (SELECT feature, lv, quantile_cont(value, .5) AS md FROM u GROUP BY 1, 2),
x AS (SELECT feature, string_agg(lv || ':' || printf('%.4f', md), '; ' ORDER BY lv) AS txt FROM m GROUP BY 1)
SELECT feature, count(*) AS rows, count(value) AS non_missing, count(DISTINCT value) AS unique_count, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std,
 min(value) AS min, max(value) AS max, round(corr(lv, value), 8) AS pearson_with_load, {_q('value', .5)} AS median, round(1 - count(value) / count(*), 6) AS missing_rate,
 any_value(txt) AS median_by_load FROM u JOIN x USING (feature) GROUP BY 1""")
def _(t):
    return rounded(S.feature_profile(t.lineitem, _FEAT, "l_linenumber"), 8)


@query("e32_fold_features", sql="WITH f AS (SELECT 'fold_' || h AS fold, l_suppkey, l_suppkey % 5 = h AS is_test FROM (SELECT DISTINCT l_suppkey FROM lineitem) CROSS JOIN range(5) t(h)),"
       " u AS (" + " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, {c} AS value FROM lineitem JOIN f USING (l_suppkey) WHERE NOT is_test"
                                      for c in (*_FEAT, "l_quantity")) + """)
SELECT fold, feature, count(*) AS train_rows, count(value) AS non_missing, count(DISTINCT value) AS unique_count, round(stddev_samp(value), 6) AS std, 0.0::DOUBLE AS missing_rate,
 CASE WHEN feature = 'l_tax' THEN 'forbidden_primary_feature' WHEN feature = 'l_quantity' THEN 'target_leakage_feature' ELSE 'selected' END AS decision FROM u GROUP BY 1, 2""")
def _(t):
    folds = t.lineitem.select("l_suppkey").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(4)))) \
        .select(F.concat(F.lit("fold_"), F.col("h")).alias("fold"), "l_suppkey", (F.col("l_suppkey") % 5 == F.col("h")).alias("is_test"))
    return rounded(S.fold_features(t.lineitem, folds, "l_suppkey", [*_FEAT, "l_quantity"], ["l_quantity"], ["l_tax"]))


@query("e33_sample_sufficiency", sql=f"""WITH {REQ} SELECT run_id, us // 86400000000 AS day, count(*) AS completions, count(*) FILTER (ok) AS successes, count(*) FILTER (ok) >= 3 AS sufficient,
 CASE WHEN count(*) FILTER (ok) >= 3 THEN '' ELSE 'successful_completion_count<3' END AS reason FROM req GROUP BY 1, 2""")
def _(t):
    out = requests(t).groupBy("run_id", F.floor(F.col("us") / DAY).alias("day")).agg(
        F.count(F.lit(1)).alias("completions"), S.n_if("ok").alias("successes"))
    return out.withColumn("sufficient", F.col("successes") >= 3).withColumn(
        "reason", F.when(F.col("successes") >= 3, "").otherwise("successful_completion_count<3"))


@query("e33_manifest_gaps", sql="""SELECT o_orderkey, concat_ws(';', CASE WHEN o_totalprice > 400000 THEN 'campaign_id_missing' END,
 CASE WHEN o_orderstatus = 'P' THEN 'replicate_id_missing' END, CASE WHEN o_orderkey % 11 = 0 THEN 'run_order_missing' END) AS manifest_gap,
 o_totalprice > 400000 OR o_orderstatus = 'P' OR o_orderkey % 11 = 0 AS analysis_ineligible FROM orders""")
def _(t):
    o = t.orders
    gaps = S.gap_list({"campaign_id": F.when(F.col("o_totalprice") <= 400000, F.col("o_orderkey")),
                       "replicate_id": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(F.lit("")),
                       "run_order": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey"))})
    return o.select("o_orderkey", gaps.alias("manifest_gap")).withColumn("analysis_ineligible", F.col("manifest_gap") != "")


@query("e34_time_thirds", sql=f"""WITH {OPEN}, n AS (SELECT run_id, max(scheduled_s) AS n FROM ol GROUP BY 1)
SELECT run_id, CASE WHEN scheduled_s < n / 3 THEN 'early' WHEN scheduled_s < 2 * n / 3 THEN 'middle' ELSE 'late' END AS segment, count(*) AS rows,
 {_q('latency_ms', .5)} AS latency_ms_median, {_q('k', .5)} AS k_median FROM ol JOIN n USING (run_id) GROUP BY 1, 2""")
def _(t):
    return rounded(S.time_thirds(openloop(t), ["run_id"], "scheduled_s", ["latency_ms", "k"], length=F.max("scheduled_s")))


@query("e34_terciles", sql=f"""WITH {REQ}, c AS (SELECT run_id, quantile_cont(us, 1/3::DOUBLE) AS a, quantile_cont(us, 2/3::DOUBLE) AS b FROM req GROUP BY 1)
SELECT run_id, CASE WHEN us <= a THEN 'early' WHEN us <= b THEN 'mid' ELSE 'late' END AS segment, count(*) AS rows, count(*) FILTER (ok) AS success_rows,
 round(avg(latency_ms) FILTER (ok), 6) AS latency_ms_mean, {_q('latency_ms', .95, ' FILTER (ok)')} AS latency_ms_p95 FROM req JOIN c USING (run_id) GROUP BY 1, 2""")
def _(t):
    return S.terciles(requests(t), ["run_id"], "us", "ok", ["latency_ms"], digits=6)


@query("e34_first_to_last", sql=f"""WITH {REQ}, n AS (SELECT run_id, latency_ms, least((row_number() OVER (PARTITION BY run_id ORDER BY us, event_id) - 1) * 3 // count(*) OVER (PARTITION BY run_id), 2) AS seg FROM req),
m AS (SELECT run_id, seg, count(*) AS n, quantile_cont(latency_ms, .5) AS md FROM n GROUP BY 1, 2)
SELECT run_id, CAST(sum(n) AS BIGINT) AS rows, round(max(md) FILTER (seg = 2) - max(md) FILTER (seg = 0), 6) AS latency_ms_first_to_last FROM m GROUP BY 1""")
def _(t):
    return rounded(S.segment_summary(requests(t), ["run_id"], ["us", "event_id"], ["latency_ms"], width=DAY))


@query("e35_exceedance_timing", sql=f"""WITH {OPEN} SELECT run_id, count(*) AS rows, count(*) FILTER (latency_ms > 80) AS exceedances, count(*) FILTER (latency_ms > 80 AND scheduled_s < 120) AS early_exceedances,
 round(min(scheduled_s) FILTER (latency_ms > 80), 6) AS first_exceedance,
 round(CASE WHEN count(*) FILTER (latency_ms > 80) > 0 THEN count(*) FILTER (latency_ms > 80 AND scheduled_s < 120) / count(*) FILTER (latency_ms > 80) ELSE 0 END, 6) AS early_fraction
FROM ol GROUP BY 1""")
def _(t):
    return rounded(S.exceedance_timing(openloop(t).withColumn("flag", F.col("latency_ms") > 80), ["run_id"], "scheduled_s", "flag", 120))


@query("e36_forecast_metrics", sql="""SELECT l_returnflag, l_linenumber, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias,
 round(1 - sum(e * e) / (var_pop(l_extendedprice) * count(*)), 6) AS r2 FROM (SELECT *, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY 1, 2""")
def _(t):
    return rounded(S.forecast_metrics(t.lineitem.withColumn("p", F.col("l_quantity") * 1500), ["l_returnflag", "l_linenumber"], "l_extendedprice", "p"))


_RUNS = REQ + """, fr AS (SELECT run_id, event_type, count(*) AS rows, avg(CAST(latency_ms > 90 AS DOUBLE)) AS er, count(*) FILTER (latency_ms > 90) / greatest(count(*) / 3600.0, 1e-9) AS ph
 FROM req WHERE k <> 5 GROUP BY 1, 2)"""


@query("e38_false_alarm_runs", sql=f"WITH {_RUNS} SELECT run_id, event_type, rows, round(er, 6) AS exceedance_rate, round(ph, 6) AS per_healthy_hour FROM fr")
def _(t):
    r = requests(t).withColumn("x", F.col("latency_ms") > 90).withColumn("v", F.col("k") != 5)
    return rounded(S.false_alarms(r, ["run_id", "event_type"], "x", "v", ["event_type"])[0])


@query("e38_false_alarm_levels", sql=f"WITH {_RUNS} SELECT event_type, count(*) AS runs, {_q('ph', .5)} AS median_per_hour, {_q('ph', .95)} AS p95_per_hour, {_q('er', .5)} AS median_rate FROM fr GROUP BY 1")
def _(t):
    r = requests(t).withColumn("x", F.col("latency_ms") > 90).withColumn("v", F.col("k") != 5)
    return rounded(S.false_alarms(r, ["run_id", "event_type"], "x", "v", ["event_type"])[1])


@query("e40_binned_relation", sql=f"""SELECT p_brand, floor(p_size / 10.0) * 10.0 AS bin, count(*) AS n, {_q('p_retailprice', .5)} AS median, {_q('p_retailprice', .25)} AS p25,
 {_q('p_retailprice', .75)} AS p75, {_q('p_retailprice', .95)} AS p95 FROM part GROUP BY 1, 2""")
def _(t):
    return rounded(S.binned_relation(t.part, "p_size", "p_retailprice", 10.0, ["p_brand"]))


@query("e41_empirical_distribution", sql=f"""WITH {REQ}, g AS (SELECT event_type, latency_ms, count(*) AS n FROM req GROUP BY 1, 2)
SELECT event_type, latency_ms, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY latency_ms) / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM g""")
def _(t):
    return rounded(S.empirical_distribution(requests(t), ["event_type"], "latency_ms"))


@query("e41_box_statistics", sql=f"""WITH {REQ} SELECT event_type, {_q('latency_ms', 0)} AS low, {_q('latency_ms', .25)} AS q1, {_q('latency_ms', .5)} AS median, {_q('latency_ms', .75)} AS q3, {_q('latency_ms', 1)} AS high FROM req GROUP BY 1""")
def _(t):
    return rounded(quantiles(requests(t), ["event_type"], {n: ("latency_ms", q) for n, q in
                                                          (("low", 0), ("q1", .25), ("median", .5), ("q3", .75), ("high", 1))}))


_ONSET = OPEN + ", onset AS (SELECT run_id, min(scheduled_s) AS onset_s FROM ol WHERE success = false AND scheduled_s > 100 GROUP BY 1)"


def _onsets(t):
    ol = openloop(t)
    return ol, ol.filter((F.col("success") == F.lit(False)) & (F.col("scheduled_s") > 100)).groupBy("run_id").agg(F.min("scheduled_s").alias("onset_s"))


@query("e42_event_study", sql=f"""WITH {_ONSET} SELECT round_even((scheduled_s - onset_s) / 10, 0) * 10 AS rel_bin, count(*) AS rows, {_q('latency_ms', .5)} AS latency_ms_median
FROM ol JOIN onset USING (run_id) WHERE scheduled_s - onset_s BETWEEN -100 AND 200 GROUP BY 1""")
def _(t):
    ol, onsets = _onsets(t)
    return rounded(S.event_study(ol, onsets, ["run_id"], "scheduled_s", "onset_s", -100, 200, 10, ["latency_ms"]))


@query("e42_event_windows", sql=f"""WITH {_ONSET}, r AS (SELECT *, scheduled_s - onset_s AS rel FROM ol JOIN onset USING (run_id))
SELECT CASE WHEN rel < -30 THEN '-60_to_-30' WHEN rel < 0 THEN '-30_to_0' WHEN rel < 30 THEN '0_to_30' ELSE '30_to_60' END AS "window", count(*) AS rows,
 {_q('latency_ms', .5)} AS latency_ms_median, {_q('latency_ms', .9)} AS latency_ms_p90 FROM r WHERE rel >= -60 AND rel < 60 GROUP BY 1""")
def _(t):
    ol, onsets = _onsets(t)
    return rounded(S.event_windows(ol, onsets, ["run_id"], "scheduled_s", "onset_s", [(-60, -30), (-30, 0), (0, 30), (30, 60)], ["latency_ms"]))


@query("e43_sweep_rows", sql=f"""WITH {REQ}, h AS (SELECT run_id, event_type, count(*) AS n FROM req GROUP BY 1, 2),
x AS (SELECT run_id, string_agg(event_type || ':' || n, ';' ORDER BY event_type || ':' || n) AS hist FROM h GROUP BY 1)
SELECT run_id, count(*) AS attempted, count(*) FILTER (ok) AS successful, round(count(*) / ((max(us) - min(us)) / 3.6e9), 6) AS attempted_rps,
 round(count(*) FILTER (ok) / ((max(us) - min(us)) / 3.6e9), 6) AS successful_rps, any_value(hist) AS status_histogram FROM req JOIN x USING (run_id) GROUP BY 1""")
def _(t):
    return rounded(S.sweep_rows(requests(t), ["run_id"], (F.max("us") - F.min("us")) / 3.6e9, F.col("ok"), "event_type"))


@query("e44_baseline_gate", sql=f"""WITH {REQ} SELECT run_id, us // 86400000000 AS day, count(*) AS total, round(avg(CAST(ok AS DOUBLE)) * 100, 6) AS success_pct, max(latency_ms) FILTER (ok) AS max_ms,
 count(*) FILTER (ok AND latency_ms > 300) AS slow, count(*) FILTER (k < 3) AS health_failures,
 coalesce(avg(CAST(ok AS DOUBLE)) * 100 >= 99.999 AND count(*) FILTER (ok AND latency_ms > 300) = 0 AND max(latency_ms) FILTER (ok) <= 200 AND count(*) FILTER (k < 3) = 0, false) AS clean
FROM req GROUP BY 1, 2""")
def _(t):
    r = requests(t).withColumn("healthy", F.col("k") >= 3).withColumn("day", F.floor(F.col("us") / DAY))
    return rounded(S.baseline_gate(r, ["run_id", "day"], "ok", "latency_ms", "healthy", slow_ms=300, max_ms=200))


@query("e45_readiness_rules", sql=f"""WITH {REQ}, f AS (SELECT run_id, count(*) AS n, count(*) FILTER (NOT ok) AS bad, max(latency_ms) AS mx FROM req GROUP BY 1)
SELECT run_id, 'formal_measurement_rows' AS "check", CASE WHEN n >= 60 THEN 'pass' ELSE 'fail' END AS status, n::DOUBLE AS observed, '>= 60' AS required FROM f
UNION ALL SELECT run_id, 'error_rate', CASE WHEN bad / n <= 0.2 THEN 'pass' ELSE 'fail' END, round(bad / n, 6), '<= 0.2' FROM f
UNION ALL SELECT run_id, 'latency_limit', CASE WHEN mx <= 250 THEN 'pass' ELSE 'fail' END, mx, '<= 250' FROM f""")
def _(t):
    f = requests(t).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), S.n_if(~F.col("ok")).alias("bad"), F.max("latency_ms").alias("mx"))
    n, rate, mx = F.col("n"), F.col("bad") / F.col("n"), F.col("mx")
    return rounded(S.rule_table(f, ["run_id"], [("formal_measurement_rows", n >= 60, n, ">= 60"), ("error_rate", rate <= 0.2, rate, "<= 0.2"),
                                               ("latency_limit", mx <= 250, mx, "<= 250")]))


_READY = ["normal_long_replicates", "formal_measurement_rows", "manifest_validity", "gpu_temp_internal_drift", "sm_clock_internal_drift", "service_state_normalized_latency_episodes"]
_RUNS = f"""{REQ}, runs AS (SELECT run_id % 7 AS campaign, run_id, count(*) FILTER (ok) AS eligible, CASE WHEN max(k) = 99 AND run_id % 5 = 0 THEN 'TRUE' ELSE '0' END AS ineligible,
 max_by(latency_ms, (us, event_id)) - min_by(latency_ms, (us, event_id)) AS t_drift, max_by(k, (us, event_id)) - min_by(k, (us, event_id)) AS c_drift, count(*) FILTER (latency_ms > 250) AS episodes FROM req GROUP BY run_id)"""
_CHECKS = f"""{_RUNS}, f AS (SELECT campaign, count(*) AS n, sum(eligible) AS rows, count(*) FILTER (lower(ineligible) IN ('true', '1')) AS bad, max(abs(t_drift)) AS td, max(abs(c_drift)) AS cd, sum(episodes) AS ep FROM runs GROUP BY 1),
r AS (SELECT campaign, unnest({_READY}) AS "check", unnest([n >= 20, rows >= 1000, bad = 0, td <= 150, cd <= 95, ep = 0]) AS good, unnest([n, rows, bad, td, cd, ep]::DOUBLE[]) AS observed,
 unnest(['20', '1000', '0', '<= 150', '<= 95', '0']) AS required FROM f)"""


def _readiness(t):
    r = requests(t)
    order = F.struct("us", "event_id")
    edge = lambda c: F.max_by(c, order) - F.min_by(c, order)
    runs = r.groupBy("run_id").agg(
        S.n_if(F.col("ok")).alias("eligible"), F.when((F.max("k") == 99) & (F.col("run_id") % 5 == 0), "TRUE").otherwise("0").alias("ineligible"),
        edge("latency_ms").alias("t_drift"), edge("k").alias("c_drift"), S.n_if(F.col("latency_ms") > 250).alias("episodes")).withColumn("campaign", F.col("run_id") % 7)
    return A.readiness(runs, ["campaign"], eligible_rows="eligible", ineligible="ineligible", temperature_drift="t_drift", clock_drift="c_drift", episodes="episodes",
                       min_replicates=20, min_rows=1000, max_temperature_drift=150, max_clock_drift=95)


@query("e45_readiness_six", sql=f"""WITH {_CHECKS} SELECT campaign, "check", CASE WHEN good THEN 'pass' ELSE 'fail' END AS status, round(observed, 6) AS observed, required FROM r""")
def _(t):
    return rounded(_readiness(t))


@query("e45_readiness_decision", sql=f"""WITH {_CHECKS} SELECT campaign, count(*) FILTER (NOT good) AS failed_checks, CASE WHEN bool_and(good) THEN 'method_ready_but_live_cooling_executor_still_fail_closed' ELSE 'not_ready_collect_more_normal_or_fix_contract' END AS decision FROM r GROUP BY 1""")
def _(t):
    return A.readiness_decision(_readiness(t), ["campaign"])


_AP = "SELECT {g}sum(pos * pa / na) / max(p) AS ap FROM (SELECT *, sum(pos) OVER (PARTITION BY {p} ORDER BY s DESC) AS pa, sum(n) OVER (PARTITION BY {p} ORDER BY s DESC) AS na, sum(pos) OVER (PARTITION BY {p}) AS p, sum(n) OVER (PARTITION BY {p}) AS t FROM ({src})) WHERE p > 0 AND p < t{h}"


@query("e45_methodology_audit", sql=f"""WITH {REQ}, x AS (SELECT *, (us - 1704067200000000) / 3.6e9 AS t, latency_ms > 40 AS label, k >= 60 AS warning, min(us) FILTER (NOT ok) OVER (PARTITION BY run_id) AS e, run_id % 3 <> 0 AS train FROM req),
l AS (SELECT run_id, min(t) FILTER (warning) AS w, min((e - 1704067200000000) / 3.6e9) AS o FROM x GROUP BY 1),
u AS ({_AP.format(g='', p='1', h='', src="SELECT t AS s, count(*) AS n, count(*) FILTER (label) AS pos FROM x WHERE NOT train GROUP BY 1")}),
v AS ({_AP.format(g='', p='1', h='', src="SELECT -t AS s, count(*) AS n, count(*) FILTER (label) AS pos FROM x WHERE NOT train GROUP BY 1")}),
q AS (SELECT quantile_cont(ap, .5) AS run_ap FROM ({_AP.format(g='run_id, ', p='run_id', h=' GROUP BY run_id', src="SELECT run_id, k AS s, count(*) AS n, count(*) FILTER (label) AS pos FROM x GROUP BY 1, 2")})),
f AS (SELECT (SELECT CASE WHEN avg(t) FILTER (train AND label) >= avg(t) FILTER (train AND NOT label) THEN (SELECT ap FROM u) ELSE (SELECT ap FROM v) END FROM x) AS ap,
 (SELECT avg((abs(o - w - 24) <= 1)::INTEGER) FROM l WHERE w IS NOT NULL) AS ex, (SELECT count(DISTINCT run_id) FROM x) AS runs, (SELECT count(*) FROM x WHERE NOT train AND k < 5) AS outside, (SELECT count(DISTINCT run_id % 4) FROM x) AS profiles, (SELECT run_ap FROM q) AS run_ap)
SELECT unnest(['primary_features_exclude_template_and_control_metadata', 'rolling_features_use_past_and_current_only', 'early_warning_label_uses_future_only', 'normal_thresholds_training_only', 'timeout_error_in_endpoint',
 'leave_one_profile_out_feasibility', 'leave_one_cycle_out_equivalence', 'lead_time_not_only_horizon_artifact', 'template_time_only_negative_control', 'groupwise_validation_by_run']) AS "check",
 unnest(['FAIL', 'PASS', 'PASS', CASE WHEN outside = 0 THEN 'PASS' ELSE 'FAIL' END, 'PASS', CASE WHEN profiles <= 1 THEN 'NOT_APPLICABLE' ELSE 'PENDING' END, 'PASS', CASE WHEN ex > 0.5 THEN 'WARN' ELSE 'PASS' END,
 CASE WHEN ap >= 0.95 THEN 'WARN' ELSE 'PASS' END, 'PASS']) AS status, unnest([1, 0, 1, outside, 2, profiles, runs, round(ex, 6), round(ap, 6), round(run_ap, 6)]::DOUBLE[]) AS observed FROM f""")
def _(t):
    r = requests(t)
    first = r.groupBy("run_id").agg(F.min(F.when(~F.col("ok"), F.col("us"))).alias("e"))
    hours = lambda c: (F.col(c) - F.lit(1704067200000000)) / F.lit(3.6e9)
    x = r.join(first, "run_id").select("run_id", F.col("run_id").alias("cycle"), (F.col("run_id") % 4).alias("profile"), hours("us").alias("t"), hours("e").alias("onset"), "k",
                                       (F.col("latency_ms") > 40).alias("label"), (F.col("k") >= 60).alias("warning"))
    out = A.methodology_audit(x, run="run_id", cycle="cycle", profile="profile", t="t", warning="warning", onset="onset", label="label", score="k", train=F.col("run_id") % 3 != 0, in_thresholds=F.col("k") < 5,
                              features={"latency_mean_15": (-14, 0), "k_slope_5": (-5, 0), "elapsed_s": (0, 0)}, forbidden=["phase", "elapsed_s", "run_id"], label_frame=(1, 30),
                              endpoint=["fail_rate_high", "timeout_rate_high", "latency_high"], required_endpoint=["fail_rate_high", "timeout_rate_high"], horizon=24)
    return rounded(out)


@query("e49_batch_collation", sql=f"""WITH {REQ}, g AS (SELECT run_id, ['warmup', 'normal_hold', 'fault_hold', 'other'][1 + k % 4] AS phase, round(avg(latency_ms), 6) AS client_mean, max(latency_ms) AS client_max FROM req WHERE run_id % 6 <> 1 GROUP BY 1, 2),
m AS (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM req GROUP BY 1), a AS (SELECT run_id, count(*) AS rows FROM req WHERE run_id % 8 <> 2 GROUP BY 1),
s AS (SELECT run_id, max(client_mean) FILTER (phase = 'warmup') AS warmup_client_mean, max(client_mean) FILTER (phase = 'normal_hold') AS normal_client_mean, max(client_mean) FILTER (phase = 'fault_hold') AS fault_hold_client_mean,
 max(client_max) FILTER (phase = 'warmup') AS warmup_client_max, max(client_max) FILTER (phase = 'normal_hold') AS normal_client_max, max(client_max) FILTER (phase = 'fault_hold') AS fault_hold_client_max FROM g GROUP BY 1)
SELECT m.run_id, status, rows, s.* EXCLUDE (run_id) FROM m JOIN a USING (run_id) LEFT JOIN s USING (run_id) WHERE status = 'ok'""")
def _(t):
    r = requests(t)
    names = F.array(*[F.lit(p) for p in ("warmup", "normal_hold", "fault_hold", "other")])
    service = r.filter("run_id % 6 <> 1").groupBy("run_id", names[F.col("k") % 4].alias("phase")).agg(F.round(F.avg("latency_ms"), 6).alias("client_mean"), F.max("latency_ms").alias("client_max"))
    manifest = r.select("run_id").distinct().withColumn("status", F.when(F.col("run_id") % 5 == 0, "failed").otherwise("ok"))
    aligned = r.filter("run_id % 8 <> 2").groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"))
    return A.collated_batch(manifest, aligned, service, "run_id", status="status", phase="phase", phases={"warmup": "warmup", "normal_hold": "normal", "fault_hold": "fault_hold"},
                            statistics=["client_mean", "client_max"], summary=["rows"])


@query("e48_history_counts", sql=f"""WITH {REQ}, h AS (SELECT run_id, CASE event_type WHEN 'view' THEN 'single_inference' WHEN 'click' THEN 'serving_benchmark' WHEN 'error' THEN 'controlled_batch' ELSE 'llamacpp_offline_benchmark' END AS kind FROM req),
x AS (SELECT run_id, kind, unnest(['all', CASE kind WHEN 'single_inference' THEN 'inference' WHEN 'llamacpp_offline_benchmark' THEN 'throughput' ELSE 'serving' END]) AS filter FROM h)
SELECT run_id, filter, least(count(*), 5) AS shown, count(*) FILTER (kind = 'single_inference') AS inferences, count(*) FILTER (kind <> 'single_inference') AS benchmarks FROM x GROUP BY 1, 2""")
def _(t):
    e = F.col("event_type")
    kind = F.when(e == "view", "single_inference").when(e == "click", "serving_benchmark").when(e == "error", "controlled_batch").otherwise("llamacpp_offline_benchmark")
    return A.history_counts(requests(t).select("run_id", kind.alias("kind")), ["run_id"], "kind")


@query("e45_abort_conditions", sql=f"""WITH {OPEN}, b AS (SELECT run_id, floor(scheduled_s / 24) AS bin, count(*) AS n, count(*) FILTER (dropped) AS d, count(*) FILTER (error_type = 'timeout') AS t, count(*) FILTER (NOT success) AS f FROM ol GROUP BY 1, 2),
a AS (SELECT run_id, max(d / n) AS dm, max(t / n) AS tm, max(f / n) AS fm FROM b GROUP BY 1), h AS (SELECT run_id, count(*) AS n, max(k) AS mx FROM ol WHERE event_type = 'view' AND run_id % 9 <> 0 GROUP BY 1),
x AS (SELECT a.run_id, dm, tm, fm, coalesce(n, 0) AS n, mx FROM a LEFT JOIN h USING (run_id)), r AS (SELECT *, concat_ws(',', CASE WHEN n = 0 THEN 'missing_gpu_telemetry' END, CASE WHEN mx > 97 THEN 'gpu_temperature_over_operator_limit' END,
 CASE WHEN dm > 0.4 THEN 'client_max_inflight_saturation' END, CASE WHEN tm > 0.4 THEN 'timeout_burst' END, CASE WHEN fm > 0.4 THEN 'error_burst' END) AS reasons FROM x)
SELECT run_id, round(dm, 6) AS drop_max, round(tm, 6) AS timeout_max, round(fm, 6) AS fail_max, n AS telemetry_rows, mx AS temperature_max, reasons, reasons <> '' AS abort FROM r""")
def _(t):
    ol = openloop(t)
    heat = ol.filter("event_type = 'view' AND run_id % 9 <> 0")
    return rounded(S.abort_conditions(grid.arrival_bins(ol, ["run_id"], bucket_s=24), heat, ["run_id"], "k", limit=0.4, max_temperature=97))


@query("e45_replicate_shift", sql=f"""WITH {REQ}, m AS (SELECT run_id % 5 AS grp, run_id, quantile_cont(latency_ms, .5) AS l, quantile_cont(k, .5) AS k FROM req GROUP BY 1, 2)
SELECT grp, round(max(l) - min(l), 6) AS latency_spread, round(max(k) - min(k), 6) AS temp_spread,
 CASE WHEN max(l) - min(l) > 15 AND max(k) - min(k) <= 33 THEN 'normal service baseline shift dominates' ELSE 'insufficient evidence' END AS classification FROM m GROUP BY 1""")
def _(t):
    med = quantiles(requests(t).withColumn("grp", F.col("run_id") % 5), ["grp", "run_id"], {"l": ("latency_ms", .5), "kk": ("k", .5)})
    out = med.groupBy("grp").agg((F.max("l") - F.min("l")).alias("latency_spread"), (F.max("kk") - F.min("kk")).alias("temp_spread"))
    return rounded(out.withColumn("classification", F.when((F.col("latency_spread") > 15) & (F.col("temp_spread") <= 33),
                                                           "normal service baseline shift dominates").otherwise("insufficient evidence")))


@query("e46_semantic_audit", sql=f"""WITH s AS (SELECT l_suppkey, count(*) AS n, corr(l_quantity, l_extendedprice / 1500) AS c, avg(abs(l_quantity - l_extendedprice / 1500)) AS mae,
 quantile_cont(abs(l_quantity - l_extendedprice / 1500), .5) AS md FROM lineitem GROUP BY 1)
SELECT l_suppkey, n AS overlap_rows, round(c, 6) AS corr, round(mae, 6) AS mae, round(md, 6) AS median_abs_diff,
 CASE WHEN c IS NULL THEN 'insufficient evidence' WHEN c >= 0.7 AND md <= 10 THEN 'same semantic metric' WHEN abs(c) < 0.3 OR md > 20 THEN 'mismatched semantic metric' ELSE 'insufficient evidence' END AS decision FROM s""")
def _(t):
    return rounded(S.semantic_audit(t.lineitem.withColumn("y", F.col("l_extendedprice") / 1500), ["l_suppkey"], "l_quantity", "y"))


@query("e49_band_summary", sql=f"""WITH {REQ} SELECT run_id, count(*) AS rows, count(*) FILTER (k < 80) AS matched_rows, count(*) FILTER (k < 80 AND k >= 30) AS within_band_rows,
 round(avg(latency_ms) FILTER (k < 80), 4) AS latency_ms_all, round(avg(latency_ms) FILTER (k < 80 AND k >= 30), 4) AS latency_ms_in_band,
 round(count(*) FILTER (k < 80 AND k >= 30) / count(*) FILTER (k < 80), 4) AS within_band_ratio FROM req GROUP BY 1""")
def _(t):
    return S.band_summary(requests(t), ["run_id"], F.col("k") < 80, F.col("k") >= 30, ["latency_ms"])


@query("e50_dataset_manifest", sql="SELECT user_id, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("e51_collection_counts", sql=f"WITH {REQ} SELECT date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (ok) AS ok_count, count(*) FILTER (NOT ok) AS error_count FROM req GROUP BY 1")
def _(t):
    return requests(t).groupBy(trunc_ntz("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("total"), S.n_if("ok").alias("ok_count"),
                                                                       S.n_if(~F.col("ok")).alias("error_count"))


@query("e54_cooldown_readiness", sql=f"""WITH {REQ}, b AS (SELECT run_id, quantile_cont(latency_ms, .5) AS base FROM req GROUP BY 1)
SELECT event_id, CASE event_type WHEN 'click' THEN k <= 60 AND k % 9 <= 5 AND latency_ms <= greatest(2.0, base + 2.0)
 WHEN 'view' THEN k <= 60 AND latency_ms <= base + 3.0 AND k % 9 <= 5 WHEN 'signup' THEN k <= 20.0 AND k % 9 <= 5 AND latency_ms <= greatest(2.0, base + 2.0)
 ELSE k <= 60 AND k % 9 <= 5 END AS ready FROM req JOIN b USING (run_id)""")
def _(t):
    from pulsegrid.operators.keys import join_on
    r = requests(t)
    base = quantiles(r, ["run_id"], {"base": ("latency_ms", .5)})
    kind = F.when(F.col("event_type") == "click", "cpu_bound").when(F.col("event_type") == "view", "ram_bound") \
        .when(F.col("event_type") == "signup", "vram_bound").otherwise("idle")
    v = F.col("latency_ms")
    return join_on(r, base, ["run_id"]).select("event_id", S.cooled_down(
        kind, F.col("k"), v, F.col("k") % 9, v, F.col("base"), F.col("base"), cpu_max=60).alias("ready"))


@query("e55_window_statistics", sql=f"""WITH {REQ} SELECT us // 432000000000 AS window_id, min(us) AS start_us, max(us) AS end_us, count(*) AS rows, round(avg(latency_ms), 6) AS mean,
 {_q('latency_ms', .5)} AS p50, {_q('latency_ms', .9)} AS p90, {_q('latency_ms', .95)} AS p95, {_q('latency_ms', .99)} AS p99 FROM req WHERE ok GROUP BY 1""")
def _(t):
    r = requests(t).filter("ok").withColumn("window_id", F.floor(F.col("us") / 432000000000))
    return rounded(summarise(r, ["window_id"], {"start_us": F.min("us"), "end_us": F.max("us"), "rows": F.count(F.lit(1)), "mean": F.avg("latency_ms")},
                             {f"p{int(q * 100)}": ("latency_ms", q) for q in (.5, .9, .95, .99)}))


@query("e56_run_summary", sql=f"""WITH {REQ}, e AS (SELECT run_id, CASE WHEN ok THEN 'normal_success' WHEN k < 50 THEN '<empty>' ELSE 'http_5xx' END AS e, count(*) AS n FROM req GROUP BY 1, 2),
x AS (SELECT run_id, string_agg(e || ':' || n, ';' ORDER BY e || ':' || n) AS error_types FROM e GROUP BY 1)
SELECT run_id, count(*) AS rows, round(avg(CASE WHEN k % 10 <> 3 THEN CAST(ok AS DOUBLE) END), 6) AS success_rate, count(*) FILTER (ok) AS clean_rows, round(avg(latency_ms) FILTER (ok), 6) AS clean_mean,
 min(latency_ms) FILTER (ok) AS clean_min, max(latency_ms) FILTER (ok) AS clean_max, round(count(*) / ((max(us) - min(us)) / 1e6), 6) AS achieved_rps, round(count(*) FILTER (ok) / ((max(us) - min(us)) / 1e6), 6) AS successful_rps,
 {_q('latency_ms', .5, ' FILTER (ok)')} AS clean_p50, {_q('latency_ms', .9, ' FILTER (ok)')} AS clean_p90, {_q('latency_ms', .95, ' FILTER (ok)')} AS clean_p95, {_q('latency_ms', .99, ' FILTER (ok)')} AS clean_p99,
 any_value(error_types) AS error_types FROM req JOIN x USING (run_id) GROUP BY 1""")
def _(t):
    r = requests(t).withColumn("flag", F.when(F.col("k") % 10 == 3, "n/a").when(F.col("ok"), " True").otherwise("0.0")) \
        .withColumn("error_type", F.when(F.col("ok"), "normal_success").when(F.col("k") < 50, "").otherwise("http_5xx"))
    return rounded(S.run_summary(r, ["run_id"], "us", "flag", F.col("error_type") == "normal_success", "error_type", "latency_ms"))
