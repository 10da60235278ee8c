"""Sequence-detection queries. A run's events in time order are its rows; hours play seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, HOUR
from pulsegrid.operators import align as A, sequence as Q
from pulsegrid.operators.keys import join_on

from .registry import query, rounded
from .summaries import _q, states, STATES
from .views import REQ, requests

BY, ORDER = ["run_id"], ["us", "event_id"]
SMALL = 64  # rows per block in these queries; runs of the shared tables are short


def hourly(t):
    """Requests with their hour number as the time step."""
    return requests(t).withColumn("h", F.floor(F.col("us") / HOUR))


HR = REQ + ", hr AS (SELECT *, us // 3600000000 AS h, row_number() OVER w AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM req WINDOW w AS (PARTITION BY run_id ORDER BY us, event_id))"
W0 = "PARTITION BY run_id ORDER BY us, event_id"


@query("f01_lags_and_slopes", sql=f"""WITH {HR} SELECT event_id, lag(latency_ms, 1) OVER w AS latency_ms_lag_1, lag(latency_ms, 5) OVER w AS latency_ms_lag_5,
 round(latency_ms - lag(latency_ms, 5) OVER w, 6) AS latency_ms_slope_5, round(latency_ms - lag(latency_ms, 15) OVER w, 6) AS latency_ms_slope_15 FROM hr WINDOW w AS ({W0})""")
def _(t):
    out = Q.lags_and_slopes(requests(t), BY, ORDER, "latency_ms", [1, 5], [5, 15], width=DAY, block=SMALL)
    return rounded(out.select("event_id", *[c for c in out.columns if "_lag_" in c or "_slope_" in c]))


@query("f02_rolling_statistics", sql=f"""WITH {HR} SELECT event_id, round(CASE WHEN count(*) OVER w >= 5 THEN avg(latency_ms) OVER w END, 6) AS m, round(CASE WHEN count(*) OVER w >= 5 THEN quantile_cont(latency_ms, .5) OVER w END, 6) AS md,
 round(CASE WHEN count(*) OVER w >= 5 THEN stddev_samp(latency_ms) OVER w END, 6) AS sd, CAST(sum(k) OVER w3 AS BIGINT) AS s3 FROM hr WINDOW w AS ({W0} ROWS 14 PRECEDING), w3 AS ({W0} ROWS 2 PRECEDING)""")
def _(t):
    out = Q.rolling(requests(t), BY, ORDER, {"m": ("latency_ms", "mean", 15, 5), "md": ("latency_ms", "median", 15, 5),
                                             "sd": ("latency_ms", "std", 15, 5), "s3": ("k", "sum", 3, 1)}, width=DAY, block=SMALL)
    return rounded(out.select("event_id", "m", "md", "sd", "s3"))


@query("f03_exponential_mean", sql=f"""WITH {HR} SELECT a.event_id, round(sum(CASE WHEN b.rn = 1 THEN 1.0 ELSE 0.2 END * pow(0.8, a.rn - b.rn) * b.latency_ms), 6) AS ewma
FROM hr a JOIN hr b ON a.run_id = b.run_id AND b.rn <= a.rn GROUP BY 1""")
def _(t):
    return rounded(Q.exponential_mean(requests(t), BY, ORDER, "latency_ms", "ewma", 9, width=DAY, block=SMALL).select("event_id", "ewma"))


@query("f04_forecast_frame", sql=f"""WITH {HR} SELECT event_id, lead(latency_ms, 10) OVER w AS future, latency_ms AS persistence, round(CASE WHEN count(*) OVER r >= 5 THEN quantile_cont(latency_ms, .5) OVER r END, 6) AS rolling_median
FROM hr WINDOW w AS ({W0}), r AS ({W0} ROWS 14 PRECEDING)""")
def _(t):
    out = Q.forecast_frame(requests(t), BY, ORDER, "latency_ms", 10, width=DAY, block=SMALL)
    return rounded(out.select("event_id", "future", "persistence", "rolling_median"))


@query("f05_sustained_flag", sql=f"""WITH {HR} SELECT event_id, sum(CAST(latency_ms > 40 AS INT)) OVER w >= 5 AND count(*) OVER w >= 5 AS degraded FROM hr WINDOW w AS ({W0} ROWS 14 PRECEDING)""")
def _(t):
    r = requests(t).withColumn("bad", F.col("latency_ms") > 40)
    return Q.sustained(r, BY, ORDER, "bad", "degraded", width=DAY, block=SMALL).select("event_id", "degraded")


@query("f06_future_label", sql=f"""WITH {HR} SELECT event_id, rn + 6 <= n AND max(CAST(latency_ms > 120 AS INT)) OVER (w ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) = 1 AS soon,
 rn + 5 <= n AND coalesce(max(CAST(latency_ms > 120 AS INT)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) = 1 AS later FROM hr WINDOW w AS ({W0})""")
def _(t):
    r = requests(t).withColumn("bad", F.col("latency_ms") > 120)
    a = Q.future_label(r, BY, ORDER, "bad", "soon", 6, width=DAY, block=SMALL)
    return Q.future_label(a, BY, ORDER, "bad", "later", 6, width=DAY, include_now=False, block=SMALL).select("event_id", "soon", "later")


_ISL = HR + f""", fl AS (SELECT *, latency_ms > 25 AS f FROM hr), g AS (SELECT *, sum(CAST(NOT f AS INT)) OVER ({W0}) AS nf FROM fl),
isl AS (SELECT run_id, nf, min(h) AS s, max(h) AS e, count(*) AS rows, min(us) AS su, max(us) AS eu FROM g WHERE f GROUP BY 1, 2)"""


@query("f07_first_sustained", sql=f"""WITH {HR}, s AS (SELECT *, sum(CAST(latency_ms > 25 AS INT)) OVER ({W0} ROWS 3 PRECEDING) AS c FROM hr) SELECT run_id, min(h) FILTER (c >= 4) - 3 AS onset FROM s GROUP BY 1""")
def _(t):
    return Q.first_sustained(hourly(t), BY, ["h", "event_id"], {"onset": F.col("latency_ms") > 25}, width=24, k=4, block=SMALL)


_EP = _ISL + """, kept AS (SELECT *, lag(e) OVER (PARTITION BY run_id ORDER BY s) AS pe FROM isl WHERE e - s + 1 >= 12),
ep0 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s - pe > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s) AS ep FROM kept),
eps AS (SELECT run_id, ep, min(s) AS s, max(e) AS e FROM ep0 GROUP BY 1, 2)"""


@query("f08_islands", sql=f'WITH {_ISL} SELECT run_id, s AS "start", e AS "end", rows FROM isl')
def _(t):
    return Q.islands(hourly(t).withColumn("f", F.col("latency_ms") > 25), BY, ["h", "event_id"], "f", width=24)


@query("f08_episodes", sql=f'WITH {_EP} SELECT run_id, s AS "start", e AS "end" FROM eps')
def _(t):
    return Q.episodes(hourly(t).withColumn("f", F.col("latency_ms") > 25), BY, ["h", "event_id"], "f", width=24, min_duration=12, refractory=30)


@query("f08_episode_summary", sql=f"""WITH {_EP}, x AS (SELECT run_id, count(*) AS n, CAST(sum(e - s + 1) AS BIGINT) AS d, max(e - s + 1) AS m, string_agg(s || '-' || e, ';' ORDER BY s) AS txt FROM eps GROUP BY 1)
SELECT run_id, count(*) AS scored_rows, count(*) FILTER (latency_ms > 25) AS exceedances, coalesce(any_value(x.n), 0) AS episode_count, coalesce(any_value(d), 0) AS total_duration, coalesce(any_value(m), 0) AS max_duration,
 coalesce(any_value(txt), '') AS episodes FROM hr LEFT JOIN x USING (run_id) GROUP BY 1""")
def _(t):
    return Q.episode_summary(hourly(t).withColumn("f", F.col("latency_ms") > 25), BY, ["h", "event_id"], "f", width=24, min_duration=12, refractory=30, text=True)


@query("f09_longest_stable", sql=f"""WITH {HR}, m AS (SELECT *, avg(latency_ms) OVER ({W0} ROWS 4 PRECEDING) >= 30 AND rn >= 5 AND k >= 5 AS f FROM hr), g AS (SELECT *, sum(CAST(NOT f AS INT)) OVER ({W0}) AS nf FROM m),
i AS (SELECT run_id, nf, min(us) AS s, max(us) AS e, count(*) AS rows FROM g WHERE f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rows DESC, s) AS o FROM i)
SELECT run_id, s AS "start", e AS "end", rows FROM r WHERE o = 1""")
def _(t):
    r = Q.rolling(requests(t), BY, ORDER, {"m": ("latency_ms", "mean", 5, 5)}, width=DAY, block=SMALL)
    return Q.longest_segment(r.withColumn("f", (F.col("m") >= 30) & (F.col("k") >= 5)), BY, ORDER, "f", width=DAY)


@query("f10_change_points", sql="""SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p IS NULL OR p <> role""")
def _(t):
    return Q.change_points(t.conversations, ["conv_id"], ["turn"], "role", width=1024).select("conv_id", "turn", "role")


_DEB = "WITH RECURSIVE " + HR + """, al AS (SELECT run_id, us, event_id, row_number() OVER (PARTITION BY run_id ORDER BY us) AS i FROM hr WHERE latency_ms > 20),
db AS (SELECT run_id, i, us, event_id, us AS kept, TRUE AS keep FROM al WHERE i = 1 UNION ALL
 SELECT a.run_id, a.i, a.us, a.event_id, CASE WHEN a.us - d.kept >= 86400000000 THEN a.us ELSE d.kept END, a.us - d.kept >= 86400000000 FROM db d JOIN al a ON a.run_id = d.run_id AND a.i = d.i + 1)"""


@query("f11_debounce", sql=f"{_DEB} SELECT run_id, us, event_id FROM db WHERE keep")
def _(t):
    r = requests(t).withColumn("alert", F.col("latency_ms") > 20)
    return Q.debounce(r, BY, "us", "alert", DAY, width=3 * DAY, carry=["event_id"])


_ON = HR + """, c AS (SELECT *, k >= 70 AS f FROM hr), g AS (SELECT *, sum(CAST(f AS INT)) OVER (PARTITION BY run_id ORDER BY us, event_id) - CAST(f AS INT) AS b FROM c),
o AS (SELECT run_id, b, max(us) FILTER (f) AS onset, min(us) FILTER (NOT f) AS since FROM g GROUP BY 1, 2), ons AS (SELECT run_id, onset, onset - since AS healthy_runin FROM o WHERE onset - since >= 43200000000)"""


def _onset_rows(t):
    return Q.onsets(requests(t).withColumn("f", F.col("k") >= 70), BY, ORDER, "f", width=DAY, min_runin=12 * HOUR)


@query("f12_onsets", sql=f"WITH {_ON} SELECT run_id, onset, healthy_runin FROM ons")
def _(t):
    return _onset_rows(t)


_LEAD = (12 * HOUR, 60 * HOUR)
_MATCH = _DEB + """, c AS (SELECT *, k >= 70 AS f FROM hr), g AS (SELECT *, sum(CAST(f AS INT)) OVER (PARTITION BY run_id ORDER BY us, event_id) - CAST(f AS INT) AS b FROM c),
o AS (SELECT run_id, b, max(us) FILTER (f) AS onset, min(us) FILTER (NOT f) AS since FROM g GROUP BY 1, 2), ons AS (SELECT run_id, onset, row_number() OVER (PARTITION BY run_id ORDER BY onset) AS i FROM o WHERE onset - since >= 43200000000),
ka AS (SELECT run_id, us FROM db WHERE keep),
mt AS (SELECT run_id, i, onset, (SELECT min(us) FROM ka WHERE ka.run_id = ons.run_id AND us BETWEEN onset - 216000000000 AND onset - 43200000000) AS alert,
  (SELECT min(us) FROM ka WHERE ka.run_id = ons.run_id AND us BETWEEN onset - 216000000000 AND onset - 43200000000) AS used FROM ons WHERE i = 1
 UNION ALL SELECT x.run_id, x.i, x.onset, x.a, coalesce(x.a, x.used) FROM (SELECT n.run_id, n.i, n.onset, m.used, (SELECT min(us) FROM ka WHERE ka.run_id = n.run_id AND us BETWEEN n.onset - 216000000000 AND n.onset - 43200000000 AND (m.used IS NULL OR us > m.used)) AS a
  FROM mt m JOIN ons n ON n.run_id = m.run_id AND n.i = m.i + 1) x)"""


def _matches(t):
    r = requests(t).withColumn("alert", F.col("latency_ms") > 20)
    alerts = Q.debounce(r, BY, "us", "alert", DAY, width=3 * DAY, carry=["event_id"]).withColumnRenamed("us", "alert")
    return Q.match_alerts(_onset_rows(t), alerts, BY, "onset", "alert", *_LEAD, width=3 * DAY), alerts, r


@query("d20_match_alerts", sql=f"""{_MATCH} SELECT run_id, onset::DOUBLE AS onset, alert::DOUBLE AS alert, alert IS NOT NULL AS detected, (onset - alert)::DOUBLE AS lead FROM mt""")
def _(t):
    return _matches(t)[0]


@query("e39_event_metrics", sql=f"""{_MATCH}, ha AS (SELECT ka.run_id, ka.us, NOT (r.k >= 70) AS healthy FROM db ka JOIN hr r ON r.event_id = ka.event_id WHERE keep),
hh AS (SELECT greatest(sum(s) / 3.6e9, 1e-9) AS hours FROM (SELECT max(us) - min(us) AS s FROM hr WHERE k < 70 GROUP BY run_id)),
fa AS (SELECT count(*) AS n FROM ha WHERE healthy AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.run_id = ha.run_id AND mt.alert = ha.us))
SELECT count(*) AS events, round(avg(CAST(alert IS NOT NULL AS DOUBLE)), 6) AS recall, round(1 - avg(CAST(alert IS NOT NULL AS DOUBLE)), 6) AS missed_rate, round((SELECT n FROM fa) / (SELECT hours FROM hh), 6) AS false_alarms_per_hour,
 round(count(alert) / greatest((SELECT count(*) FROM ha WHERE healthy), 1), 6) AS precision, round(quantile_cont((onset - alert) / 3.6e9, .5), 6) AS lead_median, round(quantile_cont((onset - alert) / 3.6e9, .75) - quantile_cont((onset - alert) / 3.6e9, .25), 6) AS lead_iqr,
 round((SELECT hours FROM hh), 6) AS healthy_hours, (SELECT count(*) FROM ha) AS alerts FROM mt""")
def _(t):
    m, alerts, r = _matches(t)
    flagged = alerts.join(r.select("event_id", (F.col("k") < 70).alias("healthy")), "event_id")
    m = m.withColumn("lead", F.col("lead") / HOUR)
    return rounded(Q.event_metrics(m, flagged, r.filter("k < 70"), BY, "us", "alert", "healthy", hours=float(HOUR)))


@query("f13_failure_streak", sql=f"""WITH {STATES}, s AS (SELECT *, row_number() OVER w AS rn FROM st WINDOW w AS ({W0})), x AS (SELECT *, coalesce(max(rn) FILTER (ok) OVER ({W0}), 0) AS lok FROM s),
y AS (SELECT *, rn - lok AS streak, CASE WHEN NOT ok AND k < 5 THEN 'node_not_ready' WHEN NOT ok THEN 'sentinel_unreachable' WHEN latency_ms > 100 THEN 'compute_latency_high' ELSE '' END AS sr FROM x)
SELECT event_id, streak, CASE WHEN sr = 'node_not_ready' THEN 'DOWN' WHEN sr = 'sentinel_unreachable' AND streak >= 2 THEN 'DOWN' WHEN sr <> '' THEN 'DEGRADED' ELSE 'UP' END AS state,
 CASE WHEN sr = 'sentinel_unreachable' AND streak >= 2 THEN 'sentinel_confirmed_outage' ELSE sr END AS reason, sr = 'sentinel_unreachable' AND streak < 2 AS transient FROM y""")
def _(t):
    bad = ~F.col("ok")
    r = Q.failure_streaks(requests(t).withColumn("bad", bad), BY, ORDER, "bad", "streak", width=DAY)
    sr = F.when(bad & (F.col("k") < 5), "node_not_ready").when(bad, "sentinel_unreachable").when(F.col("latency_ms") > 100, "compute_latency_high").otherwise("")
    ss = F.when(sr == "node_not_ready", "DOWN").when(sr != "", "DEGRADED").otherwise("UP")
    state, reason, transient = Q.confirmed(ss, sr, F.col("streak"), 2)
    return r.select("event_id", "streak", state.alias("state"), reason.alias("reason"), transient.alias("transient"))


_OUT = REQ + """, x AS (SELECT run_id % 3 AS grp, run_id AS inst, us / 3.6e9 AS x, NOT ok AS bad, CASE WHEN k < 50 THEN 'timeout' ELSE 'refused' END AS kind FROM req), b AS (SELECT grp, ceil(max(x)) AS last FROM x GROUP BY 1),
sv AS (SELECT grp, inst, unnest(range(CAST(ceil(x) AS BIGINT), CAST(floor(x + 4) AS BIGINT) + 1)) AS t FROM x WHERE bad),
cd AS (SELECT grp, t FROM sv GROUP BY 1, 2 HAVING count(DISTINCT inst) >= 7 AND count(*) >= 7), cl AS (SELECT cd.grp, t FROM cd JOIN b USING (grp) WHERE t <= last),
gp AS (SELECT *, lag(t) OVER (PARTITION BY grp ORDER BY t) AS p FROM cl), ig AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY t) AS no FROM gp),
wn AS (SELECT grp, CAST(no AS BIGINT) AS no, min(t) - 4 AS cs, max(t) AS ce FROM ig GROUP BY 1, 2)"""


def _outages(t):
    r = requests(t).select((F.col("run_id") % 3).alias("grp"), F.col("run_id").alias("inst"), (F.col("us") / 3.6e9).alias("x"), (~F.col("ok")).alias("bad"),
                           F.when(F.col("k") < 50, "timeout").otherwise("refused").alias("kind"))
    return r, Q.outages(r, ["grp"], "x", "inst", "bad", width=48, window=5, min_instances=7, min_failures=7, merge_gap=5, buffer=10, kind="kind")


@query("f15_outages", sql=f"""WITH {_OUT} SELECT wn.grp, no AS outage_no, cs AS core_start, ce AS core_end, count(DISTINCT inst) AS failed_instances, count(*) AS failure_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS failure_types,
 cs - 10 AS expanded_start, ce + 10 AS expanded_end, ce - cs AS duration FROM wn JOIN x ON x.grp = wn.grp AND bad AND x BETWEEN cs AND ce GROUP BY ALL""")
def _(t):
    return _outages(t)[1]


@query("f15_sample_labels", sql=f"""WITH {_OUT}, q AS (SELECT event_id, run_id % 3 AS grp, us / 3.6e9 AS x, ok, latency_ms FROM req),
m AS (SELECT event_id, max(no) AS outage_no, max_by(CASE WHEN x BETWEEN cs AND ce THEN 'service_unreachable' ELSE 'outage_buffer' END, no) AS lab FROM q JOIN wn ON q.grp = wn.grp AND x BETWEEN cs - 10 AND ce + 10 GROUP BY 1),
l AS (SELECT q.*, outage_no, coalesce(lab, 'reachable') AS st FROM q LEFT JOIN m USING (event_id))
SELECT event_id, outage_no, st AS label, CASE WHEN st = 'outage_buffer' THEN 'outage_buffer' WHEN st = 'service_unreachable' THEN CASE WHEN ok THEN 'success_inside_unreachable_window' ELSE 'failed_service_unreachable' END
 WHEN NOT ok THEN 'isolated_request_failure' WHEN latency_ms > 80 THEN 'latency_degraded' ELSE 'clean_success' END AS sample_label FROM l""")
def _(t):
    _, win = _outages(t)
    pts = requests(t).select("event_id", (F.col("run_id") % 3).alias("grp"), (F.col("us") / 3.6e9).alias("x"), "ok", "latency_ms")
    lab = A.label_windows(pts, win, "x", ["grp"], order="outage_no", core=("core_start", "core_end"), buffer=10, bucket=48)
    sample = F.when(F.col("label") == "outage_buffer", "outage_buffer") \
        .when((F.col("label") == "service_unreachable") & F.col("ok"), "success_inside_unreachable_window") \
        .when(F.col("label") == "service_unreachable", "failed_service_unreachable").when(~F.col("ok"), "isolated_request_failure") \
        .when(F.col("latency_ms") > 80, "latency_degraded").otherwise("clean_success")
    return lab.select("event_id", "outage_no", "label", sample.alias("sample_label"))


@query("f16_clean_segments", sql=f"""WITH {_OUT}, r AS (SELECT grp, min(x) AS a, max(x) AS z FROM x GROUP BY 1), e AS (SELECT grp, cs - 10 AS s, ce + 10 AS e FROM wn),
h AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e), i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY s, e) AS g FROM h),
mg AS (SELECT grp, g, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2), gaps AS (SELECT grp, s, lag(e) OVER (PARTITION BY grp ORDER BY s) AS pe FROM mg),
seg AS (SELECT grp, greatest(a, coalesce(pe, a)) AS ss, s::DOUBLE AS se FROM gaps JOIN r USING (grp) UNION ALL SELECT r.grp, greatest(a, coalesce((SELECT max(e) FROM mg WHERE mg.grp = r.grp), a)), z FROM r)
SELECT grp, round(ss, 6) AS segment_start, round(se, 6) AS segment_end, round(se - ss, 6) AS duration, row_number() OVER (PARTITION BY grp ORDER BY ss) AS segment_no FROM seg WHERE se - ss > 0 AND se - ss >= 12""")
def _(t):
    r, win = _outages(t)
    return rounded(Q.clean_segments(r, win, ["grp"], "x", "expanded_start", "expanded_end", width=48, min_length=12))


_GAP = HR + ", gp AS (SELECT event_id, run_id, us, CASE WHEN k >= 60 THEN latency_ms END AS v FROM hr)"


@query("f17_interpolate", sql=f"""WITH {_GAP}, p AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS bv, last_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER b AS bt, first_value(v IGNORE NULLS) OVER a AS av,
 first_value(CASE WHEN v IS NOT NULL THEN us END IGNORE NULLS) OVER a AS aft FROM gp WINDOW b AS ({W0} ROWS UNBOUNDED PRECEDING), a AS ({W0} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN bv IS NULL THEN av WHEN av IS NULL OR aft = bt THEN bv ELSE bv + (av - bv) * (us - bt) / (aft - bt) END, 6) AS v FROM p""")
def _(t):
    r = requests(t).withColumn("v", F.when(F.col("k") >= 60, F.col("latency_ms")))
    return rounded(Q.interpolate(r, BY, ORDER, ["v"], width=DAY).select("event_id", "v"))


@query("f17_forward_back_fill", sql="""WITH c AS (SELECT conv_id, turn, CASE WHEN length(text) > 150 THEN length(text) END AS v FROM conversations)
SELECT conv_id, turn, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), first_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM c""")
def _(t):
    c = t.conversations.withColumn("v", F.when(F.length("text") > 150, F.length("text").cast("bigint")))
    return Q.filled(c, ["conv_id"], ["turn"], ["v"], width=1024).select("conv_id", "turn", "v")


@query("f18_centred_median", sql=f"""WITH {HR}, s AS (SELECT event_id, list_sort(list(latency_ms) OVER ({W0} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS v FROM hr)
SELECT event_id, v[len(v) // 2 + 1] AS upper_med, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) AS true_med FROM s""")
def _(t):
    a = Q.centred_median(requests(t), BY, ORDER, "latency_ms", "upper_med", 7, width=DAY, upper=True, block=SMALL)
    return rounded(Q.centred_median(a, BY, ORDER, "latency_ms", "true_med", 6, width=DAY, block=SMALL).select("event_id", "upper_med", "true_med"))


@query("f19_counter_difference", sql=f"WITH {HR} SELECT event_id, CASE WHEN lag(k) OVER w IS NOT NULL THEN greatest(k - lag(k) OVER w, 0) END AS d FROM hr WINDOW w AS ({W0})")
def _(t):
    return Q.counter_difference(requests(t), BY, ORDER, "k", "d", width=DAY).select("event_id", "d")


_LAGS = (-10, -5, 0, 5, 10)
_PAIRS = HR + """, pr AS (SELECT a.run_id, l.lag, a.latency_ms AS x, b.k AS y FROM hr a CROSS JOIN (SELECT unnest([-10, -5, 0, 5, 10]) AS lag) l JOIN hr b ON a.run_id = b.run_id AND b.rn = a.rn + l.lag),
rk AS (SELECT run_id, lag, rank() OVER (PARTITION BY run_id, lag ORDER BY x) + (count(*) OVER (PARTITION BY run_id, lag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY run_id, lag ORDER BY y) + (count(*) OVER (PARTITION BY run_id, lag, y) - 1) / 2.0 AS ry, x, y FROM pr)"""


@query("f20_lag_scan_spearman", sql=f"""WITH {_PAIRS}, c AS (SELECT run_id, lag, CASE WHEN count(*) >= 50 THEN corr(rx, ry) END AS c FROM rk GROUP BY 1, 2) SELECT lag, count(c) AS cycles, {_q('c', .5)} AS median_corr FROM c GROUP BY 1""")
def _(t):
    scan = Q.lag_scan(requests(t), BY, ORDER, "latency_ms", "k", _LAGS, width=DAY, min_pairs=50, block=SMALL)
    return rounded(Q.lag_summary(scan))


@query("f21_lag_scan_pearson", sql=f"WITH {_PAIRS} SELECT run_id, lag, count(*) AS pairs, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 6) AS corr FROM rk GROUP BY 1, 2")
def _(t):
    return rounded(Q.lag_scan(requests(t), BY, ORDER, "latency_ms", "k", _LAGS, width=DAY, method="pearson", min_pairs=3, block=SMALL))


@query("f22_inter_arrival", sql=f"WITH {HR}, d AS (SELECT run_id, (us - lag(us) OVER ({W0})) / 1e6 AS g FROM hr) SELECT run_id, {_q('g', .5, d=8)} AS median_interval FROM d GROUP BY 1")
def _(t):
    return rounded(Q.intervals(requests(t), BY, ORDER, width=DAY, unit=1e6), 8)


_BL = HR + """, bn AS (SELECT run_id, count(*) FILTER (event_type = 'view') AS c, quantile_cont(latency_ms, .5) FILTER (event_type = 'view') AS a, quantile_cont(latency_ms, .5) FILTER (rn <= 30) AS b FROM hr GROUP BY 1)"""


@query("f23_baseline_delta", sql=f"""WITH {_BL}, x AS (SELECT *, CASE WHEN c >= 14 THEN a ELSE b END AS bl FROM hr JOIN bn USING (run_id)) SELECT event_id, round(bl, 6) AS latency_ms_baseline, round(latency_ms - bl, 6) AS latency_ms_delta,
 round(CASE WHEN abs(bl) > 1e-9 THEN latency_ms / bl END, 6) AS latency_ms_ratio FROM x""")
def _(t):
    out = Q.baseline_delta(requests(t), BY, ORDER, ["latency_ms"], F.col("event_type") == "view", width=DAY, min_rows=14, fallback_rows=30)
    return rounded(out.select("event_id", "latency_ms_baseline", "latency_ms_delta", "latency_ms_ratio"))


@query("f24_drop_from_baseline", sql=f"""WITH {HR}, s AS (SELECT run_id, count(*) FILTER (event_type = 'view') AS c, quantile_cont(latency_ms, .5) FILTER (event_type = 'view') AS m, list_sort(list(latency_ms)) AS v, CAST(greatest(1, ceil(count(*) * 0.1)) AS BIGINT) AS k FROM hr GROUP BY 1),
b AS (SELECT run_id, CASE WHEN c >= 14 AND m > 0 THEN m ELSE list_aggregate(v[len(v) - s.k + 1:], 'quantile_cont', 0.5) END AS bl FROM s)
SELECT event_id, round(greatest((bl - latency_ms) / bl * 100.0, 0), 6) AS drop_pct FROM hr JOIN b USING (run_id)""")
def _(t):
    out = Q.drop_from_baseline(requests(t), BY, "latency_ms", F.col("event_type") == "view", "drop_pct", min_rows=14)
    return rounded(out.select("event_id", "drop_pct"))


def _cycle(t):
    """Per run: temperature k + 20, clock 100 - k, latency; normal rows are the first third of the month."""
    return requests(t).withColumn("t", ((F.col("us") - 1704067200000000) / HOUR)).withColumn("temp", F.col("k") + 20.0) \
        .withColumn("clock", 100.0 - F.col("k"))


@query("f25_event_timing", sql=f"""WITH {HR}, y AS (SELECT run_id, event_id, (us - 1704067200000000) / 3.6e9 AS t, k + 20.0::DOUBLE AS temp, 100.0::DOUBLE - k AS clock, latency_ms AS l, (us - 1704067200000000) / 3.6e9 < 240 AS nm, rn FROM hr),
nc AS (SELECT run_id, count(*) FILTER (nm) >= 20 AS e FROM y GROUP BY 1), b0 AS (SELECT run_id, quantile_cont(l, .5) FILTER (CASE WHEN e THEN nm ELSE rn <= 25 END) AS med, quantile_cont(l, .95) FILTER (CASE WHEN e THEN nm ELSE rn <= 25 END) AS p95,
 quantile_cont(temp, .5) FILTER (nm) AS bt, quantile_cont(clock, .5) FILTER (nm) AS bc FROM y JOIN nc USING (run_id) GROUP BY 1),
m0 AS (SELECT run_id, quantile_cont(abs(l - med), .5) FILTER (CASE WHEN e THEN nm ELSE rn <= 25 END) AS mad FROM y JOIN nc USING (run_id) JOIN b0 USING (run_id) GROUP BY 1),
f AS (SELECT run_id, med, bt, bc, greatest(p95, med + 3 * CASE WHEN mad > 0 THEN mad ELSE greatest(1.0, med * 0.05) END, med * 1.25) AS th FROM b0 JOIN m0 USING (run_id)),
z AS (SELECT y.*, f.*, sum(CAST(temp >= bt + 5 AS INT)) OVER w AS c1, sum(CAST(clock <= bc * 0.8 AS INT)) OVER w AS c2, sum(CAST(l >= th AS INT)) OVER w AS c3 FROM y JOIN f USING (run_id) WINDOW w AS (PARTITION BY y.run_id ORDER BY t, event_id ROWS 1 PRECEDING)),
a AS (SELECT y.*, sum(CAST(temp <= bt + 2 AS INT)) OVER w AS c1, sum(CAST(clock >= bc * 0.9 AS INT)) OVER w AS c2, sum(CAST(l <= th AS INT)) OVER w AS c3 FROM y JOIN f USING (run_id) WHERE t >= 480 WINDOW w AS (PARTITION BY y.run_id ORDER BY t, event_id ROWS 1 PRECEDING)),
o1 AS (SELECT run_id, min(t) FILTER (c1 >= 2) - 1 AS x1, min(t) FILTER (c2 >= 2) - 1 AS x2, min(t) FILTER (c3 >= 2) - 1 AS x3 FROM z GROUP BY 1), o2 AS (SELECT run_id, min(t) FILTER (c1 >= 2) - 1 AS r1, min(t) FILTER (c2 >= 2) - 1 AS r2, min(t) FILTER (c3 >= 2) - 1 AS r3 FROM a GROUP BY 1)
SELECT run_id, round(med, 6) AS baseline_latency, round(th, 6) AS latency_threshold, round(bt, 6) AS baseline_temp, round(bc, 6) AS baseline_clock, round(x1, 6) AS temp_onset, round(x2, 6) AS clock_onset, round(x3, 6) AS latency_onset, round(r1, 6) AS temp_recovered,
 round(r3, 6) AS latency_recovered, round(x1 - 240, 6) AS temp_after_fault, round(x2 - x1, 6) AS clock_after_temp, round(r1 - 480, 6) AS temp_recovery FROM f LEFT JOIN o1 USING (run_id) LEFT JOIN o2 USING (run_id)""")
def _(t):
    rows = _cycle(t)
    events = rows.select("run_id").distinct().select("run_id", F.lit(240.0).alias("fault_start"), F.lit(480.0).alias("recovery_start"))
    out = Q.event_timing(rows, events, BY, ["t", "event_id"], "temp", "clock", "latency_ms", F.col("t") < 240, "recovery_start", width=48, k=2, fallback_rows=25, min_rows=20, )
    return rounded(out.select("run_id", "baseline_latency", "latency_threshold", "baseline_temp", "baseline_clock", "temp_onset", "clock_onset", "latency_onset",
                              "temp_recovered", "latency_recovered", "temp_after_fault", "clock_after_temp", "temp_recovery"))


@query("f26_live_baseline", sql=f"""WITH {HR}, nb AS (SELECT *, row_number() OVER ({W0}) AS nr FROM hr WHERE event_type = 'view'), b AS (SELECT run_id, avg(k) AS bt, avg(latency_ms) AS bc FROM nb WHERE nr <= 10 GROUP BY 1)
SELECT event_id, round(bt, 6) AS baseline_temp, round(bc, 6) AS baseline_clock, round(k - bt, 6) AS delta_temp, round(latency_ms - bc, 6) AS delta_clock, latency_ms - bc <= -150 AS clock_drop_observed,
 ok AND k - bt <= 2 AND latency_ms - bc >= -100 AS recovery_stable FROM hr JOIN b USING (run_id)""")
def _(t):
    out = Q.live_baseline(requests(t), BY, ORDER, F.col("event_type") == "view", "k", "latency_ms", F.col("ok"), width=DAY, rows=10)
    return rounded(out.select("event_id", "baseline_temp", "baseline_clock", "delta_temp", "delta_clock", "clock_drop_observed", "recovery_stable"))


@query("f27_annotate_events", sql=f"""WITH {HR} SELECT run_id, us, event_type AS event, 'info' AS level, 'Phase ' || event_type || ' entered' AS message FROM hr WHERE event_type = 'signup'
UNION ALL SELECT run_id, min_by(us, (us, event_id)), 'temp_threshold', 'critical', 'first temp_threshold' FROM hr WHERE k >= 90 GROUP BY 1 UNION ALL SELECT run_id, min_by(us, (us, event_id)), 'latency_spike', 'warn', 'first latency_spike' FROM hr WHERE latency_ms >= 150 GROUP BY 1""")
def _(t):
    r = requests(t)
    ev = r.filter("event_type = 'signup'").withColumn("event", F.col("event_type"))
    return Q.annotate_events(ev, r, BY, ORDER, F.concat(F.lit("Phase "), "event", F.lit(" entered")),
                             [("temp_threshold", "critical", F.col("k") >= 90), ("latency_spike", "warn", F.col("latency_ms") >= 150)])


@query("f28_thin_out", sql=f"WITH {HR}, s AS (SELECT *, CASE WHEN n <= 20 THEN 1 ELSE greatest(n // 20, 1) END AS st FROM hr) SELECT run_id, us, event_id FROM s WHERE (rn - 1) % st = 0 OR rn = n")
def _(t):
    return Q.thin_out(requests(t).select("run_id", "us", "event_id"), BY, ORDER, width=DAY, points=20)


@query("f29_phase_windows", sql=f"""WITH r AS (SELECT run_id, min(us) / 1e6 AS s, max(us) / 1e6 AS e, CASE WHEN run_id % 3 <> 0 THEN max(us) FILTER (ok) / 1e6 END AS re, run_id % 2 = 0 AS ram FROM ({'SELECT user_id AS run_id, epoch_us(ts) AS us, event_type <> ' + chr(39) + 'error' + chr(39) + ' AS ok FROM events'}) GROUP BY run_id),
p AS (SELECT *, e - s AS tot, coalesce(re - s, e - s) AS rem FROM r), q AS (SELECT *, least(rem, 1500000) AS le FROM p), z AS (SELECT *, CASE WHEN ram THEN least(300000, le) ELSE least(300000, rem) END AS we, CASE WHEN ram THEN le ELSE rem END AS ste FROM q)
SELECT run_id, 'warm-up' AS phase, 0.0::DOUBLE AS start_s, round(we, 3) AS end_s FROM z UNION ALL SELECT run_id, 'steady-state', round(we, 3), round(ste, 3) FROM z WHERE ste > we UNION ALL SELECT run_id, 'steady-state', round(le, 3), round(rem, 3) FROM z WHERE ram AND rem > le
UNION ALL SELECT run_id, 'cooldown', round(rem, 3), round(tot, 3) FROM z WHERE tot > rem""")
def _(t):
    r = requests(t).groupBy("run_id").agg((F.min("us") / 1e6).alias("s"), (F.max("us") / 1e6).alias("e"), (F.max(F.when(F.col("ok"), F.col("us"))) / 1e6).alias("re"))
    re = F.when(F.col("run_id") % 3 != 0, F.col("re"))
    out = Q.phase_windows(r, F.col("s"), F.col("e"), re, F.lit(300000.0), F.when(F.col("run_id") % 2 == 0, "ram_bound").otherwise("cpu_bound"), F.lit(1500000.0))
    return rounded(out.select("run_id", "phase", "start_s", "end_s"), 3)


@query("f29_boundary_times", sql="""SELECT o_orderkey, epoch(o_orderdate) AS warmup_start, epoch(o_orderdate) + 120 AS measurement_start, epoch(o_orderdate) + 120 + o_totalprice AS measurement_end, epoch(o_orderdate) + 120 + o_totalprice + 60 AS client_stop FROM orders""".replace("o_totalprice", "floor(o_totalprice)"))
def _(t):
    b = Q.boundary_times(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6, F.lit(120.0), F.floor("o_totalprice"), F.lit(60.0))
    return t.orders.select("o_orderkey", *[b[n].alias(n) for n in ("warmup_start", "measurement_start", "measurement_end", "client_stop")])
