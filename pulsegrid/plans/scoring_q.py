"""Model and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.times import DAY, HOUR
from pulsegrid.operators import boosting as B, scoring as M, sequence as Q
from pulsegrid.operators.keys import join_on
from pulsegrid.operators.ordered import framed

from .registry import query, rounded
from .sequences import BY, HR, ORDER, SMALL, W0
from .summaries import _q
from .views import REQ, requests


@query("m01_chronological_split", sql=f"""WITH {REQ}, r AS (SELECT run_id, min(us) AS s FROM req GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY s, run_id) AS rn, count(*) OVER () AS n FROM r)
SELECT run_id, rn > n - greatest(ceil(n * 0.2), 1) AS is_test FROM n""")
def _(t):
    return M.chronological_split(requests(t), "run_id", "us", width=HOUR)


@query("m02_folds", sql=f"""WITH {REQ} SELECT DISTINCT 'leave_one_run_out' AS split, CAST(run_id AS VARCHAR) AS fold, run_id FROM req UNION ALL
 SELECT DISTINCT 'leave_one_replicate_per_load_level_out', 'replicate_' || run_id % 4, run_id FROM req""")
def _(t):
    return M.folds(requests(t).withColumn("replicate", F.col("run_id") % 4), "run_id", "replicate")


@query("m02_group_folds", sql=f"""WITH {REQ}, r AS (SELECT DISTINCT run_id FROM req), n AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS rn, count(*) OVER () AS n FROM r) SELECT (n - rn) % 5 + 1 AS fold, run_id FROM n""")
def _(t):
    return M.group_folds(requests(t), "run_id", 5, width=64)


TARGETS = ["l_extendedprice", "l_tax"]


def _fold_rows(t, keys=()):
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"))
    li = li.withColumn("h", F.col("l_suppkey") % 4)
    tests = M.folds(li, "l_suppkey", "h", per_run=False).select("fold", "l_suppkey")
    return M.with_folds(li, tests, "l_suppkey", keys=keys)


_FOLD = """li AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax FROM lineitem),
fr AS (SELECT 'replicate_' || h AS fold, l_suppkey % 4 = h AS is_test, li.* FROM li, range(4) t(h)),
lg AS (SELECT fold, is_test, l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, 'l_extendedprice' AS target, l_extendedprice AS observed FROM fr UNION ALL SELECT fold, is_test, l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, 'l_tax', l_tax FROM fr),
md AS (SELECT fold, target, regr_intercept(observed, l_quantity) AS b0, regr_slope(observed, l_quantity) AS b1, count(observed) AS n FROM lg WHERE NOT is_test GROUP BY 1, 2),
rs AS (SELECT lg.*, b0 + b1 * l_quantity AS expected, observed - (b0 + b1 * l_quantity) AS residual FROM lg JOIN md USING (fold, target)),
th0 AS (SELECT fold, target, quantile_cont(abs(residual), .99) AS threshold, quantile_cont(residual, .5) AS center FROM rs WHERE NOT is_test GROUP BY 1, 2),
th AS (SELECT fold, target, any_value(threshold) AS threshold, any_value(center) AS center, CASE WHEN quantile_cont(abs(residual - center), .5) * 1.4826 > 1e-9 THEN quantile_cont(abs(residual - center), .5) * 1.4826 ELSE 1.0 END AS scale FROM rs JOIN th0 USING (fold, target) WHERE NOT is_test GROUP BY 1, 2),
sc AS (SELECT rs.*, threshold, center, scale, coalesce(abs(residual) > threshold, false) AS exceeds, (residual - center) / scale AS z FROM rs JOIN th USING (fold, target))"""
KEYS = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"]


def _scored(t, keys=()):
    """Scored timeline, limits and models; with ``keys`` the timeline is dealt by these for groupings by fold and row."""
    rows = _fold_rows(t)
    models = M.cut(M.expected_behaviour(rows, ["l_quantity"], TARGETS))
    long = M.residuals(rows, models, ["l_quantity"], TARGETS, KEYS)
    limits = M.cut(M.residual_thresholds(long))
    if keys:
        long = M.residuals(_fold_rows(t, keys), models, ["l_quantity"], TARGETS, KEYS)
    return M.score_residuals(long, limits), limits, models


@query("m03_expected_behaviour", sql=f"WITH {_FOLD} SELECT fold, target, round(b0, 6) AS intercept, round(b1, 6) AS slope, n AS train_rows, 'linear' AS model_type FROM md")
def _(t):
    out = M.expected_behaviour(_fold_rows(t), ["l_quantity"], TARGETS)
    return rounded(out.select("fold", "target", "intercept", F.col("coefficients")[0].alias("slope"), "train_rows", "model_type"))


@query("m03_expected_behaviour_wide", sql=f"""WITH {_FOLD.replace("l_linenumber, l_partkey, l_quantity,", "l_linenumber, l_partkey, l_quantity, l_discount,")}, c AS (SELECT fold, target, count(observed) AS n, avg(observed) AS y, avg(l_quantity) FILTER (observed IS NOT NULL) AS x1, avg(l_discount) FILTER (observed IS NOT NULL) AS x2,
 var_pop(l_quantity) FILTER (observed IS NOT NULL) AS s11, var_pop(l_discount) FILTER (observed IS NOT NULL) AS s22, covar_pop(l_quantity, l_discount) FILTER (observed IS NOT NULL) AS s12, covar_pop(l_quantity, observed) AS s1, covar_pop(l_discount, observed) AS s2 FROM lg WHERE NOT is_test GROUP BY 1, 2),
b AS (SELECT *, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c)
SELECT fold, target, round(y - b1 * x1 - b2 * x2, 4) AS intercept, round(b1, 4) AS quantity, round(b2, 4) AS discount, n AS train_rows FROM b""")
def _(t):
    out = M.expected_behaviour(_fold_rows(t), ["l_quantity", "l_discount"], TARGETS)
    return rounded(out.select("fold", "target", "intercept", F.col("coefficients")[0].alias("quantity"), F.col("coefficients")[1].alias("discount"), "train_rows"), 4)


@query("m04_residual_thresholds", sql=f"WITH {_FOLD} SELECT fold, target, round(threshold, 6) AS threshold, round(center, 6) AS center, round(scale, 6) AS scale FROM th")
def _(t):
    return rounded(_scored(t)[1])


@query("m04_residual_scores", sql=f"""WITH {_FOLD} SELECT fold, target, is_test, count(*) AS rows, count(residual) AS valid_rows, count(*) FILTER (exceeds) AS exceedances, round(avg(abs(residual)), 4) AS mae, round(avg(abs(z)), 4) AS mean_abs_z FROM sc GROUP BY 1, 2, 3""")
def _(t):
    sc = _scored(t)[0]
    out = sc.groupBy("fold", "target", "is_test").agg(F.count(F.lit(1)).alias("rows"), F.count("residual").alias("valid_rows"), M.n_if("exceeds").alias("exceedances"),
                                                      F.round(F.avg(F.abs("residual")), 4).alias("mae"), F.round(F.avg(F.abs("z")), 4).alias("mean_abs_z"))
    return out


_RISK = _FOLD + """, rk AS (SELECT fold, is_test, l_suppkey, l_orderkey, l_linenumber, l_partkey, avg(abs(z)) AS risk FROM sc GROUP BY ALL), rt AS (SELECT fold, quantile_cont(risk, .99) AS lim FROM rk WHERE NOT is_test GROUP BY 1)"""


@query("m04_composite_risk", sql=f"WITH {_RISK} SELECT fold, is_test, count(*) AS rows, round(max(lim), 6) AS risk_threshold, count(*) FILTER (risk > lim) AS exceedances, round(avg(risk), 6) AS mean_risk FROM rk JOIN rt USING (fold) GROUP BY 1, 2")
def _(t):
    risk = M.composite_risk(_scored(t, KEYS)[0], KEYS)
    return rounded(risk.groupBy("fold", "is_test").agg(F.count(F.lit(1)).alias("rows"), F.max("risk_threshold").alias("risk_threshold"),
                                                       M.n_if("risk_exceeds").alias("exceedances"), F.avg("risk").alias("mean_risk")))


@query("m05_recalibrate", sql=f"""WITH {_FOLD}, st AS (SELECT fold, l_suppkey, min(l_orderkey) AS t0 FROM sc GROUP BY 1, 2), of AS (SELECT fold, l_suppkey, quantile_cont(residual, .5) AS o FROM sc JOIN st USING (fold, l_suppkey) WHERE target = 'l_extendedprice' AND l_orderkey < t0 + 500 AND residual IS NOT NULL GROUP BY 1, 2),
rc AS (SELECT sc.*, t0, CASE WHEN target = 'l_extendedprice' THEN coalesce(o, 0) ELSE 0 END AS off FROM sc JOIN st USING (fold, l_suppkey) LEFT JOIN of USING (fold, l_suppkey) WHERE is_test)
SELECT fold, l_suppkey, target, count(*) AS rows, round(max(off), 6) AS "offset", count(*) FILTER (abs(residual - off) > threshold) AS exceedances, count(*) FILTER (l_orderkey >= t0 + 500) AS post_rows, round(avg(abs((residual - off - center) / scale)), 6) AS mean_z FROM rc GROUP BY 1, 2, 3""")
def _(t):
    sc = _scored(t)[0].filter("is_test")
    rc = M.recalibrate(sc, "l_orderkey", "l_suppkey", 500, ["l_extendedprice"])
    return rounded(rc.groupBy("fold", "l_suppkey", "target").agg(
        F.count(F.lit(1)).alias("rows"), F.max("offset").alias("offset"), M.n_if("normalized_exceeds").alias("exceedances"),
        M.n_if("post_calibration").alias("post_rows"), F.avg(F.abs("normalized_z")).alias("mean_z")))


@query("m05_recalibrated_risk", sql=f"""WITH {_RISK}, st AS (SELECT fold, l_suppkey, min(l_orderkey) AS t0 FROM sc GROUP BY 1, 2), of AS (SELECT fold, l_suppkey, quantile_cont(residual, .5) AS o FROM sc JOIN st USING (fold, l_suppkey) WHERE target = 'l_extendedprice' AND l_orderkey < t0 + 500 AND residual IS NOT NULL GROUP BY 1, 2),
rc AS (SELECT fold, l_suppkey, l_orderkey, l_linenumber, l_partkey, avg(abs((residual - CASE WHEN target = 'l_extendedprice' THEN coalesce(o, 0) ELSE 0 END - center) / scale)) AS risk, bool_and(l_orderkey >= t0 + 500) AS post FROM sc JOIN st USING (fold, l_suppkey) LEFT JOIN of USING (fold, l_suppkey) WHERE is_test GROUP BY ALL)
SELECT fold, count(*) AS rows, count(*) FILTER (post) AS post_rows, count(*) FILTER (post AND risk > lim) AS exceedances, round(avg(risk), 6) AS mean_risk FROM rc JOIN rt USING (fold) GROUP BY 1""")
def _(t):
    sc = _scored(t, KEYS)[0]
    limits = M.cut(M.composite_risk(sc, KEYS).select("fold", "risk_threshold").distinct())
    rc = M.recalibrate(sc.filter("is_test"), "l_orderkey", "l_suppkey", 500, ["l_extendedprice"])
    out = M.recalibrated_risk(rc, KEYS, limits)
    return rounded(out.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), M.n_if("post_calibration").alias("post_rows"),
                                           M.n_if(F.col("post_calibration") & F.col("risk_exceeds")).alias("exceedances"), F.avg("risk").alias("mean_risk")))


TRAIN = """sp0 AS (SELECT run_id, min(us) AS s FROM req GROUP BY 1), sp1 AS (SELECT run_id, row_number() OVER (ORDER BY s, run_id) AS rn, count(*) OVER () AS n FROM sp0),
sp AS (SELECT run_id FROM sp1 WHERE rn <= n - greatest(ceil(n * 0.2), 1))"""


def _split(t):
    return M.chronological_split(requests(t), "run_id", "us", width=HOUR)


@query("m06_residual_anomalies", sql=f"""WITH {REQ}, {TRAIN}, x AS (SELECT *, latency_ms - 35 AS res, run_id IN (SELECT run_id FROM sp) AS tr FROM req), m AS (SELECT quantile_cont(res, .5) AS med, quantile_cont(res, .99) AS q99 FROM x WHERE tr AND event_type = 'view'),
d AS (SELECT greatest(abs(any_value(q99)), abs(any_value(med)) + 6 * quantile_cont(abs(res - med), .5)) AS th FROM x, m WHERE tr AND event_type = 'view')
SELECT event_type, count(*) AS rows, round(max(th), 6) AS threshold, round(avg(CAST(abs(res) > th AS DOUBLE)), 6) AS anomaly_rate, {_q('res', .5)} AS residual_median, {_q('abs(res)', .95)} AS abs_residual_p95 FROM x, d WHERE NOT tr GROUP BY 1""")
def _(t):
    r = join_on(requests(t).withColumn("res", F.col("latency_ms") - 35), _split(t), ["run_id"])
    return rounded(M.residual_anomalies(r, "res", F.col("event_type") == "view", ~F.col("is_test"), "event_type"))


_GRID = REQ + ", " + TRAIN + """, gr AS (SELECT run_id, us // 86400000000 AS d, quantile_cont(latency_ms, .5) AS lat, avg(CAST(ok AS DOUBLE)) AS sr, avg(CAST(NOT ok AS DOUBLE)) AS fr, avg(CAST(NOT ok AND k < 30 AS DOUBLE)) AS tr FROM req GROUP BY 1, 2),
st AS (SELECT *, sr >= 0.99 AND fr <= 0.01 AND tr <= 0.01 AS strict FROM gr WHERE run_id IN (SELECT run_id FROM sp)), hs AS (SELECT * FROM st WHERE strict OR (SELECT count(*) FILTER (strict) FROM st) < 300),
b AS (SELECT count(*) AS n, quantile_cont(lat, .5) AS lm, quantile_cont(lat, .99) AS l99, quantile_cont(sr, .01) AS s01, quantile_cont(fr, .5) AS fm, quantile_cont(fr, .99) AS f99, quantile_cont(tr, .5) AS tm, quantile_cont(tr, .99) AS t99 FROM hs),
dv AS (SELECT quantile_cont(abs(lat - lm), .5) AS ld, quantile_cont(abs(fr - fm), .5) AS fd, quantile_cont(abs(tr - tm), .5) AS td FROM hs, b),
th AS (SELECT n AS stable_rows, greatest(l99, lm + 6 * CASE WHEN ld > 0 THEN ld ELSE 5 END, lm + 50) AS latency_threshold, least(0.95::DOUBLE, greatest(0, s01 - 0.05)) AS success_low,
 least(1, greatest(0.2::DOUBLE, f99, fm + 6 * CASE WHEN fd > 0 THEN fd ELSE 0.01 END)) AS fail_high, least(1, greatest(0.2::DOUBLE, t99, tm + 6 * CASE WHEN td > 0 THEN td ELSE 0.01 END)) AS timeout_high FROM b, dv),
dg AS (SELECT gr.*, coalesce(lat >= latency_threshold, false) OR sr <= success_low OR fr >= fail_high OR tr >= timeout_high AS degraded FROM gr, th)"""


def _service(t, step=DAY):
    """Service grid per run, daily unless ``step`` says otherwise; ``d`` counts the steps."""
    from pulsegrid.operators.quantiles import summarise
    r = requests(t).withColumn("d", F.floor(F.col("us") / step))
    return M.cut(summarise(r, ["run_id", "d"], {
        "sr": F.avg(F.col("ok").cast("double")), "fr": F.avg((~F.col("ok")).cast("double")), "tr": F.avg((~F.col("ok") & (F.col("k") < 30)).cast("double")),
        "load": F.count(F.lit(1)).cast("double"), "temp": F.avg("k"), "errors": F.sum((~F.col("ok")).cast("double"))}, {"lat": ("latency_ms", .5)}))


@query("m07_composite_thresholds", sql=f"WITH {_GRID} SELECT stable_rows, round(latency_threshold, 6) AS latency_threshold, round(success_low, 6) AS success_low, round(fail_high, 6) AS fail_high, round(timeout_high, 6) AS timeout_high FROM th")
def _(t):
    rows = join_on(_service(t), _split(t), ["run_id"])
    return rounded(M.composite_thresholds(rows.filter("NOT is_test"), "lat", "sr", "fr", "tr"))


@query("m07_degraded_now", sql=f"WITH {_GRID} SELECT run_id, d, degraded FROM dg")
def _(t):
    g = join_on(_service(t), _split(t), ["run_id"])
    return M.degraded_now(g, M.composite_thresholds(g.filter("NOT is_test"), "lat", "sr", "fr", "tr"), "lat", "sr", "fr", "tr").select("run_id", "d", "degraded")


@query("m08_forecast_baselines", sql=f"""WITH {HR}, f AS (SELECT lead(latency_ms, 3) OVER w AS y, latency_ms AS p, CASE WHEN count(*) OVER r >= 5 THEN quantile_cont(latency_ms, .5) OVER r END AS m FROM hr WINDOW w AS ({W0}), r AS ({W0} ROWS 14 PRECEDING)),
u AS (SELECT 'persistence' AS model, y, p FROM f UNION ALL SELECT 'rolling_median', y, m FROM f), v AS (SELECT * FROM u WHERE y IS NOT NULL AND p IS NOT NULL)
SELECT model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(y - p), 6) AS bias, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM v GROUP BY 1""")
def _(t):
    f = Q.forecast_frame(requests(t), BY, ORDER, "latency_ms", 3, width=DAY, block=SMALL)
    return rounded(M.evaluate_forecasts(f, [], "future", {"persistence": "persistence", "rolling_median": "rolling_median"}))


def _forecast_rows(t):
    rows = Q.lags_and_slopes(_service(t), BY, ["d"], "lat", [1, 2, 5], [5], width=8, block=SMALL)
    rows = Q.forecast_frame(rows, BY, ["d"], "lat", 2, width=8, block=SMALL)
    rows = Q.exponential_mean(rows, BY, ["d"], "lat", "ewma", 15, width=8)
    split = M.chronological_split(requests(t), "run_id", "us", width=HOUR)
    return M.cut(join_on(rows, split, ["run_id"]))


FEATURES = ["lat", "lat_lag_1", "lat_lag_2", "lat_lag_5", "lat_slope_5", "sr", "fr", "load", "temp"]


HORIZONS = [10, 30, 60]
FORECASTS = {"persistence": "persistence", "rolling_median": "rolling_median", "ewma": "ewma", "linear": "linear", "ridge": "ridge", "boosted_trees": "trees"}


@query("m08_fitted_forecasters")
def _(t):
    """Every forecaster at every horizon, in steps of the hourly grid: runs of the shared tables have about 27 days, too few for the longer ones."""
    rows = Q.lags_and_slopes(_service(t, HOUR), BY, ["d"], "lat", [1, 2, 5], [5], width=192, block=SMALL)
    rows = Q.exponential_mean(rows, BY, ["d"], "lat", "ewma", 15, width=192)
    rows = M.cut(join_on(rows, _split(t), ["run_id"]))
    ahead = framed(rows, BY, ["d"], lambda w: {f"future_{h}": F.lead("lat", h).over(w) for h in HORIZONS}, after=max(HORIZONS), width=192, block=SMALL)
    ahead = M.cut(Q.forecast_frame(ahead, BY, ["d"], "lat", 1, width=192, block=SMALL).withColumn("rolling_median", F.coalesce("rolling_median", "lat")))
    train = ahead.filter("NOT is_test")
    trees = B.fit_trees(train, FEATURES, [f"future_{h}" for h in HORIZONS])
    told = B.with_predictions(trees, ahead.filter("is_test"), {f"future_{h}": f"trees_{h}" for h in HORIZONS})
    parts = []
    for horizon in HORIZONS:
        future = f"future_{horizon}"
        test = told.filter(F.col(future).isNotNull())
        for kind in ("linear", "ridge"):
            test = M.forecast(M.fit_forecaster(train, FEATURES, future, kind), test, FEATURES, kind)
        kinds = {**FORECASTS, "boosted_trees": f"trees_{horizon}"}
        parts.append(M.evaluate_forecasts(test, [], future, kinds).select(F.lit(horizon).alias("horizon"), "*"))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)


def _warning_rows(t):
    rows = _forecast_rows(t)
    limits = M.composite_thresholds(rows.filter("NOT is_test"), "lat", "sr", "fr", "tr")
    rows = M.degraded_now(rows, limits, "lat", "sr", "fr", "tr").withColumn("bad", F.col("lat") > 40)
    rows = Q.future_label(rows, BY, ["d"], "bad", "soon", 3, width=8, block=SMALL, include_now=False)
    return M.cut(rows.withColumn("label", F.col("soon").cast("int")))


@query("m09_warning_classifier")
def _(t):
    rows = _warning_rows(t)
    scored = M.fit_warning(rows.filter("NOT is_test"), FEATURES, "label")(rows.filter("is_test"))
    return rounded(M.classifier_metrics(scored, [], "warning_score", "label", 0.5), 4)


@query("m10_warning_lead", sql=f"""WITH {REQ}, x AS (SELECT run_id, us / 3.6e9 AS t, k >= 85 AS w, min(us / 3.6e9) FILTER (latency_ms > 150) OVER (PARTITION BY run_id) AS onset FROM req)
SELECT run_id, round(max(onset), 6) AS onset, round(min(t) FILTER (w AND (onset IS NULL OR t <= onset)), 6) AS first_warning, count(*) FILTER (w AND (onset IS NULL OR t < onset)) AS warnings_before, count(*) FILTER (w AND (onset IS NULL OR t >= onset)) AS warnings_after,
 round(max(onset) - min(t) FILTER (w AND (onset IS NULL OR t <= onset)), 6) AS lead FROM x GROUP BY 1""")
def _(t):
    r = requests(t).withColumn("t", F.col("us") / 3.6e9)
    onset = r.groupBy("run_id").agg(F.min(F.when(F.col("latency_ms") > 150, F.col("t"))).alias("onset_t"))
    return rounded(M.warning_lead(join_on(r, onset, ["run_id"]).withColumn("w", F.col("k") >= 85), ["run_id"], "t", "w", "onset_t"))


_CURVE = REQ + """, c AS (SELECT event_type AS g, k AS s, count(*) AS n, count(*) FILTER (latency_ms > 35) AS pos FROM req GROUP BY 1, 2), cv AS (SELECT *, sum(n) OVER w AS na, sum(pos) OVER w AS pa, sum(pos) OVER (PARTITION BY g) AS p, sum(n) OVER (PARTITION BY g) AS t FROM c WINDOW w AS (PARTITION BY g ORDER BY s DESC))"""


@query("e37_classifier_metrics", sql=f"""WITH {_CURVE} SELECT g AS event_type, CAST(max(t) AS BIGINT) AS rows, round(max(p) / max(t), 6) AS positive_rate, round(sum(pos) FILTER (s >= 60) / sum(n) FILTER (s >= 60), 6) AS precision, round(sum(pos) FILTER (s >= 60) / max(p), 6) AS recall,
 round((sum(pos) FILTER (s >= 60) / max(p) + (sum(n - pos) FILTER (s < 60)) / (max(t) - max(p))) / 2, 6) AS balanced_accuracy, round(sum(pos * pa / na) / max(p), 6) AS average_precision, round(sum(n) FILTER (s >= 60) / max(t), 6) AS warning_rate FROM cv GROUP BY 1""")
def _(t):
    r = requests(t).withColumn("y", (F.col("latency_ms") > 35).cast("int"))
    return rounded(M.classifier_metrics(r, ["event_type"], "k", "y", 60))


@query("m11_best_f1_threshold", sql=f"WITH {_CURVE}, f AS (SELECT g, s, 2 * pa / (na + p) AS f1 FROM cv), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY f1 DESC, s) AS o FROM f) SELECT g AS event_type, s AS threshold, round(f1, 6) AS f1 FROM r WHERE o = 1")
def _(t):
    r = requests(t).withColumn("y", (F.col("latency_ms") > 35).cast("int"))
    return rounded(M.best_f1_threshold(r, ["event_type"], "k", "y"))


@query("m12_feature_set_comparison")
def _(t):
    rows = _warning_rows(t)
    load = ["load", "errors"]
    feats = Q.lags_and_slopes(rows, BY, ["d"], "load", [1, 3], [3], width=8, block=SMALL)
    future = framed(feats, BY, ["d"], lambda w: {"load_future": F.lead("load", 1).over(w)}, after=1, width=8, block=SMALL)
    future = M.cut(future)
    cols = ["load", "load_lag_1", "load_lag_3", "load_slope_3"]
    model = M.fit_forecaster(future.filter("NOT is_test"), cols, "load_future")
    told = M.forecast(model, future, cols, "load_forecast").withColumn("load_residual", F.col("load_future") - F.col("load_forecast"))
    moved = M.retimed(told, ["run_id"], "d", 1, {"load_residual": "load_residual", "load_forecast": "load_forecast"}).withColumnRenamed("at", "d")
    joined = M.cut(join_on(rows, moved, ["run_id", "d"], "left").withColumn("abs_load_residual", F.abs("load_residual")))
    thermal, extra = ["temp", "lat", "lat_slope_5"], ["load_residual", "abs_load_residual", "load_forecast"]
    out = M.compare_feature_sets(joined.filter("NOT is_test"), joined.filter("is_test"),
                                 {"thermal_only": thermal, "load_residual_only": extra, "thermal_plus_load_residual": thermal + extra}, "label")
    return rounded(out, 4)


@query("m13_normal_behaviour")
def _(t):
    """Lags, horizon and sizes of the trees are the reference's; on the hourly grid, as lag 30 is longer than the runs have days."""
    g = _service(t, HOUR).withColumnRenamed("lat", "latency").withColumnRenamed("sr", "success_rate")
    rows, names = M.normal_features(g, BY, ["d"], ["latency", "success_rate", "load"], [0, 1, 3, 5, 10, 30], 10, width=192, block=SMALL)
    rows = M.cut(join_on(rows, _split(t), ["run_id"]))
    targets = ["latency", "success_rate", "load"]
    model = B.fit_trees(rows.filter("NOT is_test"), names, [f"target_{y}" for y in targets], rounds=400, step=0.03, depth=5)
    rows = B.with_predictions(model, rows, {f"target_{y}": f"pred_{y}" for y in targets})
    rows = M.cut(rows.withColumns({f"res_{y}": F.col(f"target_{y}") - F.col(f"pred_{y}") for y in targets}))
    limits = M.behaviour_thresholds(rows.filter("NOT is_test"), {y: f"res_{y}" for y in targets})
    wide = limits.groupBy().agg(*[F.max(F.when(F.col("target") == y, F.col("threshold"))).alias(f"lim_{y}") for y in targets])
    scored = join_on(rows.filter("is_test").withColumn("__k", F.lit(1)), wide.withColumn("__k", F.lit(1)), ["__k"]).drop("__k")
    score, odd = M.anomaly_score([M.behaviour_flag(y, F.col(f"res_{y}"), F.col(f"lim_{y}")) for y in targets])
    return rounded(scored.select("run_id", "d", score.alias("anomaly_score"), odd.alias("is_anomaly")), 4)


@query("m14_negative_control")
def _(t):
    rows = _warning_rows(t)
    out = M.compare_feature_sets(rows.filter("NOT is_test"), rows.filter("is_test"), {"time_only": ["d"], "primary": FEATURES}, "label")
    best = out.groupBy().agg(F.max(F.when(F.col("feature_set") == "time_only", F.col("average_precision"))).alias("time_only_ap"),
                             F.max(F.when(F.col("feature_set") == "primary", F.col("average_precision"))).alias("primary_ap"))
    return rounded(best.withColumn("status", F.when(F.col("time_only_ap") >= 0.95, "warn").otherwise("pass")), 4)
