"""Splits, expected-behaviour models, residual scoring, thresholds and early-warning metrics.

Scored timelines are long: one row per fold, run, time and target. Linear models are fitted from per-fold
moments, so a fit costs one aggregation over the rows and a small solve per fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .grid import ratio
from .keys import col, cut, is_small, join_on, keyed, value_code
from .ordered import fill, framed, lagged, numbered, running
from .quantiles import quantiles, summarise
from .sequence import exponential_mean, first_sustained, forecast_frame, future_label, rolling, sustained
from .summary import forecast_metrics, n_if


def chronological_split(df: DataFrame, run: str, start: str, *, width, share: float = 0.2) -> DataFrame:
    """(run, is_test): the last runs by start time are held out, ``share`` of them rounded up, at least one."""
    runs = df.groupBy(run).agg(F.min(start).alias("__start"))
    placed = numbered(runs, [], ["__start", run], "__rn", width=width)
    total = runs.agg(F.count(F.lit(1)).alias("__n"))
    both = join_on(*[keyed(x, [])[0] for x in (placed, total)], ["__all"])
    held = F.greatest(F.ceil(F.col("__n") * share), F.lit(1))
    return both.select(run, (F.col("__rn") > F.col("__n") - held).alias("is_test"))


def folds(df: DataFrame, run: str, replicate: str | None = None, *, per_run: bool = True) -> DataFrame:
    """(split, fold, test run) rows: each run left out, and each replicate where every run names exactly one.

    Only the held-out runs are listed; every other run trains a fold.
    """
    runs = df.select(run).distinct()
    out = runs.select(F.lit("leave_one_run_out").alias("split"), F.col(run).cast("string").alias("fold"), F.col(run)) if per_run else None
    if replicate:
        named = df.groupBy(run).agg(F.count_distinct(replicate).alias("__k"), F.max(replicate).alias("__r"),
                                    F.bool_or(F.col(replicate).isNull()).alias("__gap"))
        flaw = named.agg(F.bool_or((F.col("__k") != 1) | F.col("__gap")).alias("__flaw"))
        ok = join_on(keyed(named, [])[0], keyed(flaw, [])[0], ["__all"]).filter(~F.col("__flaw"))
        part = ok.select(F.lit("leave_one_replicate_per_load_level_out").alias("split"),
                         F.concat(F.lit("replicate_"), F.col("__r").cast("string")).alias("fold"), run)
        out = part if out is None else out.unionByName(part)
    return out


def group_folds(df: DataFrame, run: str, k: int = 5, *, width, order: str | None = None) -> DataFrame:
    """(fold, test run): runs dealt over ``k`` folds from the last to the first, so sizes differ by one at most."""
    runs = df.groupBy(run).agg(F.min(order or run).alias("__o"))
    placed = numbered(runs, [], ["__o", run], "__rn", width=width)
    total = runs.agg(F.count(F.lit(1)).alias("__n"))
    both = join_on(*[keyed(x, [])[0] for x in (placed, total)], ["__all"])
    return both.select((F.pmod(F.col("__n") - F.col("__rn"), F.lit(k)) + 1).alias("fold"), run)


FOLD_ROWS = 1_000_000  # multiplied rows of a task where rows are dealt by their keys


def with_folds(df: DataFrame, fold_tests: DataFrame, run: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Every row once per fold with ``is_test``. The list of fold names is small by construction and is
    read when the query is built; the rows themselves are only multiplied, not shuffled.

    With ``keys`` rows are dealt by these before they are multiplied: a grouping by fold and these keys then
    finds its rows in one task each, and what is shuffled and stored does not grow with the folds."""
    held = cut(fold_tests.select("fold", run))
    names = [r[0] for r in held.select("fold").distinct().orderBy("fold").collect()]
    tests = held.groupBy(run).agg(F.collect_set("fold").alias("__tests"))
    out = join_on(df, tests, [run], "left", small=is_small(held))
    if keys:
        parts = -(-df.count() * max(1, len(names)) // FOLD_ROWS)
        out = out.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts), *keys)
    return out.withColumn("fold", F.explode(F.array(*[F.lit(n) for n in names]))) \
        .withColumn("is_test", F.coalesce(F.array_contains("__tests", F.col("fold")), F.lit(False))).drop("__tests")


def expected_behaviour(rows: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Least squares of each target on the features per fold, from the training rows: (fold, target,
    intercept, coefficients, train_rows, model_type). Without features the model is the mean. Folds with
    fewer than max(12, features + 3) complete rows get no model."""
    parts = []
    for y in targets:
        whole = F.col(y).isNotNull()
        for x in features:
            whole &= F.col(x).isNotNull()
        pick = lambda c: F.when(whole, F.col(c).cast("double"))  # noqa: B023,E731
        parts.append(F.struct(
            F.lit(y).alias("target"), F.count(F.when(whole, 1)).alias("n"), F.avg(pick(y)).alias("my"),
            F.array(*[F.avg(pick(x)) for x in features]).cast("array<double>").alias("mx"),
            F.array(*[F.covar_pop(pick(x), pick(y)) for x in features]).cast("array<double>").alias("cxy"),
            F.array(*[F.covar_pop(pick(a), pick(b)) for a in features for b in features]).cast("array<double>").alias("cxx")))
    stats = rows.filter(~F.col("is_test")).groupBy("fold").agg(F.array(*parts).alias("__s")).select("fold", F.explode("__s").alias("__s")).select("fold", "__s.*")
    least = max(12, len(features) + 3)
    schema = T.StructType([stats.schema["fold"], T.StructField("target", T.StringType()), T.StructField("intercept", T.DoubleType()),
                           T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("train_rows", T.LongType()),
                           T.StructField("model_type", T.StringType())])
    p = len(features)

    def solve(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.n < least:
                    continue
                beta = np.zeros(0)
                if p:
                    beta = np.linalg.lstsq(np.array(r.cxx, dtype=float).reshape(p, p), np.array(r.cxy, dtype=float), rcond=None)[0]
                out.append((r.fold, r.target, float(r.my - (beta @ np.array(r.mx, dtype=float) if p else 0.0)), beta.tolist(), int(r.n),
                            "linear" if p else "intercept_only"))
            yield pd.DataFrame(out, columns=["fold", "target", "intercept", "coefficients", "train_rows", "model_type"])

    return stats.mapInPandas(solve, schema)


def residuals(rows: DataFrame, models: DataFrame, features: Sequence[str], targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long timeline (fold, keep…, is_test, target, observed, expected, residual)."""
    long = rows.select("fold", "is_test", *keep, *features, F.explode(F.array(*[F.struct(
        F.lit(y).alias("target"), F.col(y).cast("double").alias("observed")) for y in targets])).alias("__t")) \
        .select("fold", "is_test", *keep, *features, "__t.*")
    out = join_on(long, models.select("fold", "target", "intercept", "coefficients"), ["fold", "target"], small=True)
    expected = F.col("intercept")
    for i, x in enumerate(features):
        expected = expected + F.col("coefficients")[i] * F.col(x).cast("double")
    return out.withColumn("expected", expected).withColumn("residual", F.col("observed") - F.col("expected")) \
        .drop("intercept", "coefficients", *[f for f in features if f not in keep])


def residual_thresholds(scored: DataFrame, q: float = 0.99) -> DataFrame:
    """Per fold and target, from the training rows: quantile of the absolute residual, centre and robust scale."""
    train = scored.filter(~F.col("is_test"))
    base = quantiles(train, ["fold", "target"], {"threshold": (F.abs("residual"), q), "center": ("residual", .5)})
    base = cut(base)
    spread = quantiles(join_on(train, base, ["fold", "target"], small=True), ["fold", "target"], {"__mad": (F.abs(F.col("residual") - F.col("center")), .5)})
    scale = F.col("__mad") * 1.4826
    return join_on(base, spread, ["fold", "target"], small=True).withColumn("scale", F.when(scale > 1e-9, scale).otherwise(1.0)).drop("__mad")


def score_residuals(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Exceedance and robust z of every residual; a null residual is not valid and never exceeds."""
    out = join_on(scored, thresholds, ["fold", "target"], small=True)
    return out.withColumn("valid", F.col("residual").isNotNull()) \
        .withColumn("exceeds", F.coalesce(F.abs("residual") > F.col("threshold"), F.lit(False))) \
        .withColumn("z", (F.col("residual") - F.col("center")) / F.col("scale"))


def composite_risk(scored: DataFrame, keys: Sequence[str], q: float = 0.99) -> DataFrame:
    """Mean absolute z over the targets a row has, against the training quantile of the fold."""
    risk = scored.groupBy("fold", "is_test", *keys).agg(F.avg(F.abs("z")).alias("risk"))
    limit = quantiles(risk.filter(~F.col("is_test")), ["fold"], {"risk_threshold": ("risk", q)})
    return join_on(risk, limit, ["fold"], "left", small=True).withColumn("risk_exceeds", F.coalesce(F.col("risk") > F.col("risk_threshold"), F.lit(False)))


def recalibrate(scored: DataFrame, t: str, run: str, window_s, latency_targets: Sequence[str]) -> DataFrame:
    """Subtract, per fold and run, the median latency residual of the first ``window_s``.

    ``scored`` has residual, valid, threshold, center, scale. A threshold of 0 counts as unlimited and a
    scale of 0 as 1. Rows of the window are left out of composite scoring when a latency target exists.
    """
    lat = F.col("target").isin(*latency_targets)
    keys = ["fold", run, "target"]
    start = cut(scored.groupBy("fold", run).agg(F.min(t).alias("__t0"), F.bool_or(lat).alias("__any")))
    rows = join_on(scored, start, ["fold", run], small=is_small(start))
    early = F.col(t) < F.col("__t0") + window_s
    offset = cut(quantiles(rows.filter(lat & early & F.col("valid")), keys, {"__off": ("residual", .5)}))
    rows = join_on(rows, offset, keys, "left", small=is_small(offset))
    limit = F.when(F.coalesce(F.col("threshold"), F.lit(0.0)) != 0, F.col("threshold")).otherwise(F.lit(float("inf")))
    scale = F.greatest(F.when(F.coalesce(F.col("scale"), F.lit(0.0)) != 0, F.col("scale")).otherwise(1.0), F.lit(1e-9))
    adj = F.col("residual") - F.when(lat, F.coalesce("__off", F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("offset", F.when(lat, F.coalesce("__off", F.lit(0.0))).otherwise(0.0)).withColumn("normalized", adj) \
        .withColumn("normalized_exceeds", F.coalesce((F.abs("normalized") > limit) & F.col("valid"), F.lit(False))) \
        .withColumn("normalized_z", (F.col("normalized") - F.coalesce("center", F.lit(0.0))) / scale) \
        .withColumn("post_calibration", ~(F.col("__any") & early)).drop("__t0", "__any", "__off")


def recalibrated_risk(recalibrated: DataFrame, keys: Sequence[str], limits: DataFrame) -> DataFrame:
    """Composite risk of the recalibrated residuals against the fold's limit (0 or none: unlimited)."""
    risk = recalibrated.groupBy("fold", *keys).agg(F.avg(F.abs("normalized_z")).alias("risk"), F.bool_and("post_calibration").alias("post_calibration"))
    limit = F.when(F.coalesce(F.col("risk_threshold"), F.lit(0.0)) != 0, F.col("risk_threshold")).otherwise(F.lit(float("inf")))
    return join_on(risk, limits, ["fold"], "left", small=True).withColumn("risk_exceeds", F.coalesce(F.col("risk") > limit, F.lit(False)))


def residual_anomalies(df: DataFrame, residual: str, normal: Column, train: Column, phase: str) -> DataFrame:
    """Anomaly rate per phase of the held-out rows; the limit comes from the normal training rows:
    max(|q99|, |median| + 6 MAD), with the standard deviation where the MAD is not positive."""
    base = df.filter(train & normal & F.col(residual).isNotNull())
    mid = summarise(base, [], {"__sd": F.stddev_samp(residual)}, {"__med": (residual, .5), "__q99": (residual, .99)})
    mid = cut(keyed(mid, [])[0])
    dev = quantiles(join_on(keyed(base, [])[0], mid, ["__all"]), ["__all"], {"__mad": (F.abs(F.col(residual) - F.col("__med")), .5)})
    spread = F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.coalesce("__sd", F.lit(1.0)))
    limit = join_on(mid, dev, ["__all"]).select("__all", F.greatest(F.abs("__q99"), F.abs("__med") + 6.0 * spread).alias("threshold"))
    rows = join_on(keyed(df.filter(~train), [])[0], limit, ["__all"])
    return summarise(rows, [phase], {
        "rows": F.count(F.lit(1)), "threshold": F.max("threshold"),
        "anomaly_rate": F.avg(F.coalesce(F.abs(residual) > F.col("threshold"), F.lit(False)).cast("double"))},
        {"residual_median": (residual, .5), "abs_residual_p95": (F.abs(residual), .95)})


def composite_thresholds(df: DataFrame, latency: str, success: str, fail: str, timeout: str, *, healthy_rows: int = 300) -> DataFrame:
    """One row of degradation thresholds from healthy training rows.

    ``df`` holds the normal training rows. Rows with success ≥ 0.99 and failures and timeouts ≤ 0.01 count
    as stable; where they are fewer than ``healthy_rows``, every row with a latency does.
    """
    rows = df.filter(F.col(latency).isNotNull())
    strict = F.coalesce((F.col(success) >= 0.99) & (F.col(fail) <= 0.01) & (F.col(timeout) <= 0.01), F.lit(False))
    rows = rows.withColumn("__strict", strict)
    size = rows.agg(n_if("__strict").alias("__k"), F.count(F.lit(1)).alias("__n"))
    tagged = join_on(keyed(rows, [])[0], keyed(size, [])[0], ["__all"])
    stable = tagged.filter(F.col("__strict") | (F.col("__k") < healthy_rows))
    base = summarise(stable, ["__all"], {"stable_rows": F.count(F.lit(1))}, {
        "__lm": (latency, .5), "__l99": (latency, .99), "__s01": (success, .01), "__fm": (fail, .5), "__f99": (fail, .99),
        "__tm": (timeout, .5), "__t99": (timeout, .99)})
    base = cut(base)
    dev = quantiles(join_on(stable, base, ["__all"]), ["__all"], {
        "__ld": (F.abs(F.col(latency) - F.col("__lm")), .5), "__fd": (F.abs(F.col(fail) - F.col("__fm")), .5),
        "__td": (F.abs(F.col(timeout) - F.col("__tm")), .5)})
    pos = lambda c, other: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(other))
    high = lambda m, q99, d: F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.col(q99), F.col(m) + 6.0 * pos(d, 0.01)))
    return join_on(base, dev, ["__all"]).select(
        "stable_rows", F.greatest(F.col("__l99"), F.col("__lm") + 6.0 * pos("__ld", 5.0), F.col("__lm") + 50.0).alias("latency_threshold"),
        F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.coalesce("__s01", F.lit(1.0)) - 0.05)).alias("success_low"),
        high("__fm", "__f99", "__fd").alias("fail_high"), high("__tm", "__t99", "__td").alias("timeout_high"))


def degraded_now(df: DataFrame, limits: DataFrame, latency: str, success: str, fail: str, timeout: str) -> DataFrame:
    """Instant degradation: any of the four measures beyond its threshold."""
    rows = join_on(keyed(df, [])[0], keyed(limits, [])[0], ["__all"]).drop("__all")
    z = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumn("degraded", z(F.col(latency) >= F.col("latency_threshold")) | z(F.col(success) <= F.col("success_low"))
                           | z(F.col(fail) >= F.col("fail_high")) | z(F.col(timeout) >= F.col("timeout_high")))


def evaluate_forecasts(df: DataFrame, by: Sequence[str], actual: str, predictions: Mapping[str, str]) -> DataFrame:
    """Error metrics of several predictions of one value, one row per key and model."""
    long = df.select(*by, actual, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("predicted"))
                                                      for m, c in predictions.items()])).alias("__m")).select(*by, actual, "__m.*")
    return forecast_metrics(long, [*by, "model"], actual, "predicted")


def _assembled(rows: DataFrame, features: Sequence[str], scale: bool = True):
    """Stages that fill gaps by the exact medians of ``rows``, assemble and scale. A feature without any value is 0 everywhere."""
    from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler

    medians = quantiles(rows, [], {f: (f, .5) for f in features}).first() if features else None
    fill_in = [f"coalesce(nanvl(`{f}`, NULL), CAST('{0.0 if medians is None or medians[f] is None else medians[f]!r}' AS DOUBLE)) AS `__i_{f}`" for f in features]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(['*', *fill_in])} FROM __THIS__"),
              VectorAssembler(inputCols=[f"__i_{f}" for f in features], outputCol="__x")]
    if scale:
        stages.append(StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=True))
    return stages


def _doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def fit_forecaster(train: DataFrame, features: Sequence[str], target: str, kind: str = "ridge", seed: int = 7, rounds: int = 200,
                   step: float = 0.05, depth: int = 4):
    """A fitted pipeline (median imputation, scaling, ``linear``, ``ridge`` or boosted ``trees``) that adds ``prediction``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = _doubles(train.filter(F.col(target).isNotNull()), [*features, target])
    if kind == "trees":
        model = GBTRegressor(featuresCol="__x", labelCol=target, maxIter=rounds, stepSize=step, maxDepth=depth, seed=seed)
        return Pipeline(stages=[*_assembled(rows, features, False), model]).fit(rows)
    # A penalty of 1 on the sum of squares is 1/n on the mean; the solver works on the label over its deviation, which takes the penalty along.
    n, spread = rows.agg(F.count(F.lit(1)), F.coalesce(F.stddev_pop(target), F.lit(0.0))).first()
    return Pipeline(stages=[*_assembled(rows, features), LinearRegression(
        featuresCol="__z", labelCol=target, regParam=(0.0 if kind == "linear" else spread / max(n, 1)), standardization=False, solver="normal")]).fit(rows)


def forecast(model, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    out = model.transform(_doubles(df, features)).withColumnRenamed("prediction", name)
    return out.drop(*[c for c in out.columns if c.startswith("__i_") or c in ("__x", "__z")])


def fit_warning(train: DataFrame, features: Sequence[str], label: str, iterations: int = 1000):
    """Balanced logistic classifier; one-class training gives that class as a constant.

    Returns a function that adds ``warning_score`` to a frame.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    rows = _doubles(train, [*features, label])
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(counts) < 2:
        constant = float(next(iter(counts), 0.0))
        return lambda df: df.withColumn("warning_score", F.lit(constant))
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2.0 * counts[1.0])).otherwise(total / (2.0 * counts[0.0]))
    model = Pipeline(stages=[*_assembled(rows, features), LogisticRegression(
        featuresCol="__z", labelCol=label, weightCol="__w", maxIter=iterations, regParam=1.0 / total)]).fit(rows.withColumn("__w", weight))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(_doubles(df, features)).withColumn("warning_score", vector_to_array("probability")[1])
        return out.drop(*[c for c in out.columns if c.startswith("__i_") or c in ("__x", "__z", "rawPrediction", "probability", "prediction")])
    return score


def score_curve(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Per distinct score: rows and positives at it, and in all at or above it."""
    base, keys = keyed(df.filter(F.col(score).isNotNull()), by)
    counted = base.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")) \
        .withColumn("__neg", -F.col(score))
    out = running(counted, keys, ["__neg"], {"n_above": "n", "pos_above": "pos"}, slice_col=value_code("__neg")).drop("__neg")
    return out if by else out.drop("__all")


def classifier_metrics(df: DataFrame, by: Sequence[str], score: str, label: str, threshold) -> DataFrame:
    """Precision, recall, balanced accuracy, average precision and warning rate (equal scores form one step)."""
    base, keys = keyed(df, by)
    pos, warn = F.col(label).cast("boolean"), F.col(score) >= threshold
    conf = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), n_if(pos).alias("__p"), n_if(warn).alias("__w"), n_if(pos & warn).alias("__tp"),
                                   n_if(~pos & ~warn).alias("__tn"))
    curve = score_curve(base, keys, score, label)
    ap = curve.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("pos_above") / F.col("n_above")).alias("__ap"))
    p, n = F.col("__p"), F.col("rows") - F.col("__p")
    both = (p > 0) & (n > 0)
    out = join_on(conf, ap, keys, "left").select(
        *keys, "rows", (p / F.col("rows")).alias("positive_rate"), ratio(F.col("__tp"), F.col("__w"), 0).alias("precision"),
        ratio(F.col("__tp"), p, 0).alias("recall"), F.when(both, (F.col("__tp") / p + F.col("__tn") / n) / 2).alias("balanced_accuracy"),
        F.when(both, F.col("__ap") / p).alias("average_precision"), (F.col("__w") / F.col("rows")).alias("warning_rate"))
    return out if by else out.drop("__all")


def best_f1_threshold(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """The score at or above which warning gives the best F1; among equals the lowest."""
    base, keys = keyed(df, by)
    total = base.groupBy(*keys).agg(F.sum(F.col(label).cast("bigint")).alias("__p"))
    curve = join_on(score_curve(base, keys, score, label), total, keys)
    f1 = 2 * F.col("pos_above") / (F.col("n_above") + F.col("__p"))
    out = curve.withColumn("__f", f1).groupBy(*keys).agg(F.min_by(score, F.struct(-F.col("__f"), F.col(score))).alias("threshold"), F.max("__f").alias("f1"))
    return out if by else out.drop("__all")


def warning_lead(df: DataFrame, by: Sequence[str], t: str, warning: str, onset: str) -> DataFrame:
    """Lead of the first warning at or before each key's onset, and warnings before and after it."""
    w, at = F.coalesce(F.col(warning), F.lit(False)), F.col(onset)
    out = df.groupBy(*by).agg(
        F.max(at).alias("onset"), F.min(F.when(w & (at.isNull() | (F.col(t) <= at)), F.col(t))).alias("first_warning"),
        n_if(w & (at.isNull() | (F.col(t) < at))).alias("warnings_before"), n_if(w & (at.isNull() | (F.col(t) >= at))).alias("warnings_after"))
    return out.withColumn("lead", F.col("onset") - F.col("first_warning"))


def retimed(df: DataFrame, by: Sequence[str], origin: str, horizon, values: Mapping[str, str]) -> DataFrame:
    """Forecast residuals moved from their origin to the time they speak about."""
    return df.select(*by, F.bround(F.col(origin) + horizon).cast("bigint").alias("at"), *[F.col(c).alias(n) for n, c in values.items()])


def compare_feature_sets(train: DataFrame, test: DataFrame, sets: Mapping[str, Sequence[str]], label: str) -> DataFrame:
    """Held-out metrics of one balanced classifier per feature set, at the threshold best on its training rows."""
    parts = []
    for name, features in sets.items():
        score = fit_warning(train, features, label)
        limit = best_f1_threshold(score(train), [], "warning_score", label)
        rows = join_on(keyed(score(test), [])[0], keyed(limit.select("threshold"), [])[0], ["__all"]).drop("__all")
        out = classifier_metrics(rows, [], "warning_score", label, F.col("threshold"))
        parts.append(out.select(F.lit(name).alias("feature_set"), F.lit(len(features)).alias("feature_count"), "*"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def normal_features(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], lags: Sequence[int], horizon: int, *, width,
                    **kw) -> tuple[DataFrame, list[str]]:
    """Lags, short rolling means and deviations of each value, and its future as ``target_…``."""
    names: list[str] = []

    def exprs(w):
        out = {}
        for v in values:
            out |= {f"{v}_lag{k}": (F.lag(v, k).over(w) if k else F.col(v)) for k in lags}
            out |= {f"{v}_mean5": F.avg(v).over(w.rowsBetween(-4, 0)), f"{v}_mean15": F.avg(v).over(w.rowsBetween(-14, 0)),
                    f"{v}_std15": F.stddev_samp(v).over(w.rowsBetween(-14, 0))}
        names.extend(out)
        out |= {f"target_{v}": F.lead(v, horizon).over(w) for v in values}
        return out
    rows = framed(df, by, order, exprs, before=max([14, *lags]), after=horizon, width=width, **kw)
    return rows.dropna(subset=[*names, *[f"target_{v}" for v in values]]), names


def behaviour_thresholds(df: DataFrame, residual_cols: Mapping[str, str]) -> DataFrame:
    """Per target max(p99, mean + 3 standard deviations) of the absolute residuals of normal rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.abs(F.col(c)).alias("a")) for t, c in residual_cols.items()]))
                     .alias("__r")).select("__r.*")
    out = summarise(long, ["target"], {"__m": F.avg("a") + 3 * F.stddev_samp("a")}, {"__p": ("a", .99)})
    return out.select("target", F.greatest("__p", "__m").alias("threshold"))


def behaviour_flag(target: str, residual: Column, threshold: Column) -> Column:
    """Whether a residual (actual - predicted) is bad for its target: low for success rates, high for
    latency, temperature and use, either way for the others."""
    low = target.lower()
    if "success_rate" in low:
        return -residual > threshold
    if any(w in low for w in ("latency", "temp", "used", "util")):
        return residual > threshold
    return F.abs(residual) > threshold


def anomaly_score(flags: Sequence[Column], least: float = 0.2) -> tuple[Column, Column]:
    """Share of raised flags and whether it makes an anomaly."""
    total = sum([f.cast("int") for f in flags[1:]], flags[0].cast("int")) / float(len(flags))
    return total, total >= least
