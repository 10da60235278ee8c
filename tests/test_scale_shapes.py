"""Operators on skewed data with slices and blocks far smaller than a key, against plain computations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import align as A, ordered as O, scoring as M, selection as G, sequence as Q
from pulsegrid.operators.quantiles import average_rank, floored, linear, nearest, quantiles, rounded


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; times have gaps and ties; values have ties, zeros, negatives, nulls."""
    rng = np.random.default_rng(5)
    n = 900
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": key, "t": np.sort(rng.integers(0, 400, n)), "i": np.arange(n), "v": np.round(rng.normal(0, 30, n), 1)})
    pdf.loc[rng.random(n) < 0.1, "v"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "v"] = 0.0
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(7)
    return pdf, df


def test_quantiles_equal_pandas(hot):
    pdf, df = hot
    got = quantiles(df, ["k"], {"p10": ("v", .1), "p50": ("v", .5), "p99": ("v", linear(.99)), "d": ("v", nearest(.3)), "f": ("v", floored(.3)),
                                "r": ("v", rounded(.3)), "w": (F.col("v") * 2, .5)}).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        s = np.sort(g["v"].dropna().to_numpy())
        n = len(s)
        want = {"p10": np.quantile(s, .1), "p50": np.quantile(s, .5), "p99": np.quantile(s, .99), "d": s[math.ceil(.3 * n) - 1], "f": s[int(.3 * n) - 1],
                "r": s[round((n - 1) * .3)], "w": np.quantile(2 * s, .5)}
        for c, x in want.items():
            assert got.loc[k, c] == pytest.approx(x, abs=1e-9), (k, c)


def test_quantiles_without_keys_and_with_extreme_values(spark):
    values = [0.0, -0.0, 1e-300, -1e300, 1e300, 5.0, 5.0, 5.0, -7.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = quantiles(df, [], {"lo": ("v", 0), "mid": ("v", .5), "hi": ("v", 1)}).first()
    assert (row["lo"], row["mid"], row["hi"]) == (-1e300, 1e-300, 1e300)


def test_fill_and_running_equal_pandas(hot):
    pdf, df = hot
    out = O.fill(df, ["k"], ["t", "i"], {"last": "v"}, width=7)
    out = O.fill(out, ["k"], ["t", "i"], {"nxt": "v"}, width=7, direction="next", strict=True)
    out = O.running(out, ["k"], ["t", "i"], {"s": F.coalesce("v", F.lit(0.0))}, maxima={"m": "v"}, width=7)
    got = out.toPandas().sort_values("i").reset_index(drop=True)
    g = pdf.sort_values(["t", "i"]).groupby("k")["v"]
    pd.testing.assert_series_equal(got["last"], g.ffill().sort_index(), check_names=False)
    # The next known value strictly after a row.
    nxt = pdf.groupby("k")["v"].transform(lambda s: s.shift(-1).bfill())
    pd.testing.assert_series_equal(got["nxt"], nxt, check_names=False)
    np.testing.assert_allclose(got["s"], pdf.assign(v=pdf["v"].fillna(0)).groupby("k")["v"].cumsum())
    pd.testing.assert_series_equal(got["m"], pdf.groupby("k")["v"].cummax().groupby(pdf["k"]).ffill(), check_names=False)


def test_rolling_blocks_equal_pandas(hot):
    pdf, df = hot
    out = Q.rolling(df, ["k"], ["t", "i"], {"m": ("v", "mean", 9, 3), "md": ("v", "median", 9, 3)}, width=11, block=10)
    out = Q.lags_and_slopes(out, ["k"], ["t", "i"], "v", [1, 13], [4], width=11, block=10)
    out = O.lagged(out, ["k"], ["t", "i"], {"ahead": ("v", -6)}, width=11, block=10)
    got = out.toPandas().sort_values("i").reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    np.testing.assert_allclose(got["m"], g.transform(lambda s: s.rolling(9, min_periods=3).mean()), atol=1e-9)
    np.testing.assert_allclose(got["md"], g.transform(lambda s: s.rolling(9, min_periods=3).median()), atol=1e-9)
    np.testing.assert_allclose(got["v_lag_13"], g.shift(13))
    np.testing.assert_allclose(got["ahead"], g.shift(-6))
    np.testing.assert_allclose(got["v_slope_4"], pdf["v"] - g.shift(4))


def test_sequence_operators_do_not_depend_on_slices(hot):
    _, df = hot
    flagged = df.withColumn("f", F.coalesce(F.col("v") > 5, F.lit(False)))
    for op in (lambda w: Q.islands(flagged, ["k"], ["i"], "f", width=w), lambda w: Q.onsets(flagged, ["k"], ["i"], "f", width=w),
               lambda w: Q.change_points(flagged, ["k"], ["i"], "f", width=w).select("k", "i"),
               lambda w: Q.failure_streaks(flagged, ["k"], ["i"], "f", "s", width=w).select("k", "i", "s"),
               lambda w: Q.interpolate(flagged, ["k"], ["i"], ["v"], width=w).select("k", "i", F.round("v", 9))):
        small, large = (sorted(map(tuple, op(w).collect())) for w in (5, 10**6))
        assert small == large and small


def test_exponential_mean_equals_pandas(hot):
    pdf, df = hot
    got = Q.exponential_mean(df, ["k"], ["t", "i"], "v", "e", 5, width=11, block=20).toPandas().sort_values("i")["e"].to_numpy()
    want = pdf.groupby("k")["v"].transform(lambda s: s.ewm(span=5, adjust=False).mean()).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("refractory,width", [(3, 3), (10, 17), (25, 400)])
def test_debounce_equals_the_loop(hot, refractory, width):
    pdf, df = hot
    got = sorted((r["k"], r["t"]) for r in Q.debounce(df.withColumn("f", F.lit(True)), ["k"], "t", "f", refractory, width=width).collect())
    want = []
    for k, g in pdf.groupby("k"):
        last = None
        for t in g["t"]:
            if last is None or t - last >= refractory:
                want.append((k, t))
                last = t
    assert got == sorted(want)


@pytest.mark.parametrize("lead,width", [((5, 40), 40), ((0, 90), 95), ((5, 40), 5000)])
def test_greedy_match_equals_the_loop(spark, lead, width):
    """More onsets than alerts, in one unbroken chain, over many slices."""
    rng = np.random.default_rng(3)
    lo, hi = lead
    odf, adf, want = [], [], []
    for k, n, m in (("r", 400, 300), ("s", 30, 60)):
        on = sorted(set(rng.integers(0, 1500, n).tolist()))
        al = sorted(set(rng.integers(0, 1500, m).tolist()))
        used = set()
        for o in on:
            cand = [a for a in al if o - hi <= a <= o - lo and a not in used]
            used.update(cand[:1])
            want.append((k, float(o), float(cand[0]) if cand else None))
        odf += [(k, o) for o in on]
        adf += [(k, a) for a in al]
    got = Q.match_alerts(spark.createDataFrame(odf, "k string, o long"), spark.createDataFrame(adf, "k string, a long"), ["k"], "o", "a", lo, hi, width=width)
    assert [(r["k"], r["onset"], r["alert"]) for r in got.orderBy("k", "onset").collect()] == want


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_asof_equals_pandas(spark, direction):
    rng = np.random.default_rng(8)
    left = pd.DataFrame({"k": rng.choice(["x", "y"], 80, p=[.9, .1]), "t": rng.choice(2000, 80, replace=False) * 2 + 1, "id": range(80)}).sort_values("t")
    right = pd.DataFrame({"k": rng.choice(["x", "y"], 60, p=[.9, .1]), "rt": rng.choice(1000, 60, replace=False) * 4, "p": rng.random(60).round(3)}).sort_values("rt")
    want = pd.merge_asof(left, right, left_on="t", right_on="rt", by="k", direction=direction, tolerance=60).sort_values("id")
    got = A.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "t", "rt", ["k"], width=37, direction=direction, tolerance=60,
                      payload=["p"]).toPandas().sort_values("id")
    # Equal distances may go either way in pandas; compare distances.
    np.testing.assert_array_equal((got["t"] - got["rt"]).abs().to_numpy(), (want["t"] - want["rt"]).abs().to_numpy())


def test_asof_tie_side(spark):
    left = spark.createDataFrame([(10,)], "t long")
    right = spark.createDataFrame([(8, "e"), (12, "l")], "rt long, p string")
    for tie, want in (("earlier", "e"), ("later", "l")):
        assert A.asof_join(left, right, "t", "rt", [], width=5, payload=["p"], tie=tie).first()["p"] == want
    same = spark.createDataFrame([(10, "x"), (9, "n")], "rt long, p string")
    assert A.asof_join(left, same, "t", "rt", [], width=5, payload=["p"]).first()["p"] == "x"


def test_interval_join_first_and_last(spark):
    pts = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, t double")
    iv = spark.createDataFrame([(1, 0.0, 10.0, "a"), (2, 5.0, 12.0, "b"), (3, 20.0, 25.0, "c")], "n long, s double, e double, label string")
    for pick, mid in (("first", "a"), ("last", "b")):
        got = {r["id"]: r["label"] for r in A.interval_join(pts, iv, "t", "s", "e", [], bucket=3, pick=pick, order=["n"], payload=["label"]).collect()}
        assert len(got) == 30 and got[7] == mid and got[10] == "b" and got[12] is None and got[24] == "c" and got[25] is None


@pytest.mark.parametrize("closed", ["left", "both"])
@pytest.mark.parametrize("pick", ["first", "last"])
def test_interval_join_resolves_overlaps(spark, pick, closed):
    rng = np.random.default_rng(6)
    iv = [(i, int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 100, 40), rng.integers(0, 25, 40)))]
    pts = [(i, int(t)) for i, t in enumerate(rng.integers(-5, 130, 150))]
    got = {r["id"]: r["n"] for r in A.interval_join(spark.createDataFrame(pts, "id long, t long"), spark.createDataFrame(iv, "n long, s long, e long"), "t", "s", "e", [],
                                                    bucket=7, closed=closed, pick=pick, order=["n"], payload=["n"]).collect()}
    for i, t in pts:
        inside = [x for x in iv if x[1] <= t and (t < x[2] or (closed == "both" and t == x[2]))]
        want = None if not inside else min(inside, key=lambda x: (x[1], x[0]))[0] if pick == "first" else max(inside, key=lambda x: (x[2], x[0]))[0]
        assert got[i] == want, (t, inside)
    assert len(got) == len(pts)


def test_outages_equal_the_scan(spark):
    rng = np.random.default_rng(4)
    n = 300
    pdf = pd.DataFrame({"t": np.round(rng.random(n) * 200, 1), "inst": rng.choice(list("xyz"), n), "bad": rng.random(n) < .3})
    got = [(r["core_start"], r["core_end"], r["failed_instances"], r["failure_count"]) for r in
           Q.outages(spark.createDataFrame(pdf), [], "t", "inst", "bad", width=13, window=5, min_instances=3, min_failures=4, merge_gap=3).orderBy("core_start").collect()]
    bad = pdf[pdf["bad"]]
    hits = [t for t in range(math.floor(pdf["t"].min()), math.ceil(pdf["t"].max()) + 1)
            if len(s := bad[(bad["t"] >= t - 4) & (bad["t"] <= t)]) >= 4 and s["inst"].nunique() >= 3]
    spans = []
    for t in hits:
        if spans and t - spans[-1][1] <= 3:
            spans[-1][1] = t
        else:
            spans.append([t, t])
    want = []
    for a, z in spans:
        s = bad[(bad["t"] >= a - 4) & (bad["t"] <= z)]
        want.append((a - 4, z, s["inst"].nunique(), len(s)))
    assert got == want and want


def test_average_rank_equals_pandas(hot):
    pdf, df = hot
    got = average_rank(df, ["k"], {"r": "v"}).toPandas().sort_values("i")["r"].to_numpy()
    np.testing.assert_allclose(got, pdf.groupby("k")["v"].rank().to_numpy())


def test_average_precision_and_best_f1(spark):
    data = [(.9, 1), (.9, 0), (.8, 1), (.4, 0), (.3, 1), (.3, 0), (.1, 0)]
    df = spark.createDataFrame(data, "s double, y int")
    row = M.classifier_metrics(df, [], "s", "y", .5).first()
    ap = (1 / 3) * (1 / 2) + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 6)
    assert row["average_precision"] == pytest.approx(ap) and row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(2 / 3)
    # 0.8 and 0.3 give the same F1; the lower one counts.
    assert M.best_f1_threshold(df, [], "s", "y").first()["threshold"] == .3


def test_last_n_of_a_hot_key(hot):
    pdf, df = hot
    got = sorted(r["i"] for r in G.last_n(df, ["k"], ["t", "i"], 12, salts=5).collect())
    want = sorted(pdf.sort_values(["t", "i"]).groupby("k").tail(12)["i"])
    assert got == want


def test_linear_model_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"run": np.arange(200) % 4, "a": rng.normal(5, 2, 200), "b": rng.normal(-1, 3, 200)})
    pdf["y"] = 2 + 3 * pdf["a"] - .5 * pdf["b"] + rng.normal(0, .1, 200)
    df = spark.createDataFrame(pdf)
    rows = M.with_folds(df, df.select(F.col("run").cast("string").alias("fold"), "run").distinct(), "run")
    got = {r["fold"]: r for r in M.expected_behaviour(rows, ["a", "b"], ["y"]).collect()}
    for f in range(4):
        tr = pdf[pdf["run"] != f]
        beta = np.linalg.lstsq(np.column_stack([np.ones(len(tr)), tr["a"], tr["b"]]), tr["y"], rcond=None)[0]
        np.testing.assert_allclose([got[str(f)]["intercept"], *got[str(f)]["coefficients"]], beta, rtol=1e-8)
