"""Readers beyond the lengths that earlier versions stopped at, and files that do not agree."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F, types as T

from pulsegrid.operators.keys import scratch_folder
from pulsegrid.sources import files, parsing


def test_chart_of_very_many_dimensions(spark):
    n = 12_000
    doc = json.dumps({"labels": ["time", *[f"d{i}" for i in range(n)]], "data": [[1.0, *map(float, range(n))]], "units": "u"})
    rows = parsing.chart_latest(spark.createDataFrame([(1, doc)], "id int, doc string"), "doc", ["id"])
    assert rows.agg(F.count("*"), F.sum("value")).first() == (n, sum(range(n)))
    one = json.dumps({"labels": ["time"], "data": [[1.0]], "units": "u"})
    assert parsing.chart_latest(spark.createDataFrame([(1, one)], "id int, doc string"), "doc", ["id"]).count() == 0


def test_number_far_behind_its_field(spark):
    lines = [(0, "Station 02:00:00:00:00:01 (on wlan0)"), (1, "\tsignal:" + " " * 80 + "-42 dBm")]
    df = spark.createDataFrame([("h", *x) for x in lines], "host string, line_no int, line string")
    assert parsing.stations(df, ["host"], ["line_no"], "line", width=1000).first()["signal_dbm"] == -42


def test_long_summary(spark):
    body = json.dumps({"success": True, "note": "x" * 1_100_000})
    df = spark.createDataFrame([("h", 0, "SUMMARY " + body)], "host string, line_no int, line string")
    row = parsing.tagged_json(df, ["host"], ["line_no"], "line", "PROGRESS ", "SUMMARY ", "success boolean, error string, note string").first()
    assert len(row["note"]) == 1_100_000


def test_exposition_lines(spark):
    lines = ['m{a="1"} 5', "bare 7", 'm{a="1",a="2",b="x"} 5 1000', "# HELP m", "m{", 'm{a="1"} 5 6 7']
    out = parsing.exposition(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    got = {(r["metric"], tuple(sorted(r["labels"].items())), r["value"], r["ts"] is None) for r in out}
    assert got == {("m", (("a", "1"),), 5.0, True), ("bare", (), 7.0, True), ("m", (("a", "2"), ("b", "x")), 5.0, False)}


def test_csv_files_with_other_headers(spark):
    folder = f"{scratch_folder(spark)}/csv-headers"
    for columns in (["event_id", "value"], ["value", "event_id"], ["event_id"]):
        spark.createDataFrame([(57, 570.0)], "event_id int, value double").select(*columns).write.mode("append").option("header", True).csv(folder)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    assert sorted(map(tuple, files.read_csv(spark, folder, schema).collect()), key=str) == [(57, 570.0), (57, 570.0), (57, None)]


@pytest.mark.parametrize("kind, penalty", [("ridge", 1.0), ("linear", 0.0)])
def test_fits_match_the_normal_equations(spark, kind, penalty):
    import numpy as np

    from pulsegrid.operators import scoring

    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)) * [1, 10, 100]
    y = x @ [50, 5, 3] + rng.normal(size=40) * 100
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    got = [r["p"] for r in scoring.forecast(scoring.fit_forecaster(df, ["a", "b", "c"], "y", kind), df, ["a", "b", "c"], "p").collect()]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    w = np.linalg.solve(z.T @ z + penalty * np.eye(3), z.T @ (y - y.mean()))
    assert np.abs(np.array(got) - (z @ w + y.mean())).max() < 1e-6


def test_gaps_are_filled_by_the_exact_median(spark):
    from pulsegrid.operators import scoring

    nan = float("nan")
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, nan), (4.0, None), (None, None), (nan, nan)], "a double, b double")
    impute = scoring._assembled(df, ["a", "b"], False)[0]
    assert [tuple(r) for r in impute.transform(df).select("__i_a", "__i_b").collect()] == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0), (2.5, 0.0), (2.5, 0.0)]


def _fits(spark, monkeypatch, name):
    """The query with every fit of trees noted and made small: its rows, and (targets, features, sizes) of the fits."""
    from pulsegrid.operators import boosting
    from pulsegrid.plans import catalog

    fit, seen = boosting.fit_trees, []

    def small(train, features, targets, **sizes):
        seen.append((list(targets), list(features), sizes))
        return fit(train, features, targets, rounds=2, depth=2)
    monkeypatch.setattr(boosting, "fit_trees", small)
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect(), seen


def test_forecasters_run_at_every_horizon(spark, monkeypatch):
    rows, seen = _fits(spark, monkeypatch, "m08_fitted_forecasters")
    models = {"persistence", "rolling_median", "ewma", "linear", "ridge", "boosted_trees"}
    assert {(r["horizon"], r["model"]) for r in rows} == {(h, m) for h in (10, 30, 60) for m in models}
    assert all(r["n"] > 0 for r in rows)
    assert [(targets, sizes) for targets, _, sizes in seen] == [(["future_10", "future_30", "future_60"], {})]


def test_normal_behaviour_uses_all_lags_and_full_trees(spark, monkeypatch):
    rows, seen = _fits(spark, monkeypatch, "m13_normal_behaviour")
    assert rows and len(seen) == 1
    targets, features, sizes = seen[0]
    assert targets == ["target_latency", "target_success_rate", "target_load"] and sizes == {"rounds": 400, "step": 0.03, "depth": 5}
    assert {f"latency_lag{k}" for k in (0, 1, 3, 5, 10, 30)} <= set(features)
