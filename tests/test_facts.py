"""Literal cases with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import filters as L, grid, sequence as Q
from pulsegrid.sources import files as X, parsing as P


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_strict_boolean_words(spark):
    df = spark.createDataFrame([(w,) for w in ("False", "true", "0", "1", "healthy", "degraded", None)], "w string")
    assert [r[0] for r in df.select(C.strict_bool("w")).collect()] == [False, True, False, True, False, True, False]
    with pytest.raises(Exception, match="cannot parse boolean value"):
        spark.createDataFrame([("maybe",)], "w string").select(C.strict_bool("w")).collect()


def test_first_sample_is_never_an_onset(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 10, True), ("a", 20, False)], "run string, t long, f boolean")
    assert rows(Q.onsets(df, ["run"], ["t"], "f", width=5, min_runin=1)) == []


def test_onset_after_healthy_run_in(spark):
    df = spark.createDataFrame([("a", t, t in (50, 60)) for t in range(0, 100, 10)], "run string, t long, f boolean")
    assert rows(Q.onsets(df, ["run"], ["t"], "f", width=30, min_runin=50)) == [("a", 50, 50)]
    assert rows(Q.onsets(df, ["run"], ["t"], "f", width=30, min_runin=51)) == []


def test_debounce_keeps_first_and_last(spark):
    df = spark.createDataFrame([("a", t, True) for t in (0, 5, 20, 21)], "run string, t long, w boolean")
    assert [r[1] for r in rows(Q.debounce(df, ["run"], "t", "w", 10, width=10), "t")] == [0, 20]


def test_lead_window_picks_the_alert_twenty_ahead(spark):
    on = spark.createDataFrame([("a", 50)], "run string, onset long")
    al = spark.createDataFrame([("a", 10), ("a", 30)], "run string, at long")
    got = rows(Q.match_alerts(on, al, ["run"], "onset", "at", 15, 25, width=100))
    assert got == [("a", 50.0, 30.0, True, 20.0)]


def test_constant_schedule(spark):
    seg = spark.createDataFrame([("x", "c", 0.0, 2.0, 2.0, 2.0)], "k string, name string, a double, z double, rps double, d double")
    got = rows(X.arrival_schedule(seg, ["k"], "name", "a", "z", "rps", "d", width=4).select("scheduled_elapsed_s"), "scheduled_elapsed_s")
    assert [r[0] for r in got] == [0.0, 0.5, 1.0, 1.5]


def test_piecewise_schedule(spark):
    seg = spark.createDataFrame([("x", "low", 0.0, 1.0, 1.0, 2.0), ("x", "high", 1.0, 2.0, 2.0, 2.0)], "k string, name string, a double, z double, rps double, d double")
    got = rows(X.arrival_schedule(seg, ["k"], "name", "a", "z", "rps", "d", width=4).select("schedule_index", "profile_name"), "schedule_index")
    assert got == [(0, "low"), (1, "high"), (2, "high")]


OPEN = ("run string, scheduled_s double, complete_s double, launch_status string, completed boolean, success boolean, error_type string, "
        "schedule_delay_ms double, inflight int, latency_ms double")


def test_arrival_bin_counts(spark):
    df = spark.createDataFrame([("r", 0.1, 0.3, "launched", True, True, "", 0.0, 1, 100.0),
                                ("r", 0.5, None, "dropped_max_inflight", False, None, "", 0.0, 2, None)], OPEN)
    got = grid.arrival_bins(df, ["run"], duration=spark.createDataFrame([("r", 2.0)], "run string, duration_s double")).orderBy("elapsed_s").collect()
    first = got[0].asDict()
    assert (first["scheduled_request_count"], first["launched_request_count"], first["dropped_max_inflight_count"], first["completed_count"],
            first["schedule_misses"]) == (2, 1, 1, 1, 1)
    assert len(got) == 2 and got[1]["scheduled_request_count"] == 0 and got[1]["latency_p50"] is None


def test_completion_bins(spark):
    df = spark.createDataFrame([("r", 0.0, 2.1, "launched", True, True, "", 0.0, 1, 10.0), ("r", 0.0, 2.8, "launched", True, False, "timeout", 0.0, 1, 20.0)], OPEN)
    got = grid.completion_bins(df, ["run"]).collect()
    assert len(got) == 1
    assert (got[0]["elapsed_s"], got[0]["completed_request_count"], got[0]["successful_count"], got[0]["timeout_count"]) == (2, 2, 1, 1)


def test_measurement_window_seconds(spark):
    df = spark.createDataFrame([("r", s) for s in range(6)], "run string, s long")
    w = spark.createDataFrame([("r", 2, 5, True)], "run string, a long, z long, ok boolean")
    got = rows(L.measurement_window(df, w, ["run"], "s", "a", "z", "ok").filter("eligible").select("s"), "s")
    assert [r[0] for r in got] == [2, 3, 4]


def test_short_episodes_are_dropped_before_merging(spark):
    flags = "0110001110000111100"
    df = spark.createDataFrame([("r", i, c == "1") for i, c in enumerate(flags)], "run string, t long, f boolean")
    assert rows(Q.episodes(df, ["run"], ["t"], "f", width=4, min_duration=3, refractory=5)) == [("r", 6, 16)]
    assert rows(Q.episodes(df, ["run"], ["t"], "f", width=4, min_duration=3, refractory=4), "start") == [("r", 6, 8), ("r", 13, 16)]


def test_exposition_labels_are_unescaped(spark):
    df = spark.createDataFrame([('m{a="x\\"y",b="1,2}"} 1.5e3 1700000000123',), ("# TYPE m",), ("m 3",), ("up 1 5",)], "value string")
    got = P.exposition(df).orderBy("metric", "value").collect()
    assert [(r["metric"], r["labels"], r["value"]) for r in got] == [("m", {}, 3.0), ("m", {"a": 'x"y', "b": "1,2}"}, 1500.0), ("up", {}, 1.0)]


def test_failure_class_order(spark):
    df = spark.createDataFrame([("0", "Read timed out"), ("abc", "connection refused"), ("503", "timeout"), ("204", None), ("302", "")], "c string, m string")
    assert [r[0] for r in df.select(C.failure_class("c", "m")).collect()] == ["read_timeout", "connection_refused", "server_5xx", "none", "http_error"]


def test_column_contract(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="missing column c"):
        L.check_columns(df, ["c"])
    with pytest.raises(ValueError, match="exclude each other"):
        L.check_columns(df, [], [], [("a", "b")])


def test_strict_json_lines_fail_on_a_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{oops\n')
    assert rows(X.read_jsonl(spark, str(tmp_path), "a int")) == [(1,)]
    with pytest.raises(Exception):
        X.read_jsonl(spark, str(tmp_path), "a int", strict=True).collect()


def test_line_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(50)) + "\n")
    got = X.read_lines(spark, str(tmp_path)).orderBy("file", "block", "line_no").collect()
    assert [r["value"] for r in got] == [f"line {i}" for i in range(50)]
    assert [r["line_no"] for r in got] == list(range(50))


def test_population_deviation_needs_two_values(spark):
    from pulsegrid.operators.summary import step_spread
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    assert rows(step_spread(df, ["k"], "v"), "k") == [("a", 1, 1.0, None), ("b", 2, 2.0, 1.0)]


def test_zero_threshold_counts_as_unlimited(spark):
    from pulsegrid.operators.scoring import recalibrate
    df = spark.createDataFrame([("f", "r", t, "lat", float(t), True, 0.0, 0.0, 0.0) for t in range(5)],
                               "fold string, run string, t long, target string, residual double, valid boolean, threshold double, center double, scale double")
    got = recalibrate(df, "t", "run", 2, ["lat"]).orderBy("t").collect()
    assert not any(r["normalized_exceeds"] for r in got)
    assert [r["normalized"] for r in got] == [-0.5, 0.5, 1.5, 2.5, 3.5] and [r["post_calibration"] for r in got] == [False, False, True, True, True]
