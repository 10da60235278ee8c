"""Work that must not grow faster than the rows: what joins and groupings shuffle, the tasks of a fit, the groups of a stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import boosting as B, quantiles as Q, scoring as M, summary as S
from pulsegrid.sources import parsing


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def fold_rows(spark, keys=()):
    rows = spark.range(400).select((F.col("id") % 8).alias("run"), "id", (F.col("id") % 13).cast("double").alias("x"), (F.col("id") % 29).cast("double").alias("y"))
    tests = rows.select(F.concat(F.lit("f"), (F.col("run") % 4).cast("string")).alias("fold"), "run").distinct()
    return M.with_folds(rows, tests, "run", **({"keys": keys} if keys else {}))


def test_models_and_limits_reach_the_rows_without_a_shuffle(spark, no_broadcast):
    rows = fold_rows(spark)
    models = M.cut(M.expected_behaviour(rows, ["x"], ["y"]))
    long = M.residuals(rows, models, ["x"], ["y"], ["run", "id"])
    scored = M.score_residuals(long, M.cut(M.residual_thresholds(long)))
    assert "SortMergeJoin" not in plan(scored)
    assert scored.count() == 1600


def test_risk_of_dealt_rows_is_grouped_where_they_are(spark, no_broadcast):
    def scored(keys=()):
        rows = fold_rows(spark, keys)
        long = rows.select("fold", "is_test", "run", "id", F.lit("y").alias("target"), F.col("y").alias("z"))
        return M.composite_risk(long, ["run", "id"])
    assert "hashpartitioning(fold" not in plan(scored(["run", "id"]).select("fold", "is_test", "run", "id", "risk"))
    assert sorted(map(tuple, scored(["run", "id"]).collect())) == sorted(map(tuple, scored().collect()))


def test_tasks_of_a_fit_follow_the_cores():
    assert [B.task_count(n, 8) for n in (1, 40_000, 5_000_000, 40_000_000)] == [1, 3, 16, 39]


def test_nodes_are_told_apart_as_by_single_steps():
    rng = np.random.default_rng(1)
    columns, depth = rng.integers(0, 32, (5, 500)).astype(np.uint8), 8
    tree = rng.integers(0, 5, 1 << depth), rng.choice([3, 15, 28, 255], 1 << depth)
    want = np.ones(500, int)
    for _ in range(depth):
        want = 2 * want + (columns[tree[0][want], np.arange(500)] > tree[1][want])
    assert (B.walked(columns, tree, depth) == want).all()


def test_small_groups_leave_nothing_to_the_second_pass(spark, monkeypatch):
    seen = []
    marks = Q._marks
    monkeypatch.setattr(Q, "_marks", lambda chosen: (seen.append(chosen.count()), marks(chosen))[1])
    df = spark.range(3000).select((F.col("id") % 300).alias("k"), (F.col("id") * F.lit(17) % 101).cast("double").alias("v"))
    got = {r["k"]: r["p"] for r in Q.quantiles(df, ["k"], {"p": ("v", .3)}).collect()}
    rows = {}
    for r in df.collect():
        rows.setdefault(r["k"], []).append(r["v"])
    assert seen == [0] and len(got) == 300
    assert all(abs(got[k] - np.quantile(v, .3)) < 1e-9 for k, v in rows.items())


def test_fold_features_of_repeated_folds_gaps_and_lone_values(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, None, 1.0), (2, 7.0, None), (2, 7.0, 4.0), (None, 1.0, 2.0), (3, 9.0, 2.0)], "run long, a double, b double")
    folds = spark.createDataFrame([("x", 1, False), ("x", 2, False), ("x", 3, True), ("y", 3, False), ("y", None, False), ("y", 1, True), ("z", 2, False), ("z", 2, False)], "fold string, run long, is_test boolean")
    got = {(r["fold"], r["feature"]): (r["train_rows"], r["non_missing"], r["unique_count"], r["std"]) for r in S.fold_features(df, folds, "run", ["a", "b"], [], []).collect()}
    assert got[("y", "a")][:3] == (2, 2, 2) and abs(got[("y", "a")][3] - np.std([1, 9], ddof=1)) < 1e-12
    assert got[("x", "a")][:3] == (4, 3, 2) and abs(got[("x", "a")][3] - np.std([5, 7, 7], ddof=1)) < 1e-12
    assert got[("z", "b")] == (4, 2, 1, 0.0) and got[("y", "b")] == (2, 2, 1, 0.0)


def test_fold_features_multiply_no_rows(spark, no_broadcast):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 9.0)], "run long, a double")
    folds = spark.createDataFrame([(f, r, False) for f in "xyz" for r in (1, 2, 3)], "fold string, run long, is_test boolean")
    out = S.fold_features(df, folds, "run", ["a"], [], [])
    assert "Expand" in plan(out) and "BroadcastHashJoin" in plan(out)  # rows are joined with one set of folds a run
    assert {tuple(r)[:5] for r in out.select("fold", "train_rows", "non_missing", "unique_count", F.round("std", 6)).collect()} == {(f, 3, 3, 3, 2.0) for f in "xyz"}


def test_inner_medians_are_computed_once(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("a"), (F.col("id") % 2).alias("b"), F.col("id").cast("double").alias("v"))
    out = S.two_level_medians(df, ["a", "b"], ["b"], ["v"])
    assert "Range (0, 60" not in plan(out) and "ExistingRDD" in plan(out)
    assert {(r["b"], r["groups"], r["rows"], r["v_median"]) for r in out.collect()} == {(0, 3, 30, 29.0), (1, 3, 30, 30.0)}


def test_station_lines_are_dealt_by_their_number(spark, monkeypatch):
    from pulsegrid.operators import ordered

    monkeypatch.setattr(ordered, "DEALT_ROWS", 10)
    lines = spark.range(300).select((F.col("id") % 5).alias("host"), F.col("id").alias("n"), F.lit("Station 02:00:00:00:00:01 (on wlan0)").alias("line"))
    out = parsing.stations(lines, ["host"], ["n"], "line", width=50)
    assert ", 30), REPARTITION_BY_NUM" in plan(out)
    assert out.count() == 300


def test_nearest_rows_of_many_keys_share_a_shard(spark, tmp_path):
    from pulsegrid.streaming import streams as J

    second = 10**6
    runs = [None, *range(40)]
    rows = [(i, r, 100 * second + i * second, "error") for i, r in enumerate(runs)] + [(1000 + i, r, 100 * second + i * second + (i % 3 - 1) * second, "view") for i, r in enumerate(runs)]
    rows += [(9998, -1, 10**12, "error"), (9999, -1, 10**12, "view")]
    spark.createDataFrame(rows, "id long, run long, us long, kind string").withColumn("ts", F.timestamp_micros("us")).write.parquet(f"{tmp_path}/in")
    live = J.read_stream(spark, f"{tmp_path}/in")
    req = live.filter("kind = 'error'").select("id", "run", "ts")
    tel = live.filter("kind = 'view'").select("run", F.col("ts").alias("tel_ts"), F.col("id").alias("temp"), F.col("id").alias("tel_id"))
    out = J.nearest_stream(req, tel, ["run"], "ts", "tel_ts", ["temp"], within_us=second, late="1 hour", request=["id"], tie="tel_id", width_us=1000 * second, unmatched=True)
    assert "shard" in out._jdf.queryExecution().analyzed().toString()
    got = {r["id"]: (r["run"], r["temp"], r["other_us"]) for r in J.run(out).collect()}
    assert got == {i: (r, 1000 + i, 100 * second + i * second + (i % 3 - 1) * second) for i, r in enumerate(runs)}
