"""Boosted trees beside a plain implementation that searches every cut."""

from __future__ import annotations

import numpy as np

from pulsegrid.operators import boosting as B


def plain_boosted(bins, y, rounds, step, depth):
    guess = np.full(len(y), y.mean())
    for _ in range(rounds):
        out = np.zeros(len(y))

        def grow(rows, level):
            r = (y - guess)[rows]
            if level == depth:
                out[rows] = r.mean()
                return
            best = None
            for f in range(bins.shape[1]):
                for b in range(bins.max() + 1):
                    left = bins[rows, f] <= b
                    if left.any() and not left.all():
                        gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, left
            if best is None or best[0] <= 1e-12:
                out[rows] = r.mean()
            else:
                grow(rows[best[1]], level + 1)
                grow(rows[~best[1]], level + 1)
        grow(np.arange(len(y)), 0)
        guess = guess + step * out
    return guess


def table(spark, n=300, gaps=False):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3)).round(1)
    y = np.where(x[:, 0] > 0.2, 5.0, -1.0) + x[:, 1] ** 2 + rng.normal(0, 0.1, n)
    z = x[:, 2] * 3 + 1
    rows = [(*map(float, a), float(b), None if gaps and i % 3 == 0 else float(c)) for i, (a, b, c) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, z double"), rows


def test_trees_match_an_exhaustive_search(spark):
    df, rows = table(spark)
    model = B.fit_trees(df, ["a", "b", "c"], ["y", "z"], rounds=9, step=0.3, depth=3, bins=8)
    got = {tuple(r)[:5]: (r["py"], r["pz"]) for r in B.with_predictions(model, df, {"y": "py", "z": "pz"}).collect()}
    bins = model.binned(np.array([r[:3] for r in rows]))
    for i, k in ((3, 0), (4, 1)):
        want = plain_boosted(bins.astype(int), np.array([r[i] for r in rows]), 9, 0.3, 3)
        assert np.abs(np.array([got[r][k] for r in rows]) - want).max() < 1e-9


def test_a_missing_target_leaves_the_others_as_they_are(spark):
    df, rows = table(spark, gaps=True)
    both = B.fit_trees(df, ["a", "b", "c"], ["y", "z"], rounds=5, step=0.3, depth=2)
    alone = B.fit_trees(df.filter("z is not null"), ["a", "b", "c"], ["z"], rounds=5, step=0.3, depth=2)
    assert abs(both.start[1] - alone.start[0]) < 1e-12
    got = B.with_predictions(both, df, {"z": "p"}).filter("z is not null").selectExpr("avg(pow(z - p, 2))").first()[0]
    base = df.filter("z is not null").selectExpr("var_pop(z)").first()[0]
    assert got < 0.3 * base


def test_gaps_constants_and_no_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1.0, 2.0), (nan, 1.0, 4.0), (3.0, 1.0, 6.0)], "a double, b double, y double")
    model = B.fit_trees(df, ["a", "b"], ["y"], rounds=2, step=0.5, depth=2)
    assert {round(r["p"], 9) for r in B.with_predictions(model, df, {"y": "p"}).collect()} == {4.0}
    empty = B.fit_trees(df.limit(0), ["a"], ["y"], rounds=2)
    assert [r["p"] for r in B.with_predictions(empty, df.limit(1), {"y": "p"}).collect()] == [0.0]


def test_features_share_numbers():
    rng = np.random.default_rng(4)
    widths = [32, 3, 1, 200, 32, 2, 18]
    bins = np.stack([rng.integers(0, w, 50) for w in widths], axis=1).astype(np.uint8)
    fields = B.shared(widths)
    codes = B.coded(bins, fields)
    columns = B.Columns(codes, fields)
    assert len(codes) < len(widths) and columns.shape == (7, 50)
    assert all((columns[k] == bins[:, k]).all() for k in range(7))


def test_only_the_smaller_children_are_added_up(monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    widths, n, depth = [32, 4, 3], 300, 3
    bins = np.stack([rng.integers(0, w, n) for w in widths], axis=1).astype(np.uint8)
    rests = rng.normal(size=(2, n)) + bins[:, 0] * [[.1], [0]]
    rests[1, ::7] = np.nan
    fields = B.shared(widths)
    codes = B.coded(bins, fields)
    blocks = [(codes[:, i:i + 50], rests[:, i:i + 50]) for i in range(0, n, 50)]
    trees = [(np.zeros(1 << depth, np.int64), np.full(1 << depth, 255, np.int64), np.zeros(2 << depth)) for _ in rests]
    sums = small = None
    for level in range(depth):
        got = next(B._summed(iter(blocks), fields, [], trees, small, True, 32, .1, depth))
        if level:
            assert (got[:, :, 0, :, 0].sum(axis=(1, 2)) <= np.array([n, (~np.isnan(rests[1])).sum()]) / 2).all()
        sums = B._parted(sums, got, small) if level else got
        small = B._grown(sums, trees, level)
    for t, tree in enumerate(trees):  # sums of the last level beside a plain count
        at, known = B.walked(np.ascontiguousarray(bins.T), tree, depth - 1) - 4, ~np.isnan(rests[t])
        for f in range(3):
            for node in range(4):
                for b in range(widths[f]):
                    own = known & (at == node) & (bins[:, f] == b)
                    assert sums[t, node, f, b, 0] == own.sum() and abs(sums[t, node, f, b, 1] - rests[t][own].sum()) < 1e-9


def test_equal_cuts_take_the_first_feature_whatever_the_rounding():
    sums = np.zeros((1, 1, 2, 2, 2))
    sums[0, 0, :, :, 0] = 5
    sums[0, 0, 0, :, 1], sums[0, 0, 1, :, 1] = (.3, -.3), (.1 + .2, -.1 - .2)  # the second is larger by a rounding
    tree = np.zeros(2, np.int64), np.full(2, 255, np.int64), np.zeros(4)
    B._grown(sums, [tree], 0)
    assert (tree[0][1], tree[1][1]) == (0, 0)


def test_checkpoints_of_a_fit_are_deleted(spark, monkeypatch):
    from pathlib import Path

    from pulsegrid.operators.keys import shared_folder

    monkeypatch.setattr(B, "HOLD", 1)
    monkeypatch.setattr(B, "CUT", 1)
    df, rows = table(spark, gaps=True)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {x for x in folder.glob("**/rdd-*")}
    model = B.fit_trees(df, ["a", "b", "c"], ["y", "z"], rounds=6, step=0.3, depth=2)
    assert {x for x in folder.glob("**/rdd-*")} == before
    monkeypatch.undo()
    plain = B.fit_trees(df, ["a", "b", "c"], ["y", "z"], rounds=6, step=0.3, depth=2)
    bins = model.binned(np.array([r[:3] for r in rows]))
    assert np.abs(model.predicted(bins) - plain.predicted(bins)).max() < 1e-9
