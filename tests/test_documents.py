"""Documents of unknown shape, numbered lines and audits."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C
from pulsegrid.operators import audits as A, documents as D
from pulsegrid.sources import files as X


def document(rng: random.Random, depth: int = 0):
    kind = rng.randrange(8 if depth < 5 else 5)
    if kind == 0:
        return None
    if kind == 1:
        return rng.choice([True, False])
    if kind == 2:
        return rng.randrange(-1000, 1000)
    if kind in (3, 4):
        return "".join(rng.choice(['null', ',', '"', '\\', ':', ' ', '}', ']', 'é', 'a', '\n']) for _ in range(rng.randrange(6)))
    if kind == 5:
        return [document(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}" + rng.choice(["", ".x", "null"]): document(rng, depth + 1) for i in range(rng.randrange(4))}


def pruned(v):
    if isinstance(v, dict):
        return {k: p for k, x in v.items() if (p := pruned(x)) is not None}
    if isinstance(v, list):
        return [p for x in v if (p := pruned(x)) is not None]
    return v


def flat(v, name=""):
    if isinstance(v, dict):
        return [x for k, w in v.items() for x in flat(w, f"{name}.{k}" if name else k)]
    if isinstance(v, list):
        return [x for i, w in enumerate(v) for x in flat(w, f"{name}[{i}]")]
    return [(name, v if v is None or isinstance(v, str) else json.dumps(v))]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    return [document(rng) for _ in range(400)] + [{"long": ["x\\\"y null," * 20_000, None]}, {"a": [[[[[[[[[[None, 1]]]]]]]]]]}]


def texts(spark, docs):
    styles = [{}, {"separators": (",", ":")}, {"indent": 1}]
    return spark.createDataFrame([(i, json.dumps(d, ensure_ascii=i % 2 == 0, **styles[i % 3])) for i, d in enumerate(docs)], "id long, doc string")


def test_pruned_texts(spark, docs):
    got = dict(map(tuple, texts(spark, docs).select("id", D.prune_text("doc")).collect()))
    for i, d in enumerate(docs):
        assert (None if got[i] is None else json.loads(got[i])) == pruned(d), docs[i]
    bad = spark.createDataFrame([("{oops",), (None,), ("",), (" null ",)], "doc string").select(D.prune_text("doc")).collect()
    assert [r[0] for r in bad] == [None] * 4


def test_leaves_of_unknown_shapes(spark, docs):
    got: dict = {}
    for r in D.flatten_unknown(texts(spark, docs), ["id"], "doc").collect():
        got.setdefault(r["id"], []).append((r["name"], r["value"]))
    for i, d in enumerate(docs):
        assert sorted(got.get(i, []), key=repr) == sorted(flat(d), key=repr)
    empty = spark.createDataFrame([(1, "{oops"), (2, None), (3, "{}")], "id long, doc string")
    assert D.flatten_unknown(empty, ["id"], "doc").count() == 0


def test_typed_values_lose_the_nulls_of_their_lists(spark):
    df = spark.createDataFrame([(([1, None, 2], {"a": None, "b": [None, 3]}, [(None, [None])]),), (None,)],
                               "d struct<x: array<int>, m: map<string,array<int>>, s: array<struct<n: int, l: array<int>>>>")
    got = [r[0] for r in df.select(C.prune("d", df.schema["d"].dataType)).collect()]
    assert got == ['{"x":[1,2],"m":{"b":[3]},"s":[{"l":[]}]}', None]


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    rng = random.Random(3)
    lines = [json.dumps({"a": i, "pad": "x" * rng.randrange(300)}) if rng.random() < 0.8 else "" for i in range(4000)]
    for name in ("one", "two"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        numbered = X.numbered_lines(spark, str(tmp_path))
        assert numbered.count() == 8000 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        for name in ("one", "two"):
            own = numbered.filter(F.col("file").endswith(f"{name}.jsonl")).collect()
            assert {r["line_no"]: r["value"] for r in own} == dict(enumerate(lines, 1))
        assert X.read_jsonl(spark, str(tmp_path), "a int", strict=True).count() == 2 * sum(bool(x) for x in lines)
        spoiled = list(lines)
        spoiled[3210] = '{"a": '
        (tmp_path / "two.jsonl").write_text("\n".join(spoiled) + "\n")
        with pytest.raises(Exception, match=r"two\.jsonl:3211: invalid JSON line"):
            X.read_jsonl(spark, str(tmp_path), "a int", strict=True).collect()
        assert X.bad_lines(X.numbered_lines(spark, str(tmp_path))).select("line_no").collect()[0][0] == 3211
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_readiness_without_measured_drift_fails(spark):
    runs = spark.createDataFrame([("c", 10, "no", None, 1.0, 0), ("c", 10, None, None, -2.0, 0)], "c string, n int, bad string, t double, k double, e int")
    out = A.readiness(runs, ["c"], eligible_rows="n", ineligible="bad", temperature_drift="t", clock_drift="k", episodes="e", min_replicates=2, min_rows=20,
                      max_temperature_drift=5, max_clock_drift=2)
    got = {r["check"]: (r["status"], r["observed"]) for r in out.collect()}
    assert got["gpu_temp_internal_drift"] == ("fail", None) and got["sm_clock_internal_drift"] == ("pass", 2.0)
    assert sum(s == "pass" for s, _ in got.values()) == 5
    assert A.readiness_decision(out, ["c"]).first()["decision"].startswith("not_ready")
