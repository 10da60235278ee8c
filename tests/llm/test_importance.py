"""Importance resampling beside plain Python: features, weights, cutoffs and ranks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import importance, queries

from .fixtures import documents, wide

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text) -> list[str]:
    w = words(text)
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(f: str) -> int:
    return zlib.crc32(f.encode()) % 10000


def brute(rows: list[tuple], target: list[str]) -> list[tuple]:
    corpus, aim = (Counter(bucket(f) for t in texts for f in runs(t)) for texts in ([r[1] for r in rows], target))
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (s + 10000) / ((corpus[b] + 1.0) * (t + 10000)))) for b in range(10000)]
    out = []
    for r in rows:
        f = runs(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(r[1]))])
    able = sorted((o for o in out if o[5] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for k, o in enumerate(able[:5 * len(able) // 100]):
        o[4] = k + 1
    return [tuple(o[:5]) for o in out]


def test_query_matches_brute_force(spark, tmp_path):
    rows = documents() + [(1000 + i, t, "en", "s", 1) for i, (_, t, *_) in enumerate(documents(2, 200))]
    target = [r[1] for r in documents(3, 8)[:8]] + [None]
    wide(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in queries.QUERIES["op12_importance_resampling"](spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, target), key=repr)
    assert sum(r[4] is not None for r in got) > 5


def test_empty_tables(spark, tmp_path):
    wide(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.QUERIES["op12_importance_resampling"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("piece", [16, 100, 1 << 20])
def test_features_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    rng = random.Random(piece)
    texts = [r[1] for r in documents(5, 20)][:28] + ["x" * 300 + " a b " + "y" * 70 + " c", "a", "", None, "A-b-C", "né 😀 Ωmega " * 30]
    rng.shuffle(texts)
    found = [Counter() for _ in texts]
    for owner, places, checks in importance.feature_checksums([t.encode() if t is not None else None for t in texts]):
        for p, c in zip(places, checks):
            for o, x in zip(owner[p].tolist(), c.tolist()):
                found[o][x] += 1
    assert found == [Counter(zlib.crc32(f.encode()) for f in runs(t)) for t in texts]


def test_cutoff_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 10)
    rng = random.Random(4)
    keys = [(rng.choice([rng.randrange(-50, 50), 7]), rng.randrange(100)) for _ in range(5000)]
    df = spark.createDataFrame(keys, "score bigint, ident bigint").repartition(7).persist()
    ordered = sorted(keys, key=lambda k: (-k[0], k[1]))
    for k in (1, 2, 137, 2500, 4999, 5000):
        assert importance.cutoff(df, k) == ordered[k - 1]
    assert importance.cutoff(df, 5001) is None and importance.cutoff(df, 0) is None
    df.unpersist()


def test_no_more_than_the_number_among_equal_rows(spark):
    df = spark.createDataFrame([(1, "word " * 25)] * 100, "doc_id bigint, text string")
    out = importance.resampled(df, df.limit(1).select("text"))
    assert sorted(r[0] for r in out.filter("rank is not null").select("rank").collect()) == [1, 2, 3, 4, 5]
    assert out.count() == 100 and out.select(F.countDistinct("weight")).first()[0] == 1
