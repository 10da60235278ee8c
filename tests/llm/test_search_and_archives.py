from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import topk, warc_zip
from pulsegrid.llm.shared import new_folder


def brute_top(rows, k, modulus):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    best = defaultdict(list)
    for i, q in good:
        if i % modulus == 0:
            best[i] += [(-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q)]
    return {(i, n + 1, j, -s) for i, found in best.items() for n, (s, j) in enumerate(sorted(found)[:k])}


def test_top_products_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # one very common vector: ties
    rows += [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (403, [float("inf")] + [0.0] * 15), (404, []), (None, rows[0][1]),
             (405, [1.0] * 5), (410, [2.0] * 5), (406, [1.0] * 5), (420, [0.0] * 16), (7, rows[8][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank string, score int")
    for blocks in ((2048, 8192), (5, 40)):
        out = topk.search(df, F.col("vec_id") % 10 == 0, k=20, query_block=blocks[0], candidate_block=blocks[1]).collect()
        assert {tuple(r) for r in out} == brute_top(rows, 20, 10) and len(out) == len(set(out))
    few = topk.search(df.filter("vec_id < 5"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 4
    assert topk.search(df.filter("vec_id < 0"), F.lit(True)).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(i, [float(10 ** 7 + i), float(-i)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = topk.search(df, F.col("vec_id") % 10 == 0, k=3)
    assert {tuple(r) for r in out.collect()} == brute_top(rows, 3, 10)


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 24)), rng.normal(size=(60, 24))
    exact = a @ b.T
    last = None
    for n in (1, 3, 6, 24):
        bound = topk.segment_features(a, n) @ topk.segment_features(b, n).T
        assert (bound >= exact - 1e-9).all()
        if last is not None:
            assert bound.mean() < last
        last = bound.mean()


PAGES = "page_id bigint, url string, html string, payload string, row int"


def page_rows():
    long = "<p>" + "lorem é " * 40_000
    return [(1, "http://a/1", "<b>x</b>", "p", 1), (2, "http://a/2\r\nX: y", "<b>x</b>", "p", 1), (3, None, None, "p", 1), (4, "http://a/ü", "", None, 1),
            (5, "http://a/5", long, "p", None), (6, "http://a/6", long, "p", 1), (0, "http://a/0", "<b>x</b>", "p", 1), (0, "http://a/0", "<b>x</b>", "p", 1),
            (None, "http://a/n", "<b>x</b>", "p", 1), (None, "http://n", "alone", "p", 1), (9, "http://a/9", "é\r\n\r\nWARC/1.1", "p", 1)]


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_round_trip(spark, zip64):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    manifest = warc_zip.write_archives(df, new_folder(spark, "t"), zip64=zip64, package_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() >= 2
    out = warc_zip.read_archives(manifest, range_bytes=500).collect()
    assert len(out) == len(rows)
    groups = defaultdict(list)
    for i, _, html, *_ in rows:
        groups[html or ""].append(i)
    got = defaultdict(list)
    for r in out:
        got[r["payload_digest"]].append(r)
    for html, ids in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = got[digest]
        assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in same) == sorted((i is None, i or 0) for i in ids)
        first = min(((i is None, i) for i in ids), key=lambda x: (x[0], x[1] or 0))[1]
        responses = [r for r in same if r["record_type"] == "response"]
        assert [r["page_id"] for r in responses] == [first] and responses[0]["payload"] == data
        assert all(r["payload_bytes"] == len(data) for r in same)
        assert all(r["record_type"] == "revisit" and r["refers_to"] == first and r["payload"] is None for r in same if r is not responses[0])


def test_packages_are_plain_zip_files(spark):
    manifest = warc_zip.write_archives(spark.createDataFrame(page_rows(), PAGES).coalesce(1), new_folder(spark, "t"), zip64=True)
    path = manifest.first()["archive"].removeprefix("file://").removeprefix("file:")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [warc_zip.RECORDS, warc_zip.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_directory_of_other_writers_and_damage():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "stored")
        z.writestr("b.txt", "packed" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    size = held.seek(0, 2)
    members = warc_zip.directory(held, size)
    assert warc_zip.read_range(held, *warc_zip.content(held, members["a.txt"])) == b"stored"
    with pytest.raises(ValueError):
        warc_zip.content(held, members["b.txt"])
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"no archive" * 10), 100)
    record = warc_zip.warc_record(1, 0, None, b"abc", base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None, None, "2024-01-01T00:00:00Z")
    assert warc_zip.parse_record(record)[0] == 1
    with pytest.raises(ValueError):
        warc_zip.parse_record(record.replace(b"abc", b"abd"))


def test_archives_of_a_shuffled_input_are_read_by_many_tasks(spark):
    rows = [(i, f"u{i}", f"page {i % 70}" * 30) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6).distinct()
    manifest = warc_zip.write_archives(pages, new_folder(spark, "t"), package_bytes=4000)
    back = warc_zip.read_archives(manifest, range_bytes=500)
    assert back.rdd.getNumPartitions() > 1 and back.select(F.spark_partition_id()).distinct().count() > 1
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in back.collect()}
    assert kinds == {i: ("response", None) if i < 70 else ("revisit", i % 70) for i in range(300)}


def test_archives_of_an_empty_table(spark):
    manifest = warc_zip.write_archives(spark.createDataFrame([], PAGES), new_folder(spark, "t"))
    assert manifest.count() == 0 and warc_zip.read_archives(manifest).count() == 0
