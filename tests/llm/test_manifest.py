"""The Merkle manifest beside trees built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from pulsegrid.llm import merkle, queries

from .fixtures import SCHEMA, documents, wide


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1:run + 16])))
        at //= 16
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(source, []).append((doc_id, sha("".join(map(field, (doc_id, source, lang, n_chars, text)))), text, lang, source, n_chars))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: levels([r[1] for r in groups[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, text, lang, source, n_chars) in enumerate(groups[s]):
            proof = siblings(trees[s], i) + siblings(top, k)
            node = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                node = sha("".join(map(field, (doc_id, source, lang, n_chars, low))))
            for left, right in proof:
                node = sha(left + node + right)
            out.append((doc_id, leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in proof)), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, tmp_path, rows):
    wide(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)


def test_manifest_matches_brute_force(spark, tmp_path):
    rows = documents()
    rows += [(1000 + i, f"Text {i}", "en", "big", i) for i in range(300)]  # three levels
    rows += [(2000, "alone", "en", "", 1), (2001, "É", None, "é", None)]
    assert run(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_many_groups_make_levels_above(spark, tmp_path):
    rows = [(i, f"T{i}", "en", f"source {i % 40}", i) for i in range(120)]
    got = run(spark, tmp_path, rows)
    assert got == sorted(brute(rows), key=repr)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_none(spark, tmp_path):
    assert run(spark, tmp_path / "one", [(5, "Ab", "en", None, 2)]) == sorted(brute([(5, "Ab", "en", None, 2)]), key=repr)
    assert run(spark, tmp_path / "none", []) == []


def test_rows_equal_in_all_stay_apart(spark, tmp_path):
    rows = [(7, "Same", "en", "s", 4)] * 50 + [(8, None, None, "s", None)] * 20
    assert run(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_sql_gives_the_same(spark, tmp_path):
    rows = documents()[:40]
    got = run(spark, tmp_path, rows)
    con = duckdb.connect()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/plain.parquet")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/plain.parquet/*.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLES['op13_merkle_manifest']})").fetchall(), key=repr) == got


def test_a_changed_field_breaks_the_proof(spark):
    df = spark.createDataFrame([(i, f"t{i}", "g") for i in range(20)], "id bigint, text string, g string")
    out = merkle.manifest(df, "g", "id", ["id", "text"])
    good = out.filter(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count()
    bad = out.filter(merkle.folded(merkle.leaf([F.col("row.id"), F.lit("other")]), F.col("proof")) == F.col("root")).count()
    assert (good, bad) == (20, 0)
