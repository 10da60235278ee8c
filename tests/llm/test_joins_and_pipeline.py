from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import jaccard, mix, pii
from pulsegrid.llm.components import components
from pulsegrid.llm.queries import MIX_WEIGHTS, domain_of

from .fixtures import SCHEMA, documents, prose, wide
from .test_quality_shards_mix import WORD, brute_measures

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def brute_groups(texts, percent=80):
    """Index of the group of every text."""
    sets = [brute_set(t) for t in texts]
    up = list(range(len(sets)))

    def of(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = of(i), of(j)
                up[max(a, b)] = min(a, b)
    return sets, [of(i) for i in range(len(sets))]


def near_rows(seed=2):
    """Families of near copies about the threshold, of several sizes, beside the common fixture."""
    rng = random.Random(seed)
    rows = documents(seed)
    number = 2000
    for family in range(12):
        base = prose(rng, rng.choice([12, 30, 80, 200])).split(" ")
        for _ in range(rng.choice([2, 5, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
            rows.append((number, " ".join(words) + (" shared line of words that many texts have in common" if family % 2 else ""), "en", "s", 0))
            number += 1
    rng.shuffle(rows)
    return rows


def check_linked(spark, rows):
    out = jaccard.linked(wide(spark, rows)).collect()
    assert len(out) == len(rows)
    sets, group = brute_groups([r[1] for r in rows])
    least: dict = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want


def test_links_match_brute_force(spark):
    check_linked(spark, near_rows())


@pytest.mark.parametrize("sizes", [(2, 1, 1 << 18, 4), (3, 32, 40, 6), (32, 2, 1 << 18, 3)])
def test_long_lists_and_split_groups(spark, monkeypatch, sizes):
    """Every way round large lists and groups, forced on small ones."""
    for name, value in zip(("LONG", "LOCAL_LONG", "BLOCK_MEMBERS", "BLOCK"), sizes):
        monkeypatch.setattr(jaccard, name, value)
    check_linked(spark, near_rows(7))


def test_one_document_of_each_group(spark):
    rows = near_rows(3)
    kept = jaccard.one_of_each(wide(spark, rows))
    assert kept.columns == wide(spark, rows).columns
    sets, group = brute_groups([r[1] for r in rows])
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    members = defaultdict(list)
    for i, g in enumerate(group):
        if sets[i]:
            members[g].append(i)
    want = [order(min(m, key=order)) for m in members.values()] + [order(i) for i in range(len(rows)) if not sets[i]]
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_repeated_rows_bring_one_set_of_a_class(spark):
    docs = spark.range(40).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(" ".join(f"w{i}" for i in range(30))).alias("text")).repartition(4)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tx"), F.col("text").cast("binary").alias("text"))
    of_docs = jaccard.profiles(docs, 5).cache()
    live = of_docs.select("cid", "n").distinct()
    for fine in (True, False):
        assert [(r["cid"], r["n"]) for r in jaccard._sets_of(docs, of_docs, live, 5, fine).collect()] == [tuple(live.first())]


def test_buckets_follow_the_sizes_of_the_sets(spark):
    few, many = (spark.createDataFrame(rows, "n bigint") for rows in ([(40 * jaccard.BUCKET_MEMBERS,), (None,)], [(1,)] * 1000))
    assert [jaccard.bucket_count(x) for x in (few, many, few.limit(0))] == [40, 16, 16]


def test_links_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.linked(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0
    assert jaccard.linked(spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0)], SCHEMA)).count() == 2


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (201, 202), (202, 201), (201, 202)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 201, 202: 201}
    assert {r["v"]: r["root"] for r in out} == want and len(out) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_tree_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2 ** 63, rng.integers(5, 300)).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 2 ** 63, 4).astype(np.uint64)])) for _ in range(9)]
    sizes = np.array([len(s) for s in sets])
    found = {tuple(sorted(p)) for i, j in jaccard.near_pairs([jaccard.bitmap(s) for s in sets], sizes, 80) for p in zip(i.tolist(), j.tolist())}
    real = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard.similar(sets[a], sets[b], 80)}
    assert real and real <= found and len(found) < len(sets) ** 2 / 8


def test_small_sets_do_not_make_the_maps_of_large_ones_coarser():
    rng = np.random.default_rng(6)
    shared = rng.integers(0, 2 ** 63, 2000).astype(np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 2 ** 63, 2000).astype(np.uint64)])) for _ in range(40)] + [shared[:20], shared[:5]]
    assert not sum(len(i) for i, _ in jaccard.near_pairs([jaccard.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 80))


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_words_are_hashed_alike_in_pieces(piece):
    rng = random.Random(piece)
    texts = [None, b"", b" \n ", b"A b c d E f", b"x" * 300 + b" y " * 40 + b"z" * 3000, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(500)).encode(), b"q" * 100]
    want, got = jaccard.word_hashes(texts), jaccard.word_hashes(texts, piece)
    assert (want[0] == got[0]).all() and want[1].tolist() == got[1].tolist() == [len((t or b"").split()) for t in texts]


def test_key_filter_passes_every_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    held = jaccard.key_filter(keys, 5000)
    h = np.array([r["h"] for r in keys.collect()])
    other = np.array([r["h"] for r in spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).collect()])
    assert jaccard.passes(held, h).all() and jaccard.passes(held, other).mean() < 0.05


# ---- the pipeline ------------------------------------------------------------------------------------------------

def test_stages_keep_the_columns_and_take_empty_tables(spark):
    for rows in (None, []):
        docs = wide(spark, rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_run_matches_brute_force(spark):
    """Every stage by plain means over the stage before; the field's weights and the mixture's hashes are the operators' own."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    stages = dict(corpus_pipeline.STAGES)

    first = stages["quality rules"](spark, table, SMALL).cache()
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    for i, r in docs.items():
        n, _, _, _, repeated = brute_measures(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            assert i not in kept
    assert len(kept) > len(docs) / 2

    ids = sorted(kept)
    _, group = brute_groups([kept[i] for i in ids])
    single = {ids[g] for g in group}
    second = stages["n-gram Jaccard join"](spark, first, SMALL).cache()
    assert {r["doc_id"] for r in second.collect()} == single

    field = pii.learn(second)
    third = stages["personal data"](spark, second, SMALL).cache()
    clean = {i: pii.mask(kept[i], pii.all_spans(kept[i], field)[1]) for i in single}
    got = third.collect()
    assert {r["doc_id"]: r["text"] for r in got} == clean and all(r["n_chars"] == len(r["text"]) for r in got)
    assert not any(pii.pattern_spans(t) for t in clean.values())
    assert all(clean[i] == kept[i] for i in single if not re.search("[0-9@]", kept[i]))

    named = third.select("doc_id", "text", F.struct(domain_of(F.col("source")).alias("d"), "lang", "source").alias("p"), mix.token_count(F.col("text")).alias("n"),
                         F.xxhash64(F.lit(7), F.lit(0), F.col("doc_id"), F.xxhash64("text")).alias("h0")).collect()
    flat = [{"doc_id": r["doc_id"], "text": r["text"], "lang": tuple(r["p"]), "source": None, "n": r["n"], "h0": r["h0"]} for r in named]
    total = int(0.8 * sum(r["n"] for r in flat))
    budgets = mix.leaf_budgets({p: n for p, n in _sums(flat).items() if n}, MIX_WEIGHTS, total, 1)
    chosen = set()
    for leaf, budget in budgets.items():
        upto = 0
        for r in sorted((r for r in flat if r["lang"] == leaf), key=lambda r: r["h0"]):
            upto += r["n"]
            if upto <= budget or upto - r["n"] < budget and upto - budget < budget - (upto - r["n"]):
                chosen.add(r["doc_id"])
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in out} == chosen and len(out) == len(chosen)

    word = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in out:
        tokens = word.encode(clean[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(tokens) and r["ids_sha256"] == hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest()


def _sums(rows):
    out = defaultdict(int)
    for r in rows:
        out[r["lang"]] += r["n"]
    return out
