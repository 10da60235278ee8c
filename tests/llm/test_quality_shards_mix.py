from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pulsegrid.llm import mix, quality, shards
from pulsegrid.llm.shared import new_folder

from .fixtures import SCHEMA, documents, wide

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    rows = documents() + [(900, "a b c a b c a b c", None, None, 0), (901, "a a a a a", None, None, 0), (902, "# $ <b> %%", None, None, 0), (903, "x y z", None, None, 0)]
    out = quality.judged(wide(spark, rows)).collect()
    assert len(out) == len(rows)
    by_text = {r["text"]: r for r in out}
    for _, text, *_ in rows:
        r = by_text[text]
        want = brute_measures(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_are_one_projection_and_take_empty_tables(spark):
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0
    plan = quality.judged(wide(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    rules = (quality.Rule("long", "n_words", high=10),)
    assert {r["broken"][0] for r in quality.judged(wide(spark), rules=rules).filter("n_words > 10").collect()} == {"long"}


def test_shards_are_even_and_places_have_no_gaps(spark):
    rows = documents(n=400)
    out = shards.sharded(wide(spark, rows), new_folder(spark, "t"), slots=512).collect()
    assert len(out) == len(rows)
    held, places = defaultdict(int), defaultdict(list)
    for r in out:
        held[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    for p in places.values():
        assert sorted(p) == list(range(len(p)))
    normal = [b for b in held.values()]
    largest = max(r["size"] for r in out)
    assert max(normal) - min(normal) <= largest  # one text is far larger than a shard's share
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert len({(r["doc_id"], r["shard"]) for r in out if r["doc_id"] == 3}) == 1


def test_copies_of_one_record_are_dealt_over_the_slots(spark):
    rows = [(7, "the same text again")] * 800 + [(1000 + i, f"text {i} " + "x" * (i % 90)) for i in range(1200)] + [(None, None)] * 900
    out = shards.sharded(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), new_folder(spark, "t")).collect()
    loads, count = [0] * shards.SLOTS, [0] * shards.SLOTS
    for r in out:
        loads[r["vslot"]] += r["size"]
        count[r["vslot"]] += 1
    assert max(count) < 20 and sum(count) == len(rows)
    owner, held = {}, [0] * 8  # the map by brute force: largest slot first, to the shard that holds least and was filled least often
    filled = [0] * 8
    for s in sorted(range(shards.SLOTS), key=lambda s: (-loads[s], s)):
        k = min(range(8), key=lambda k: (held[k], filled[k], k))
        owner[s], held[k], filled[k] = k, held[k] + loads[s], filled[k] + 1
    assert max(held) - min(held) <= max(r["size"] for r in out)
    assert all(r["shard"] == owner[r["vslot"]] for r in out)
    for k in range(8):
        mine = sorted((r for r in out if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        order = [(r["vslot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in mine]
        assert order == sorted(order)


def test_map_versions_and_edits(spark):
    loads = [((i * 7919) % 1000 + 1, 1) for i in range(512)]
    first = shards.first_map(loads, 8)
    assert shards.imbalance(first) < 0.001
    folder = new_folder(spark, "t")
    shards.save_map(spark, folder, 0, first)
    grown = shards.edited_map(shards.read_slots(shards.load_map(spark, folder, 0)), loads, 9)
    shards.save_map(spark, folder, 1, grown)
    assert shards.read_slots(shards.load_map(spark, folder, 0)) == first
    moved = [s for s, t in zip(first, grown) if s.shard != t.shard]
    assert shards.imbalance(grown) < 0.05 and len(moved) < 512 / 9 * 2
    assert {t.shard for s, t in zip(first, grown) if s.shard != t.shard} == {8}
    fewer = shards.edited_map(grown, loads, 5)
    assert {s.shard for s in fewer} == set(range(5)) and shards.imbalance(fewer) < 0.02
    assert all(t.shard == s.shard for s, t in zip(grown, fewer) if s.shard < 5)


def test_shards_of_an_empty_table(spark):
    assert shards.sharded(spark.createDataFrame([], SCHEMA), new_folder(spark, "t"), slots=16).count() == 0


def test_budgets_fill_siblings_before_ancestors():
    tokens = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 200, ("b", "z"): 0}
    weights = {("a",): 0.5, ("b",): 0.5, ("a", "x"): 0.5, ("a", "y"): 0.5}
    assert mix.leaf_budgets(tokens, weights, 100, 1) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50, ("b", "z"): 0}
    assert mix.leaf_budgets(tokens, weights, 260, 1) == {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 150, ("b", "z"): 0}
    assert mix.leaf_budgets(tokens, weights, 10_000, 2) == {k: 2 * v for k, v in tokens.items()}
    assert sum(mix.leaf_budgets(tokens, weights, 77, 3).values()) == 77
    assert mix.leaf_budgets({}, weights, 5, 1) == {}


def brute_mixture(spark, rows, weights, total, epochs, seed):
    """The same mixture by ordering every leaf; the hash is Spark's own."""
    have = defaultdict(int)
    for r in rows:
        have[(r["lang"], r["source"])] += r["n"]
    wanted = total if isinstance(total, int) else int(total * sum(have.values()))
    budget = mix.leaf_budgets({k: v for k, v in have.items() if v}, weights, wanted, epochs)
    out = Counter()
    for leaf, b in budget.items():
        own = [r for r in rows if (r["lang"], r["source"]) == leaf]
        full, rest = divmod(b, have[leaf])
        for r in own:
            for e in range(full):
                out[r["doc_id"], r["text"], e] += 1
        if rest:
            upto = 0
            for h in sorted({r[f"h{full}"] for r in own}):
                peers = [r for r in own if r[f"h{full}"] == h]
                upto += sum(r["n"] for r in peers)
                if upto > rest and (upto - sum(r["n"] for r in peers) >= rest or upto - rest >= rest - (upto - sum(r["n"] for r in peers))):
                    break
                for r in peers:
                    out[r["doc_id"], r["text"], full] += 1
    return out


def test_mixture_matches_ordering_whole_leaves(spark):
    df = wide(spark, documents(seed=3, n=150)).cache()
    weights = {("en",): 0.2, ("de",): 0.7, ("en", "s0"): 0.9}
    rows = df.select("doc_id", "text", "lang", "source", mix.token_count(F.col("text")).alias("n"), *[
        F.xxhash64(F.lit(5), F.lit(e), F.col("doc_id"), F.xxhash64("text")).alias(f"h{e}") for e in range(4)]).collect()
    for total, epochs in ((0.5, 1), (1.0, 3), (500, 1), (3, 1), (0, 2)):
        out = mix.mixed(df, ("lang", "source"), weights, total, epochs=epochs, seed=5)
        assert set(out.columns) == set(df.columns)
        assert Counter((r["doc_id"], r["text"], r["epoch"]) for r in out.collect()) == brute_mixture(spark, rows, weights, total, epochs, 5)


def test_mixture_comes_near_its_budget_beside_a_very_long_document(spark):
    rows = [(i, "w " * 1000, "en", "s", 1) for i in range(40)] + [(100, "v " * 15_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for seed in range(6):
        out = mix.mixed(df, ("lang", "source"), {}, 28_000, seed=seed)
        assert abs(out.select(F.sum(mix.token_count(F.col("text")))).first()[0] - 28_000) <= 7_500


def test_mixture_of_an_empty_table(spark):
    assert mix.mixed(spark.createDataFrame([], SCHEMA), ("lang", "source"), {}, 0.5).count() == 0
