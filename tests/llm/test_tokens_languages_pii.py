from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from pulsegrid.llm import langid, pair_bpe, pii, token_count, vocabulary
from pulsegrid.llm.queries import QUERIES

from .fixtures import SCHEMA, documents, wide

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SMALL = "/root/testdata/sf0.001"
ODD = [chr(c) for c in [*range(0x20, 0x180), *range(0x300, 0x308), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x3000, 0x558, 0x2B73A, 0x1F600, 0x200D, 0x661, 0xB2,
                        0x2160, 0xAC00, 0x4E00, 0x10EC5, 0x1C89, 0x3A3, 0x130, 0xA7CB, 0x16EA0, 0x1100, 0x1161, 0x212B]]


def odd_texts(n: int):
    rng = random.Random(4)
    bits = [" ", "a", "'s", "'LL", " 1", "the", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "\n\n", "  ", "ΑΣ ", "aaaaaaa", "x" * 300]
    return ["".join(rng.choice(ODD) if rng.random() < 0.5 else rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_counts_match_the_library(spark):
    rows = documents() + [(1000 + i, t, None, None, 0) for i, t in enumerate(odd_texts(3000))]
    library = tokenizers.Tokenizer.from_file(BYTE)
    out = token_count.with_counts(wide(spark, rows), BYTE).select("text", "n_tokens").distinct().collect()
    assert {r["text"] for r in out} == {r[1] for r in rows}
    assert all(r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in out)
    assert token_count.with_counts(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_whole_tokens_are_proved_and_a_full_memory_changes_nothing():
    v = vocabulary.load(BYTE)
    whole = token_count.proved_whole(v)
    library = tokenizers.Tokenizer.from_file(BYTE)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(whole), 3000))
    small, large = token_count.Counter(v, whole, remember=3), token_count.Counter(v, [])
    assert [small(t) for t in odd_texts(300)] == [large(t) for t in odd_texts(300)]


def test_long_pre_tokens_are_merged_in_good_time():
    v, rng = vocabulary.load(BYTE), random.Random(8)
    count, library = token_count.Counter(v, token_count.proved_whole(v)), tokenizers.Tokenizer.from_file(BYTE)
    for text in ("".join(rng.choice("etaoinshr") for _ in range(200_000)), "a" * 70_001, "é" * 500, "ab" * 33, "the" * 400, "-=" * 5000):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert max(map(len, count.counts)) <= max(token_count.LONG, max(map(len, count.counts.whole)))


def test_codec_matches_the_library(spark):
    rows = documents() + [(1000 + i, t, None, None, 0) for i, t in enumerate(odd_texts(3000))]
    library = tokenizers.Tokenizer.from_file(WORD)
    df = pair_bpe.decoded(pair_bpe.encoded(wide(spark, rows), WORD), WORD)
    assert set(df.columns) == {*wide(spark, rows).columns, "decoded"}
    for r in df.select("text", "ids", "decoded").distinct().collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert pair_bpe.id_list(r["ids"]) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert pair_bpe.encoded(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_token_queries_on_the_documents(spark):
    byte, word = tokenizers.Tokenizer.from_file(BYTE), tokenizers.Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op4_token_counts"](spark, SMALL).collect():
        n = len(byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert tuple(r) == (r["doc_id"], len(texts[r["doc_id"]].encode()), n, n > 1024)
    out = QUERIES["op9_pair_index_bpe"](spark, SMALL).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_small_memory_and_descending_merges():
    v = vocabulary.load(WORD)
    texts = odd_texts(400)
    small, large = pair_bpe.Codec(v, remember=5), pair_bpe.Codec(v)
    assert [small.encode([t])[0] for t in texts] == large.encode(texts)
    bad = vocabulary.Vocabulary({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError):
        pair_bpe.Codec(bad)


# ---- languages ---------------------------------------------------------------------------------------------------

LEARNED = {"aa": [b"the cat sat on the mat", b"a cat and a dog\n"], "bb": [b"der hund und die katze", b""]}


def brute_bits(lang: str, text: bytes, order: int) -> float:
    tree: dict = {}
    for t in LEARNED[lang]:
        h = [-1] * order + list(t)
        for i in range(len(t)):
            for m in range(order + 1):
                after = tree.setdefault(tuple(h[i + order - m:i + order]), {})
                after[t[i]] = after.get(t[i], 0) + 1
    total, h = 0.0, [-1] * order + list(text)
    for i, b in enumerate(text):
        gone: set = set()
        for m in range(order, -1, -1):
            seen = {k: v for k, v in tree.get(tuple(h[i + order - m:i + order]), {}).items() if k not in gone}
            n, d = sum(seen.values()), len(seen)
            if b in seen:
                total -= math.log2(seen[b] / (n + d))
                break
            if seen:
                total -= math.log2(d / (n + d))
                gone |= set(seen)
        else:
            total += math.log2(256 - len(gone))
    return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_match_brute_force(spark, monkeypatch, order):
    sample = spark.createDataFrame([(l, t) for l, ts in LEARNED.items() for t in ts], "lang string, text binary")
    table = langid.byte_counts(sample, order).toPandas()
    model = langid.build({l: (g["seq"].to_numpy(), g["n"].to_numpy()) for l, g in table.groupby("lang")}, order, 1 << 28)
    rng = random.Random(1)
    texts = [b"the dog und", b"", b"xyz\xc3\xa9", b"t", b"th"] + [bytes(rng.choice(b"the catdogunkz\n\xff") for _ in range(rng.randint(0, 40))) for _ in range(100)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = np.array([[brute_bits(l, t, order) for l in model.languages] for t in texts])
    for chunk in (5, 64, 1 << 19):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.abs(langid.code_lengths(model, data, ends) / langid.UNIT - want).max() < 1e-3


def test_held_out_accuracy_and_odd_rows(spark):
    out = QUERIES["op1_ppm_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    model = langid.learn(spark.createDataFrame([(i, t, l) for l in ("de", "fr") for i, t in enumerate(["x y", f"{l} wort mot" * 9, None])] + [(None, "q", "zz"), (1, "q", None)],
                                               "doc_id bigint, text string, lang string"))
    assert model.languages == ["de", "fr"]
    got = langid.predicted(wide(spark), model)
    assert set(got.columns) == {*wide(spark).columns, "score", "bits"}
    rows = got.collect()
    assert len(rows) == len(documents()) and all(0 <= r["score"] <= 1 for r in rows)
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.learn(empty) is None
    assert {r["lang_pred"] for r in langid.predicted(wide(spark), None).collect()} == {"und"}
    assert langid.predicted(empty, model).count() == 0


# ---- personal data -----------------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            good = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and odd % 10 == 0, 9 <= len(digits) <= 15)[k]
            if good:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_match_brute_force():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789012.-+ @ab()%é") for _ in range(rng.randint(0, 40)))
        assert pii.pattern_spans(text) == brute_spans(text)
    long = "a" * 300_000 + "@b.c " + "1" * 300_000 + " 1.2.3.4 " + "." * 1000 + "+" * 1000
    assert [s[2] for s in pii.pattern_spans(long)] == [0, 1]


def teaching_rows():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta wort the of and mot".split())
    rows = []
    for i in range(160):
        kind = i % 5
        text = (f"{word()}.{word()}{i}@mail{i % 7}.example.com", f"{i % 250}.{i * 7 % 250}.{i * 3 % 250}.{i % 9}", "4111 1111 1111 1111" if i % 2 else "4012888888881881",
                f"+1 ({200 + i}) 555-{1000 + i}", f"number {i * 997} of {i}")[kind]
        rows.append((i, " ".join([word() for _ in range(12)] + [text] + [word() for _ in range(12)]), "en", "s", 1))
    return rows


def test_field_keeps_base_spans_and_finds_more(spark):
    df = wide(spark, teaching_rows() + documents())
    field = pii.learn(df)
    rows = pii.found(df, field).select("text", "base", "spans").collect()
    assert len(rows) == df.count()
    for r in rows:
        want = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in brute_spans(r["text"] or "")]
        assert r["base"] == want and set(want) <= set(r["spans"])
    text = "the two +1 (826) 555-4081 190.137.223.20 of and"
    assert pii.pattern_spans(text) == [(26, 40, 1)]
    assert (8, 25, 3) in pii.all_spans(text, field)[1]
    for clean in ("the version 2.0 of the tool", "no data in here", "in 1999 and 2001 the 3 of 12"):
        assert pii.all_spans(clean, field) == ([], [])


@pytest.mark.parametrize("before", ["", "In 2021 write to ", "5 host name is now here ", "1 2 3 a b c d e f ", "room 12, "])
def test_every_spelling_is_a_candidate_behind_a_number(before):
    values = [("jane.roe@mail.example.com", 0), ("ab@c.org", 0), ("10.0.0.1", 1), ("192.168.12.200", 1), ("4111 1111 1111 1111", 2), ("+1 (620) 555-8424", 3)]
    for value, kind in values:
        for other, _ in pii.spellings(value, (0, len(value), kind)):
            text = f"{before}{other} and so on\nnext line"
            found = [text[i.atoms[a][0]:i.atoms[b - 1][1]] for i in pii.islands(text, []) for a, b in pii.candidates(text, i)]
            assert other in found
    for other in ("john [dot] smith [at] example [dot] com", "john dot smith at mail dot example dot com", "jane.roe (at) example.com", "jane.roe at example[.]com"):
        text = before + other
        assert other in [text[i.atoms[a][0]:i.atoms[b - 1][1]] for i in pii.islands(text, []) for a, b in pii.candidates(text, i)]


def brute_candidates(text, walls):
    """Segments of a whole line between walls that hold a sign, without any windows."""
    marks = {a for a, _ in pii.signs(text)}
    out, cuts = set(), sorted({0, len(text), *[x for a, b, _ in walls for x in (a, b)], *[x for m in re.finditer("\n", text) for x in m.span()]})
    for low, high in zip(cuts, cuts[1:]):
        if any(a <= low < b for a, b, _ in walls):
            continue
        atoms = [(m.start(), m.end(), "d" if m.group()[0] in "0123456789" else "a" if m.group()[0].isalpha() else m.group()[0]) for m in pii._ATOM.finditer(text, low, high)]
        whole = pii.Island(atoms, [a in marks for a, _, _ in atoms])
        out |= {(atoms[i][0], atoms[j - 1][1]) for i, j in pii.candidates(text, whole)}
    return out


def test_windows_lose_no_candidate_and_dense_numbers_stay_linear():
    rng = random.Random(6)
    bits = ["word", " ", " ", " ", "7", "2021", ".", " dot ", " at ", "x.org", "\n", "@", "(", ")", "-", "a@b.co", "10.0.0.1", "lorem ipsum dolor sit amet ", "é"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 120)))
        walls = pii.pattern_spans(text)
        got = [(i.atoms[a][0], i.atoms[b - 1][1]) for i in pii.islands(text, walls) for a, b in pii.candidates(text, i)]
        assert len(got) == len(set(got)) and set(got) == brute_candidates(text, walls)
    long = "12 ab " * 100_000 + "at-" * 100_000 + "\n" + "7" * 300_000
    island, digits = pii.islands(long, [])
    assert len(island.atoms) >= 200_000 and len(digits.atoms) == 1
    assert [s for s in pii.candidates(long, digits)] == []


def test_masking_and_tables_without_anything_to_learn(spark):
    assert pii.mask("mail a@b.co or +1 (620) 555-8424.", pii.pattern_spans("mail a@b.co or +1 (620) 555-8424.")) == "mail <EMAIL> or <PHONE>."
    assert pii.mask(None, []) is None
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.learn(empty) is None and pii.found(empty, None).count() == 0
    df = wide(spark, documents())
    out = pii.masked(df, None)
    assert out.columns == df.columns and {r["text"] for r in out.collect()} == {r[1] for r in documents()}


def test_segment_sums_match_enumeration():
    rng = np.random.default_rng(2)
    size, segments = 6, [(i, j) for i in range(6) for j in range(i + 1, min(i + 4, 7)) if (i + j) % 3]
    weight = rng.normal(size=len(segments))

    def parses(at):
        if at == size:
            yield []
            return
        for rest in parses(at + 1):
            yield rest
        for k, (i, j) in enumerate(segments):
            if i == at:
                for rest in parses(j):
                    yield [k, *rest]

    every = list(parses(0))
    total = np.log(sum(math.exp(sum(weight[k] for k in p)) for p in every))
    chance, got = pii.marginals(size, segments, weight)
    assert abs(got - total) < 1e-9
    for k in range(len(segments)):
        assert abs(chance[k] - sum(math.exp(sum(weight[x] for x in p) - total) for p in every if k in p)) < 1e-9
    scores = np.stack([weight, weight - 1, weight - 2, weight - 3], axis=1)
    best = max(every, key=lambda p: sum(weight[k] for k in p))
    assert [s[:2] for s in pii.best_segments(size, segments, scores)] == [segments[k] for k in best]
