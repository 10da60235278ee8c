"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WIDE = SCHEMA + ", kept boolean, n_words string, ids string, spans string, epoch string, domain string, lang_pred int, slot string, rank string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    pool = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('nrstl')}{i % 37}" for i in range(words)]
    return " ".join(rng.choice(pool) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, prose(rng, rng.choice([3, 20, 60, 120, 300])), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), 1))
    near = rows[5][1].split(" ")
    for k in range(8):  # near copies of one text, each with another word changed
        words = list(near) * 3
        words[7 * k % len(words)] = f"changed{k}"
        rows.append((n + k, " ".join(words), "en", "s0", 2))
    rows += [(n + 20, None, "en", "s1", None), (n + 21, "", "de", None, 0), (n + 22, " \n\t ", None, "s0", 3), (None, "one two", "en", "s0", 7),
             (None, None, None, None, None), rows[3], rows[3], (n + 23, rows[4][1], "fr", "s2", 5), (n + 24, rows[4][1].upper(), "fr", "s2", 5),
             (n + 25, "word " * 5000 + "x" * 70_000, "en", "s0", 1), (n + 26, "line one\nline one\n\nline one\nother", "en", "s0", 1),
             (n + 27, "the cat sat on the mat the cat sat on", "en", "s0", 1), (n + 28, "écrire à <|endoftext|> l'été ΑΣ ñ 😀!", "fr", "s3", 1)]
    return rows


def wide(spark, rows=None):
    """The documents with further columns that results use as names."""
    return spark.createDataFrame([(*r, True, "nine", "i", "s", "e", "d", 4, "q", "r") for r in (documents() if rows is None else rows)], WIDE)
