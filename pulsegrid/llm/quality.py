"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions.

Every measure is an expression over one text, so a document never leaves its row: no shuffle, no user function.
The measures that several rules need are bound once per row.

Defined results: a null text counts as empty; an empty text has no words, zero measures and ratios of zero, and fails
by its word count. Columns of the input that share a name with a measure are replaced in the result; all others pass
through. Repeated rows are judged one by one, and an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import let, words

SYMBOLS = "[#*$%&|<>]"

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this at from or an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas plus au",
    "es": "de la que el en y a los del se las por un para con no una su al lo",
}


@dataclass(frozen=True)
class Rule:
    """A measure must lie in [low, high]; a missing bound does not bind."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2, high=20),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("capitals", "upper_ratio", high=0.5),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_ratio", high=0.5),
)


def stop_forms() -> list[str]:
    """The stop words as they stand in a text: small or with a capital, bare or before a mark."""
    plain = {w for line in STOP_WORDS.values() for w in line.split()}
    return sorted(v + mark for w in plain for v in (w, w.capitalize(), w.upper()) for mark in ("", *".,;:!?"))


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a text match the one-character ``pattern``."""
    return (F.size(F.split(text, pattern)) - 1).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line, and all lines with a word, as (copies, lines)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("copies"),
                                         F.size(a).cast("bigint").alias("lines")))


def repeated_words(w: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more.

    Windows are compared by 64-bit hash: sorting (hash, place) brings equal windows side by side, and the words that the
    windows found cover are added up in order of place. Texts without any equal windows skip the sort.
    """
    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(
            F.sort_array(places), start,
            lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(width), p - acc["last"])).alias("total")),
            lambda acc: acc["total"].cast("bigint"))

    def found(s: Column) -> Column:
        same = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
        return covered(F.transform(same, lambda x: x["i"]))

    def of_hashes(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(ordered, found))

    places = F.sequence(F.lit(0), F.size(w) - F.lit(width))
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(F.size(w) <= width, F.lit(0).cast("bigint")).otherwise(let(hashes, of_hashes))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures that rules may name."""
    t = F.coalesce(F.col(text), F.lit(""))
    stops = stop_forms()
    of_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.size(F.filter(w, lambda x: x.isin(stops))).cast("bigint").alias("n_stop"),
        repeated_words(w).alias("n_repeat_words")))
    bound = df.withColumns({"__w": of_words, "__l": duplicate_lines(t)})

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    counted = bound.withColumns({
        "n_words": F.col("__w.n_words"),
        "word_chars": F.col("__w.word_chars"),
        "n_symbols": count_of(t, SYMBOLS),
        "n_dup_lines": F.col("__l.copies"),
        "n_repeat_words": F.col("__w.n_repeat_words"),
        "n_upper": count_of(t, "\\p{Lu}"),
    })
    return counted.withColumns({
        "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_ratio": ratio(F.col("__w.n_stop"), F.col("n_words")),
        "upper_ratio": ratio(F.col("n_upper"), F.col("word_chars")),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("__l.lines")),
        "repeat_ratio": ratio(F.col("n_repeat_words"), F.col("n_words")),
    }).drop("__w", "__l", "n_upper")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures breaks, as one expression."""
    broken = []
    for r in rules:
        low = F.lit(False) if r.low is None else F.col(r.measure) < F.lit(r.low)
        high = F.lit(False) if r.high is None else F.col(r.measure) > F.lit(r.high)
        broken.append(F.when(low | high, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the measures, ``base_failed``, ``broken`` (names of the rules that the row breaks) and ``kept``."""
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    out = measures(df, text).withColumns({"base_failed": base, "broken": compiled(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
