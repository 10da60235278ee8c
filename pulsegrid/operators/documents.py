"""Documents of unknown shape: flattening by levels, and removal of nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .keys import col, cut

# A text of a JSON document, whatever stands in it. The quantifiers are possessive: matching never goes back and needs no stack.
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NULLS = rf'{STRING}\s*+:\s*+null\b\s*+,?+\s*+|({STRING})|\bnull\b\s*+,?+\s*+'
LOOSE_COMMA = rf'({STRING})|,\s*+(?=[\]}}])'


def leaves_of(df: DataFrame, keys: Sequence[str], document: Column, start: str = "", separator: str = ".", lists: bool = True) -> DataFrame:
    """``keys, name, value, kind``: one row for every scalar inside the VARIANT ``document``, with its value as text.

    A level is opened per round, an object into ``name.key`` and a list into ``name[i]``, until nothing nested is left; rounds follow
    the depth of the deepest document, rows what is in them, and no document is held as a whole by a user function. Without ``lists`` a list is a leaf with its JSON text.
    Nulls are leaves of kind VOID; empty objects and lists have no leaves.
    """
    spark = df.sparkSession
    rows, out = df.select(*keys, F.lit(start).alias("__name"), document.alias("__v")).filter("__v is not null"), None
    while True:
        rows = cut(rows.withColumn("__kind", F.schema_of_variant("__v")))
        is_list, is_object = F.col("__kind").startswith("ARRAY"), F.col("__kind").startswith("OBJECT")
        nested = is_object | is_list if lists else is_object
        text = F.when(is_list, F.to_json("__v")).otherwise(F.col("__v").cast("string"))
        leaves = rows.filter(~nested).select(*keys, F.col("__name").alias("name"), text.alias("value"), F.regexp_extract("__kind", "^[A-Z]+", 0).alias("kind"))
        out = leaves if out is None else out.unionByName(leaves)
        deeper = rows.filter(nested)
        if deeper.isEmpty():
            return out
        inside = spark.tvf.variant_explode(F.col("__v").outer()).select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__inner"))
        dot = F.when(F.col("__name") == "", F.col("__key")).otherwise(F.concat("__name", F.lit(separator), "__key"))
        at = F.concat("__name", F.lit("["), F.col("__pos").cast("string"), F.lit("]"))
        rows = deeper.lateralJoin(inside).select(*keys, F.when(F.col("__key").isNull(), at).otherwise(dot).alias("__name"), F.col("__inner").alias("__v"))


def flatten_unknown(df: DataFrame, keys: Sequence[str], text: str, separator: str = ".", lists: bool = True) -> DataFrame:
    """The leaves of JSON texts, each of its own shape. Text that is not JSON has none."""
    return leaves_of(df, keys, F.try_parse_json(F.col(text)), separator=separator, lists=lists)


def flatten_indexed_deep(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The leaves of a typed column, lists in lists to any depth, as ``column[i][j].field``."""
    return leaves_of(df, keys, F.to_variant_object(F.col(column)), start=column)


def prune_text(text: str | Column) -> Column:
    """A JSON text without its nulls: members of objects and items of lists go, at any depth; what is empty then stays as ``{}`` or ``[]``.

    Two passes over the text that step over strings as wholes: the first takes out nulls, the second the commas they leave at the end of a list or object. The rest of the text stays as it is,
    the order of members too. What is not JSON, or null alone, gives null. Nothing is shuffled, and a text's depth does not matter.
    """
    t = col(text)
    pruned = F.regexp_replace(F.regexp_replace(t, NULLS, "$1"), LOOSE_COMMA, "$1")
    return F.when(F.try_parse_json(t).isNotNull(), F.nullif(F.trim(pruned), F.lit("")))
