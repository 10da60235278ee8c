"""The pipeline over ``documents``: each stage works on all that the one before kept.

Stages take ``(spark, docs, sf_dir)`` and return a DataFrame; all but the last return the columns of their input. A row travels as one struct
where an operator adds columns of its own, so columns with clashing names come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import jaccard, pii, quality
from pulsegrid.llm.queries import source_mixture, token_digests
from pulsegrid.llm.shared import small_batches, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all rules. An explode drops the others: a filter would be pushed below the projection, and every rule would
    compute the measures it names anew."""
    small_batches(spark)
    judged = quality.judged(docs.select(F.struct("*").alias("__row"), "text"))
    return judged.select(F.explode(F.when(F.col("kept"), F.array("__row"))).alias("__row")).select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 80 per cent or more."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    small_batches(spark, 4 << 20)
    out = pii.masked(docs, pii.learn(docs))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns) if "n_chars" in docs.columns else out


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of four fifths of the tokens, towards the target weights, every document once at most."""
    small_batches(spark)
    return source_mixture(docs.select(F.struct("*").alias("__row"), "doc_id", "text", "lang", "source"), 0.8, 1).select("__row.*")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests. Texts, ids and decoded texts are held side by side, so batches are small."""
    small_batches(spark, 2 << 20)
    return token_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("source weights", source_weights),
    ("BPE tokens", bpe_tokens),
]

# Neither the mixture's hashes nor the tokenizer can be written in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
