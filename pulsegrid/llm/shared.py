"""What the operators of this package have in common: shared folders, stored steps, local bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.operators.keys import scratch_folder

WORD_BREAK = "[\\x20\\x09-\\x0D]+"  # what parts words; the same six characters as in BLANKS
BLANKS = " \t\n\x0b\x0c\r"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name nobody else uses, below the shared folder of the session (``spark.checkpoint.dir``)."""
    return f"{scratch_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write a step as Parquet in the shared folder and read it back: later steps neither compute it again nor
    depend on files that an executor keeps, and column pruning still reaches the stored copy."""
    folder = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Send Python workers batches of ``size`` bytes: their copies stay small beside an executor's memory, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: the longest runs without blanks. No text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``pos``, the position of every row in its group (from 0), and ``n``, the rows of the group.

    Rows are parted by ranges of ``by`` and ``order``, each task counts its own, and a row per (group, task) says how many come before: a group
    of any size is spread over tasks. Rows that are equal in ``by`` and ``order`` stand in some order. The result is stored: a second
    partitioning would draw its ranges anew.
    """
    ranges = [*by, *order]
    parts = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges)
    held = stored(parts.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), "numbered")
    here = held.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(here.select(*by, "__part", "__first", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
                                F.sum("__rows").over(Window.partitionBy(*by)).alias("n")), "starts")
    return held.join(starts, [*by, "__part"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def lean(work: Callable) -> Callable:
    """``work`` on the batches of a task, after which its Python worker gives back the memory it no longer uses: workers wait for their next task, and what several
    stages leave behind would add up beside the executor's own."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass
    return run
