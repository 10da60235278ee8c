"""Key handling shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


CONSTANT = "__all"  # key of frames without keys; right sides joined on it alone are global aggregates


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner", *, small: bool = False) -> DataFrame:
    """Equi-join on ``by`` where a null key equals a null key; the key columns appear once.

    No side is hinted: Spark broadcasts a side only when its measured size is under the session's
    threshold, and otherwise shuffles with adaptive skew handling. The exceptions are a right side
    grouped by the constant key alone, which has one row at most, and one that is ``small`` by construction
    or by its counted rows: a shuffle by a handful of keys would put all rows of a key into one task.
    """
    if not by:
        raise ValueError("a join needs a key: keyed() gives frames without one the constant key")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in by else F.col(c) for c in right.columns])
    if small or list(by) == [CONSTANT]:
        renamed = F.broadcast(renamed)
    condition = None
    for c in by:
        term = left[c].eqNullSafe(renamed[f"__r_{c}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer", "outer", "right", "right_outer"):
        joined = joined.select(
            *[F.coalesce(left[c], renamed[f"__r_{c}"]).alias(c) for c in by],
            *[left[c] for c in left.columns if c not in by],
            *[renamed[c] for c in right.columns if c not in by],
        )
        return joined
    return joined.drop(*[f"__r_{c}" for c in by])


def keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Give a key-less frame one constant key so that grouped operators serve it too."""
    if by:
        return df, list(by)
    return df.withColumn(CONSTANT, F.lit(0)), [CONSTANT]


def spare(by: Sequence[str]) -> list[str]:
    """The constant key that ``keyed`` added, to be dropped again."""
    return [] if by else [CONSTANT]


PACKED = "__key"


def packed(keys: Sequence[str]) -> Column:
    """All keys as one struct. It is never null, and structs with equal nulls are equal, so plain equality
    joins on it keep null keys together and reuse the partitioning of a grouping by it."""
    return F.struct(*[F.col(c) for c in keys]).alias(PACKED)


def unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col(PACKED)[c].alias(c) for c in keys]


def value_code(value, steps: int = 8192) -> Column:
    """Coarse order-preserving bucket of a number: equal or larger values never get a smaller code.

    A bucket spans a fixed relative width (an octave has ``steps``), so any one bucket of a large group
    stays small whatever the unit of the values.
    """
    v = col(value).cast("double")
    magnitude = F.floor((F.log2(F.abs(v)) + F.lit(1100.0)) * F.lit(float(steps)))
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, magnitude).otherwise(-magnitude).cast("bigint")


def shared_folder(spark) -> str | None:
    """The session's checkpoint folder. Local sessions without one get a temporary folder; a cluster
    without one gets none, because a machine's own folder would not survive the machine."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulsegrid-checkpoint-"))
    return sc.getCheckpointDir()


def scratch_folder(spark) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{folder}/scratch"


def _file_system(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def delete_folder(spark, path: str) -> None:
    """Delete a folder this library has written and nothing refers to any more."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


SMALL_ROWS = 500_000  # rows of a few numbers that every executor may hold


def is_small(held: DataFrame) -> bool:
    """Whether a stored frame (``cut``) has few enough rows to be sent to every executor."""
    return held.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def cut(df: DataFrame) -> DataFrame:
    """Store an intermediate result in the shared folder, so later steps do not compute it again. A cluster that names no folder gets
    an error at once."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()
